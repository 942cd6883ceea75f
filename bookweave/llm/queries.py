"""The registered queries of the training-data operators, and SQL for those that have it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookweave.llm import bpe, chat, decontam, idfiles, infill, langid, pii, repair, repeats, reshard, simhash, topk
from bookweave.plans.scratch import scratch_root

#: The key of the registered queries where the session names none; a user sets a secret one.
PSEUDONYM_KEY = b"bookweave example key"
VOCABULARY = "byte_bpe_50k.tiktoken"
WORD_TOKENIZER = "word_bpe_49k.json"


def small_batches(spark: SparkSession) -> None:
    """Batches to Python of a thousand rows and some 4 MB at most, so that whole texts fit in a small worker.

    The settings stay in the session, as results are read after the query returns.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def pseudonym_key(spark: SparkSession) -> bytes:
    """The key in the session's spark.bookweave.pseudonymKey, or the example key."""
    return (spark.conf.get("spark.bookweave.pseudonymKey", None) or PSEUDONYM_KEY.decode()).encode()


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, and the bytes that they decode to, as digests."""
    path = public_tokenizers.path(VOCABULARY)
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    coded = bpe.encode(docs, path, public_tokenizers.PATTERN).select("doc_id", "ids")
    back = bpe.decode(coded, path, public_tokenizers.PATTERN)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that quotes the template's control strings, formatted, read back and digested."""
    path = public_tokenizers.path(VOCABULARY)
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    quote = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", quote), (-1, 1, "assistant", quote)], "conv_id long, turn long, role string, text string")
    formatted = chat.format_turns(turns.unionByName(extra), path, public_tokenizers.PATTERN)
    return chat.digest_conversations(chat.read_turns(formatted, path, public_tokenizers.PATTERN))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every document without the 13-word passages of earlier ones."""
    out = repeats.remove_repeats(_documents(spark, sf_dir).select("doc_id", "text"), repeats.Words(13))
    return _removed(out, "n_words")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes left of every document without the 50-byte passages of earlier ones."""
    out = repeats.remove_repeats(_documents(spark, sf_dir).select("doc_id", "text"), repeats.Bytes(50))
    return _removed(out, "n_bytes", F.size("removed").cast("long").alias("n_spans"))


def _removed(out: DataFrame, count: str, *more) -> DataFrame:
    n = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select("doc_id", F.col("n_symbols").alias(count), n.alias("n_removed"), *more, F.sha2("kept", 256).alias("kept_sha256"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from three quarters of them."""
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", langid.held_out())
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    groups = simhash.near_groups(_documents(spark, sf_dir))
    return groups.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op5_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents moved from 12 shards by text hash to 16 shards of near equal bytes."""
    text = F.coalesce("text", F.lit(""))
    docs = _documents(spark, sf_dir).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("group"),
    )
    old = F.pmod(F.shiftright("group", 32), F.lit(12))
    placed = reshard.reshard(docs, old, 12, 16, "size", F.col("group"), "doc_id")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where documents hold benchmark items, with up to one edit in ten characters."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    marked = decontam.mark(_documents(spark, sf_dir).select("doc_id", "text"), benchmark)
    return marked.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.*")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best inner products of every hundredth vector with all others."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(topk.usable(F.col("embedding")))
    vectors = rows.select("vec_id", topk.quantise(F.col("embedding")).alias("vector"))
    return topk.search(vectors.where("vec_id % 100 = 0"), vectors, 10)


def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data under pseudonyms."""
    out = pii.pseudonymise(_documents(spark, sf_dir).select("doc_id", "text"), pseudonym_key(spark))
    return out.select("doc_id", "text", pii.total().alias("n_found"), F.array_sort(F.map_keys("found")).alias("kinds"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations with planted faults: what is wrong with each, and its cheapest repair."""
    small_batches(spark)
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair.report(repair.damage(turns), turns.select("conv_id"))


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text cut in three and arranged, and the text rebuilt from that, as digests."""
    changed = infill.fill_in_middle(_documents(spark, sf_dir).select("doc_id", "text"))
    columns = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256")
    return infill.restore(changed.select(*columns, "output")).select(*columns, "restored_sha256")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text in ORC files by ascending doc_id, read back: where each document starts, and a digest of its ids."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    path = f"{scratch_root(spark)}/token-files-{uuid.uuid4().hex}"
    idfiles.write_ids(docs, path, public_tokenizers.path(WORD_TOKENIZER))
    return idfiles.with_crc32(idfiles.read_ids(spark, path))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_language": op3_language,
    "op4_simhash": op4_simhash,
    "op5_reshard": op5_reshard,
    "op6_decontaminate": op6_decontaminate,
    "op7_top_k": op7_top_k,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_pseudonyms": op10_pseudonyms,
    "op11_repair": op11_repair,
    "op12_infill": op12_infill,
    "op13_token_files": op13_token_files,
}

ORACLES: dict[str, str] = {
    "op1_chat_format": chat.ORACLE,
    "op2_substring_dedup": repeats.ORACLE_WORDS,
    "op7_top_k": topk.ORACLE,
    "op8_suffix_dedup": repeats.ORACLE_BYTES,
    "op11_repair": repair.ORACLE,
    "op12_infill": infill.ORACLE,
}
