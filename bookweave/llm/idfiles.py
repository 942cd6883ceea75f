"""Token ids as ORC files in the order of the documents.

A file holds a range of document ids, ascending; integers are run-length encoded, a row
index has the least and largest id of every index_rows rows, and Bloom filters tell which
ids a group of rows cannot hold. Stripes are read apart from each other. A small table
beside the files has the ids and totals of each file, so a document's place in the whole
stream is the sum of the files before it and its place in its own.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookweave.llm.columns import fresh

#: Words of a generation that a worker remembers, and the longest word that it does.
REMEMBERED, LONGEST = 400_000, 64
#: Marks that end a clause; none of them is part of a token with a letter before it.
MARKS = b".,;:!?"
# The split pattern of the tokenizers that take words by themselves, and Latin letters with one small form.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00de\u00df-\u00f6\u00f8-\u00ff]+")
#: Files whose totals are summed in one task.
FAN = 1024


def _apart(spec: str) -> bool:
    """Whether a tokenizer file takes words by themselves: NFC, small letters, no token over white space, and byte-level words without a space before them."""
    told = json.loads(spec)
    kinds = [n["type"] for n in (told["normalizer"] or {}).get("normalizers", [])]
    before = (told["pre_tokenizer"] or {}).get("pretokenizers", [])
    split = [p for p in before if p["type"] == "Split"]
    level = [p for p in before if p["type"] == "ByteLevel"]
    return (
        kinds == ["NFC", "Replace", "Lowercase"] and len(before) == 2 and len(split) == len(level) == 1 and split[0]["pattern"] == {"Regex": WORDS} and split[0]["invert"]
        and split[0]["behavior"] == "Removed" and not level[0]["add_prefix_space"] and told["model"]["type"] == "BPE" and told["post_processor"] is None
    )


class _Memory(dict):
    """Ids of words, in two generations: what is not asked for while REMEMBERED others are met goes."""

    def __init__(self, ids_of: Callable[[bytes], bytes]) -> None:
        self.ids_of, self.old = ids_of, {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.ids_of(word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


@lru_cache(maxsize=1)
def text_encoder(spec: str) -> Callable[[bytes], bytes]:
    """UTF-8 text to its ids as 32-bit integers, by the tokenizers library; a worker keeps it from task to task.

    Where the tokenizer never joins characters over ASCII white space, words are encoded by
    themselves, and what was met before is remembered; memory is bounded by twice
    REMEMBERED words and the longest one. Words of Latin letters go to the tokenizer's
    model in small letters, as its normaliser would give them, other words through all of
    it; marks at the end of a word are apart from its letters. Another tokenizer gets the
    whole text.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(spec)
    whole = lambda data: np.array(tokenizer.encode(data.decode(errors="replace"), add_special_tokens=False).ids, dtype="<i4").tobytes()
    if not _apart(spec):
        return whole
    spelt = {n: tokenizer.pre_tokenizer.pre_tokenize_str(chr(n))[0][0] for n in range(0xDF, 0x100) if n != 0xF7}
    split = tokenizer.model.tokenize

    def ids_of(word: bytes) -> bytes:
        core = word.rstrip(MARKS)
        text = core.decode(errors="replace")
        if not LATIN.fullmatch(text):
            return whole(word)
        if len(core) < len(word):
            return memory[core] + memory[word[len(core) :]]
        small = text.lower()
        if small != text:
            return memory[small.encode()]
        return np.array([t.id for t in split(small if core.isascii() else small.translate(spelt))], dtype="<i4").tobytes()

    memory = _Memory(ids_of)
    return lambda data: b"".join(map(memory.__getitem__, data.split()))


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, row_id: str = "doc_id", text: str = "text", stripe_bytes: int = 16 << 20, index_rows: int = 1000) -> None:
    """Write the ids of every text below path, documents in ascending order of row_id.

    tokenizer: a file of the tokenizers library; the driver reads it and sends it to the
    workers. Each document ends with end_id, so null and empty texts have that one id.
    Null ids come first; rows of one id are ordered by the hash of their text, and repeated
    rows stay, each with its own place. Many rows of one id are spread over files. No rows
    give a table without rows. Other columns are left out. path must not exist, and index_rows
    is 1000 at least.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    kind = docs.schema[row_id].dataType
    rows = docs.select(F.col(f"`{row_id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text"), F.monotonically_increasing_id()]
    rows = rows.withColumns({"tie": order[1], "row": order[2]})
    order = [order[0], F.col("tie"), F.col("row")]
    schema = T.StructType([T.StructField("id", kind), *(T.StructField(n, t) for n, t in (("part", T.IntegerType()), ("before", T.LongType()), ("n_tokens", T.LongType()), ("ids", T.ArrayType(T.IntegerType()))))])
    end = np.array([end_id], dtype="<i4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before = text_encoder(spec.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            made = [encode(bytes(x.as_buffer())) + end for x in batch.column(1)]
            n = np.array([len(m) // 4 for m in made], dtype=np.int64)
            borders = np.concatenate([[0], np.cumsum(n)])
            ids = pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.Array.from_buffers(pa.int32(), int(borders[-1]), [None, pa.py_buffer(b"".join(made))]))
            places = pa.array(before + borders[:-1])
            before += int(borders[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), part, dtype=np.int32)), places, pa.array(n), ids], names=schema.names)

    coded = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text").mapInArrow(run, schema)
    options = {"orc.stripe.size": stripe_bytes, "orc.create.index": "true", "orc.row.index.stride": index_rows, "orc.bloom.filter.columns": "id", "orc.bloom.filter.fpp": "0.01"}
    coded.write.options(**options).orc(f"{path}/ids")
    parts = spark.read.schema(schema).orc(f"{path}/ids").groupBy("part").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n_rows"), F.sum("n_tokens").alias("n_tokens"))
    running_total(parts, "part", "n_tokens", "start").write.orc(f"{path}/parts")


def running_total(parts: DataFrame, number: str, amount: str, out: str) -> DataFrame:
    """parts with out, the sum of amount over all smaller numbers (distinct, from 0); summed in groups of FAN, then over groups."""
    before = lambda *key: Window.partitionBy(*key).orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    group, sum_, low = fresh(parts.columns, "group", "sum", "low")
    parts = parts.withColumn(group, F.floor(F.col(number) / FAN))
    groups = parts.groupBy(group).agg(F.sum(amount).alias(sum_))
    over = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)  # a row for FAN files
    groups = groups.select(group, F.coalesce(F.sum(sum_).over(over), F.lit(0)).alias(low))
    within = F.coalesce(F.sum(amount).over(before(group)), F.lit(0))
    return parts.join(groups, group).withColumn(out, (F.col(low) + within).cast("long")).drop(group, low)


def read_ids(spark: SparkSession, path: str, row_id: str = "doc_id", wanted: Iterable[int] | None = None) -> DataFrame:
    """Documents of write_ids: row_id, start (ids of all documents before it), n_tokens, ids.

    wanted: only these ids; the filter goes to the scan, where row indexes and Bloom
    filters rule out rows before their ids are read. None gives all rows. Stripes of a file go to several tasks as
    spark.sql.files.maxPartitionBytes says. The table of files is a row per file; Spark
    broadcasts it while it is below spark.sql.autoBroadcastJoinThreshold.
    """
    rows = spark.read.orc(f"{path}/ids")
    if wanted is not None:
        rows = rows.where(F.col("id").isin(*wanted))
    parts = spark.read.orc(f"{path}/parts").select("part", F.col("start").alias("low"))
    return rows.join(parts, "part").select(F.col("id").alias(row_id), (F.col("low") + F.col("before")).alias("start"), "n_tokens", "ids")


def with_crc32(rows: DataFrame, ids: str = "ids", out: str = "ids_crc32") -> DataFrame:
    """rows with the CRC-32 of their ids as little-endian 32-bit integers in place of the ids; null ids count as none."""
    kept = rows.drop(ids, out)
    names = kept.columns
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            values, borders = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False), lists.offsets.to_numpy()
            sums = [zlib.crc32(memoryview(values[a:b]).cast("B")) if b > a else 0 for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(sums, pa.int64())], names=schema.names)

    return rows.select(*names, ids).mapInArrow(run, schema)
