import glob
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow.orc as orc
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bookweave.llm import idfiles
from bookweave.llm.queries import op13_token_files

PATH = P.path("word_bpe_49k.json")
ODD = ["Hello,  World's 123", "é ́x Å", "ΑΣ ΣΑΣ, Σ.", "a b c\x1cd\x85e", "<|endoftext|> x<|startoftext|>y", "日本語のテキスト 漢字", "x" * 5000, "\r\n\t\x0b\x0c ", "don't WE'LL i'm", "🤦🏼‍♂️ ok", "﻿bom ﬁ", "İstanbul ẞ"]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def wanted(rows):
    """doc_id, start, n_tokens, crc of rows that are in order."""
    tokenizer, start, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    return out


def documents():
    rng = random.Random(13)
    words = "the of a Banana ünlü don't 42 x-ray naïve".split()
    rows = [(3 * i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    rows += [(1 + 3 * i, t) for i, t in enumerate(ODD)] + [(1300, None), (1303, ""), (1306, "many words " * 30000), (9001, "twice"), (9001, "twice")]
    rng.shuffle(rows)
    return rows


def test_words_by_themselves_are_the_whole_text():
    with open(PATH, encoding="utf-8") as f:
        encode = idfiles.text_encoder(f.read())
    tokenizer, rng = Tokenizer.from_file(PATH), random.Random(1)
    pieces = [*ODD, "ÉCOLE.", "straße,", "Ÿ", "ÿ!?", "Ÿves", "J̌", "word.word", "a...", "Æsop;", "×", "÷", "µ", "ªº", " ", "\n", "a", "'", "'s", "́", "Σ", "9"]
    for _ in range(400):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 6)))
        assert np.frombuffer(encode(text.encode()), dtype="<i4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_another_tokenizer_gets_whole_texts():
    other = P.path("byte_bpe_50k.json")
    with open(other, encoding="utf-8") as f:
        encode = idfiles.text_encoder(f.read())
    text = " ".join(ODD)
    assert np.frombuffer(encode(text.encode()), dtype="<i4").tolist() == Tokenizer.from_file(other).encode(text, add_special_tokens=False).ids


def test_memory_forgets_what_is_not_asked_for(monkeypatch):
    monkeypatch.setattr(idfiles, "REMEMBERED", 3)
    asked = []
    memory = idfiles._Memory(lambda w: asked.append(w) or w * 2)
    assert [memory[w] for w in (b"a", b"b", b"c", b"a", b"d", b"a", b"e", b"f", b"b", b"x" * 99)] == [w * 2 for w in (b"a", b"b", b"c", b"a", b"d", b"a", b"e", b"f", b"b", b"x" * 99)]
    assert asked == [b"a", b"b", b"c", b"d", b"e", b"f", b"b", b"x" * 99] and len(memory) + len(memory.old) <= 6


def test_query_equals_brute_force(spark, tmp_path):
    rows = documents()
    for name, data in (("a", rows), ("b", [])):
        spark.createDataFrame(data, "doc_id long, text string").withColumns({"ids": F.lit(1), "id": F.lit("x"), "part": F.lit(0)}).repartition(3).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = [tuple(r) for r in op13_token_files(spark, f"{tmp_path}/{name}").select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
        assert sorted(got) == wanted(sorted(data, key=lambda r: r[0]))


def test_null_ids_and_one_id_for_all(spark, tmp_path):
    rows = [(None, "no id"), (None, None), *((5, f"text {i % 7}") for i in range(200)), (4, "before"), (6, "after")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        idfiles.write_ids(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), f"{tmp_path}/x", PATH)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = sorted(idfiles.read_ids(spark, f"{tmp_path}/x").collect(), key=lambda r: r.start)
    ends = [0, *np.cumsum([r.n_tokens for r in got]).tolist()]
    assert [r.start for r in got] == ends[:-1] and all(r.n_tokens == len(r.ids) and r.ids[-1] == 1 for r in got)
    assert [r.doc_id for r in got] == [None, None, 4, *[5] * 200, 6]
    assert len(glob.glob(f"{tmp_path}/x/ids/*.orc")) > 1
    assert sorted(crc(r.ids) for r in got) == sorted(w[3] for w in wanted(rows))


def rows_scanned(df):
    """Rows that came out of the ORC scan of ids."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().executedPlan().collectLeaves()
    out = []
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        for plan in (leaf, leaf.plan()) if "QueryStage" in leaf.getClass().getName() else (leaf,):
            scans = plan.collectLeaves()
            out += [scans.apply(i).metrics().apply("numOutputRows").value() for i in range(scans.size()) if "id#" in scans.apply(i).toString() and "Scan" in scans.apply(i).nodeName()]
    return max(out)


def test_stripes_indexes_and_bloom_filters(spark, tmp_path):
    df = spark.range(20000).select((F.col("id") * 10).alias("doc_id"), F.concat_ws(" ", F.lit("text of"), *(F.sha2(F.concat(F.col("id").cast("string"), F.lit(k)), 256) for k in ("a", "b"))).alias("text"))
    idfiles.write_ids(df.coalesce(1), f"{tmp_path}/x", PATH, stripe_bytes=100_000, index_rows=1000)
    files = glob.glob(f"{tmp_path}/x/ids/*.orc")
    assert max(orc.ORCFile(f).nstripes for f in files) > 1
    read = idfiles.read_ids(spark, f"{tmp_path}/x")
    assert read.where("doc_id % 10 <> 0").count() == 0 and read.count() == 20000
    present = idfiles.read_ids(spark, f"{tmp_path}/x", wanted=[100_000])
    assert [r.doc_id for r in present.collect()] == [100_000]
    # within the range of every file's ids, but in none: only a Bloom filter can tell
    assert rows_scanned(idfiles.read_ids(spark, f"{tmp_path}/x", wanted=[100_001])) < 20000
    assert idfiles.read_ids(spark, f"{tmp_path}/x", wanted=[]).count() == 0
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
        assert spark.read.orc(f"{tmp_path}/x/ids").select(F.spark_partition_id().alias("p")).distinct().count() > len(files)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_running_total_over_many_parts(spark):
    parts = spark.range(3000).select((F.col("id") * 3).cast("int").alias("part"), (F.col("id") % 7).alias("n"))
    got = {r.part: r.start for r in idfiles.running_total(parts, "part", "n", "start").collect()}
    total = 0
    for i in range(3000):
        assert got[3 * i] == total
        total += i % 7
