import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from bookweave.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
ROWS = [(1, "Hello world"), (2, None), (3, ""), (4, "a" * 3000), (5, "<|endoftext|> é漢​"), (5, "<|endoftext|> é漢​"), (None, "!?" * 500), (7, "\n\n  \t x")]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def test_codec_equals_library(library):
    codec = bpe.BpeCodec(bpe.load_ranks(PATH), P.PATTERN)
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "be", "é", "\n", " ", "12", "漢", "!!!", "'s", "xx"]) for _ in range(rng.randint(0, 300))) for _ in range(200)]
    texts += ["z" * 70000, "#$" * 4000]
    for text, ids in zip(texts, codec.encode_many(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)
        assert codec.decode(ids.tolist()) == text.encode()


def test_cache_turnover_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    codec = bpe.BpeCodec(bpe.load_ranks(PATH), P.PATTERN)
    for text in ["one two three four", "two five six", "one seven"] * 3:
        assert codec.encode(text) == library.encode_ordinary(text)


def test_operator_round_trip(spark, library):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1))
    out = bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert len(out) == len(ROWS)
    for row in out:
        assert row.ids == library.encode_ordinary(row.text or "")
        assert bytes(row.decoded) == (row.text or "").encode()


def test_query_and_empty_table(spark, tmp_path, library):
    from bookweave.llm.queries import op9_byte_bpe

    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(f"{tmp_path}/a/documents.parquet")
    for row in op9_byte_bpe(spark, f"{tmp_path}/a").collect():
        text = next(t for d, t in ROWS if d == row.doc_id) or ""
        ids = library.encode_ordinary(text)
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert op9_byte_bpe(spark, f"{tmp_path}/b").count() == 0
