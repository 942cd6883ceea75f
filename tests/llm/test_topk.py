import math
import random

from pyspark.sql import functions as F

from bookweave.llm import topk
from bookweave.llm.queries import op7_top_k


def brute(queries, rows, k):
    out = set()
    for qi, q in queries:
        best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), i) for i, v in rows if i != qi and len(v) == len(q))[:k]
        out |= {(qi, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


def rows_of(n, seed, dims=5, top=3):
    rng = random.Random(seed)
    return [(i, [rng.randint(-top, top) for _ in range(dims)]) for i in range(n)]


def test_search_equals_brute_force_with_ties_and_blocks(spark, monkeypatch):
    rows = rows_of(400, 3) + [(1000 + i, [1, 1, 1, 1, 1]) for i in range(60)] + [(2000, [1, 2]), (2001, [3, 4])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>").withColumn("score", F.lit("x")).repartition(7)
    queries = [r for r in rows if r[0] % 100 == 0]
    want = brute(queries, rows, 10)
    for size in (1 << 20, 80):
        monkeypatch.setattr(topk, "BLOCK_BYTES", size)
        got = topk.search(df.where("vec_id % 100 = 0"), df, 10)
        assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()} == want
        if size > 80:
            monkeypatch.setattr(topk, "TILE_ROWS", 16)
            monkeypatch.setattr(topk, "FAN", 2)


def test_large_products_stay_exact(spark):
    rows = [(i, [(1 << 29) + i, -(1 << 28) + 7 * i]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    got = topk.search(df.where("vec_id = 0"), df, 4)
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()} == brute(rows[:1], rows, 4)


def test_query_on_odd_vectors(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(205)]
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0]), (302, [1.0, math.nan, 0.0, 0.0]), (400, [math.inf, 0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0]), (7, rows[7][1]), (500, [])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/a/embeddings.parquet")
    stored = spark.read.parquet(f"{tmp_path}/a/embeddings.parquet").collect()
    good = [(r.vec_id, [math.floor(1024 * x) for x in r.embedding]) for r in stored if r.vec_id is not None and r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding)]
    got = op7_top_k(spark, f"{tmp_path}/a").collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == brute([g for g in good if g[0] % 100 == 0], good, 10)
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/b/embeddings.parquet")
    assert op7_top_k(spark, f"{tmp_path}/b").count() == 0
