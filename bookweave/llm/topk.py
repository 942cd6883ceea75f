"""Exact top-k search by tiled matrix products.

Queries are taken in blocks of bounded size, each broadcast in turn. A task multiplies a
block with one tile of its candidates after another and keeps k per query; the lists of
the tasks are merged in a tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookweave.plans.scratch import stage_table

#: Bytes of query vectors that are broadcast at once.
BLOCK_BYTES = 32 << 20
#: Queries and candidates of one matrix product.
TILE_QUERIES, TILE_ROWS = 512, 2048
#: Lists that are merged at once, by task, before the last merge.
FAN = 64


def usable(vector: Column) -> Column:
    """True for vectors that are not null and hold finite numbers alone."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def quantise(vector: Column, scale: int = 1024) -> Column:
    """Each component x, as double, becomes floor(scale * x)."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the k highest scores, ties to the smaller id; ids has score's shape or one row. A score of the lowest int is absent."""
    ids = np.broadcast_to(ids, score.shape)
    if score.shape[1] > 4 * k:  # a row's k-th score bounds what can be in its list
        bound = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k, None]
        width = int((score >= bound).sum(axis=1).max())
        if width < score.shape[1]:
            pick = np.argsort(score < bound, axis=1, kind="stable")[:, :width]
            score, ids = np.take_along_axis(score, pick, 1), np.take_along_axis(ids, pick, 1)
    order = np.lexsort((ids, -score), axis=1)[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where these hold them, else in 64-bit integers."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if top < 2**53:
        return (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    return q @ c.T


def _merge(parts: DataFrame, k: int, *keys: Column) -> DataFrame:
    """The k best of each query's lists, by the groups of keys."""
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)
    return parts.groupBy("query_id", *keys).agg(best.alias("best"))


def search(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k highest inner products.

    queries and candidates: vec_id long, vector array<long>. A query meets every candidate
    of its own length but those of its own vec_id; ties go to the smaller vec_id. Fewer
    candidates give fewer rows. Rows whose vec_id or vector is null take no part; a vec_id
    that is repeated among the candidates can come up once for each of its rows. Other
    columns are left out. Products must stay below 2**63.
    """
    spark = queries.sparkSession
    queries = queries.select("vec_id", "vector").where("vec_id is not null and vector is not null").distinct()
    candidates = candidates.select("vec_id", "vector").where("vec_id is not null and vector is not null")
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("vector") + 1).alias("x")).first()
    blocks = max(1, -(-8 * (size.x or 0) // BLOCK_BYTES))
    parts = []
    for b in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id")
        rows = block.collect()  # a block: about BLOCK_BYTES
        if sum(len(r.vector) + 1 for r in rows) * 8 > 4 * BLOCK_BYTES:
            raise ValueError("a block of queries is larger than its bound")
        by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in {len(r.vector) for r in rows}:
            own = [r for r in rows if len(r.vector) == n]
            by_length[n] = np.array([r.vec_id for r in own], np.int64), np.array([r.vector for r in own], np.int64).reshape(len(own), n)
        part = candidates.mapInArrow(_tiles(spark.sparkContext.broadcast(by_length), k), "query_id long, task long, vec_id long, score long")
        parts.append(stage_table(part, "topk") if blocks > 1 else part)
    lists = parts[0]
    for part in parts[1:]:
        lists = lists.unionByName(part)
    some = _merge(lists, k, F.floor(F.col("task") / FAN).alias("g")).select("query_id", F.explode("best").alias("x"))
    merged = _merge(some.select("query_id", F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score")), k)
    return merged.select("query_id", F.posexplode("best").alias("rank", "x")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score")
    )


def _tiles(shared, k: int):
    absent = np.iinfo(np.int64).min // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {n: (np.full((len(q), k), absent), np.zeros((len(q), k), np.int64)) for n, (q, _) in shared.value.items()}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            column = batch.column(1)
            values, ends = column.flatten().to_numpy(), np.cumsum([0, *column.value_lengths().to_pylist()])
            lengths = np.diff(ends)
            for n in set(lengths.tolist()) & set(held):
                rows = np.flatnonzero(lengths == n)
                qid, q = shared.value[n]
                for c in range(0, len(rows), TILE_ROWS):
                    tile = rows[c : c + TILE_ROWS]
                    matrix = values[ends[tile][:, None] + np.arange(n)].reshape(len(tile), n)
                    for a in range(0, len(qid), TILE_QUERIES):
                        z = slice(a, a + TILE_QUERIES)
                        score = _product(q[z], matrix)
                        score[qid[z, None] == ids[tile]] = absent
                        s, i = _best(score, ids[tile], k)
                        held[n][0][z], held[n][1][z] = _best(np.hstack([held[n][0][z], s]), np.hstack([held[n][1][z], i]), k)
        task = TaskContext.get().partitionId()
        for n, (s, i) in held.items():
            r, c = np.nonzero(s > absent)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shared.value[n][0][r]), pa.array(np.full(len(r), task)), pa.array(i[r, c]), pa.array(s[r, c])],
                names=["query_id", "task", "vec_id", "score"],
            )

    return run


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
