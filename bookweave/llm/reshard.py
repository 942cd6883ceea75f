"""Resharding by minimum-cost flow.

Old shard sizes are supplies, new capacities demands; an arc costs one unit per byte that
changes its shard. The flow says how many bytes go from each old shard to each new one;
blocks of rows are then dealt out to fill it. Only shards that gain or lose a block are
written again.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookweave.llm.columns import fresh

#: Blocks of each old shard, by the hash of the row's group.
BUCKETS = 512
#: A block of more than 1/COARSE of a new shard is split by group into SPLITS parts.
COARSE, SPLITS = 128, 64


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """flow[i][j] of least total cost that ships every supply within the capacities.

    Successive shortest paths with potentials; costs are not negative and
    sum(supply) <= sum(capacity).
    """
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("capacities are smaller than the supplies")
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    potential = [0] * (n + m)
    inf = float("inf")
    while any(left):
        dist, came = [inf] * (n + m), [-1] * (n + m)
        heap = []
        for i in range(n):
            if left[i]:
                dist[i] = 0
                heapq.heappush(heap, (0, i))
        while heap:
            d, x = heapq.heappop(heap)
            if d > dist[x]:
                continue
            if x < n:
                steps = ((n + j, cost[x][j]) for j in range(m))
            else:
                steps = ((i, -cost[i][x - n]) for i in range(n) if flow[i][x - n])
            for y, c in steps:
                e = d + c + potential[x] - potential[y]
                if e < dist[y]:
                    dist[y], came[y] = e, x
                    heapq.heappush(heap, (e, y))
        end = min((n + j for j in range(m) if room[j]), key=lambda y: dist[y] + potential[y])
        far = max(d for d in dist if d < inf)
        potential = [p + min(d, far) for p, d in zip(potential, dist, strict=True)]
        path = [end]
        while came[path[-1]] >= 0:
            path.append(came[path[-1]])
        path.reverse()
        amount = min(left[path[0]], room[end - n])
        for x, y in zip(path, path[1:], strict=False):
            if x >= n:
                amount = min(amount, flow[y][x - n])
        for x, y in zip(path, path[1:], strict=False):
            if x < n:
                flow[x][y - n] += amount
            else:
                flow[y][x - n] -= amount
        left[path[0]] -= amount
        room[end - n] -= amount
    return flow


def plan_blocks(blocks: list[tuple[tuple, int, int]], flow: list[list[int]]) -> dict[tuple, int]:
    """The new shard of each block (key, old shard, bytes): large blocks first, each to where most of its shard's flow is left."""
    rest = [list(f) for f in flow]
    out = {}
    for key, old, size in sorted(blocks, key=lambda b: (-b[2], b[0])):
        to = max(range(len(rest[old])), key=lambda j: (rest[old][j], j == old, -j))
        out[key] = to
        rest[old][to] -= size
    return out


def reshard(rows: DataFrame, old: Column, n_old: int, n_new: int, size: str, group: Column, row_id: str, capacity: list[int] | None = None) -> DataFrame:
    """rows with old_shard, shard and slot, moving the fewest bytes to n_new shards.

    size: a column of bytes, not null. old: the present shard, 0 to n_old - 1. group: a hash,
    not null; rows of a group share a block and so a shard, unless the group alone is larger
    than 1/COARSE of a shard: then it is dealt by row_id. Blocks of more than that are split
    by group. capacity: bytes per new shard, else even. Slots run from 0 in each shard
    without gaps, by block and then by row_id, nulls first; repeated rows have slots of
    their own. Columns named old_shard, shard or slot are replaced; all others stay,
    whatever their names. No rows give no rows.

    The driver holds one total per block: at most n_old * BUCKETS, SPLITS more for each of
    the at most 2 * COARSE * n_new that are split, and as many for large groups, whatever
    the number of rows.
    """
    spark = rows.sparkSession
    made = ("old_shard", "shard", "slot")
    rows = rows.drop(*made)
    b, g, large, parts, piece, own, first = fresh([*rows.columns, *made], "block", "group", "large", "parts", "piece", "own", "first")
    kept = rows.columns
    rows = rows.withColumns({"old_shard": old.cast("int"), g: group.cast("long")}).withColumn(b, F.pmod(g, F.lit(BUCKETS)).cast("int"))
    sums = (F.sum(F.col(f"`{size}`")).alias("bytes"), F.count(F.lit(1)).alias("n"))
    totals = rows.groupBy("old_shard", b).agg(*sums).collect()  # a row per block
    all_bytes, all_rows = sum(t.bytes for t in totals), sum(t.n for t in totals)
    over = lambda t: t.n > 1 and max(t.bytes * COARSE * n_new / max(all_bytes, 1), t.n * COARSE * n_new / max(all_rows, 1)) > 1
    split = [(t.old_shard, t[b]) for t in totals if over(t)]
    marks = F.broadcast(spark.createDataFrame([(*x, True) for x in split], f"old_shard int, `{b}` int, `{large}` boolean"))
    rows = rows.join(marks, ["old_shard", b], "left")
    least = F.greatest(F.col("bytes") * COARSE * n_new / max(all_bytes, 1), F.col("n") * COARSE * n_new / max(all_rows, 1))
    heavy = rows.where(large).groupBy("old_shard", g).agg(*sums).where((least > 1) & (F.col("n") > 1)).select("old_shard", g, F.ceil(least).cast("int").alias(parts)) if split else None
    hot = heavy.collect() if split else []  # at most 2 * COARSE * n_new groups are that large
    rows = rows.join(F.broadcast(spark.createDataFrame([tuple(h) for h in hot], f"old_shard int, `{g}` long, `{parts}` int")), ["old_shard", g], "left")
    by_row = F.pmod(F.xxhash64(F.lit("row"), F.col(f"`{row_id}`")), F.col(parts).cast("long"))
    by_group = -2 - F.pmod(F.xxhash64(F.lit("part"), F.col(g)), F.lit(SPLITS).cast("long"))
    rows = rows.withColumns({piece: F.when(F.col(parts).isNotNull(), by_row).when(F.col(large), by_group).otherwise(F.lit(-1).cast("long")), own: F.when(F.col(parts).isNotNull(), F.col(g)).otherwise(F.lit(0).cast("long"))})
    key = ["old_shard", b, piece, own]
    blocks = {(t.old_shard, t[b], -1, 0): (t.bytes, t.n) for t in totals if not over(t)}
    if split:
        blocks |= {(t.old_shard, t[b], t[piece], t[own]): (t.bytes, t.n) for t in rows.where(large).groupBy(*key).agg(*sums).collect()}  # a row per block
    if capacity is None:
        capacity = [all_bytes // n_new + (j < all_bytes % n_new) for j in range(n_new)]
    supply = [0] * n_old
    for (i, *_), (size_, _) in blocks.items():
        supply[i] += size_
    cost = [[int(i != j) for j in range(n_new)] for i in range(n_old)]
    to = plan_blocks([(k, k[0], size_) for k, (size_, _) in blocks.items()], min_cost_flow(supply, capacity, cost))
    placed, filled = [], [0] * n_new
    for k in sorted(to):
        placed.append((*k, to[k], filled[to[k]]))
        filled[to[k]] += blocks[k][1]
    plan = F.broadcast(spark.createDataFrame(placed, f"old_shard int, `{b}` int, `{piece}` long, `{own}` long, shard int, `{first}` long"))
    within = Window.partitionBy(*key).orderBy(F.col(f"`{row_id}`"))
    out = rows.join(plan, key).withColumn("slot", F.col(first) + F.row_number().over(within) - 1)
    return out.select(*(F.col(f"`{c}`") for c in kept), *made)


def rewrite_affected(placed: DataFrame, path: str, size: str = "size", task_bytes: int = 128 << 20) -> list[int]:
    """Write the shards that gain or lose rows below path, one folder each; returns their numbers, at most one per shard.

    Shards that stay as they are get no file here, and keep the one that they have. A shard
    is written by a task for every task_bytes of it, by the column size, so a large one is
    no long task; its rows are in the order of their slots within each file. Null sizes
    count as nothing, repeated rows are written again, and no rows write nothing.
    """
    moved = placed.where("old_shard <> shard").select(F.explode(F.array("old_shard", "shard")).alias("x")).distinct()
    affected = sorted(r.x for r in moved.collect())
    rows = placed.where(F.col("shard").isin(affected))
    totals = {r.shard: r.bytes or 0 for r in rows.groupBy("shard").agg(F.sum(F.col(f"`{size}`")).alias("bytes")).collect()}  # a row per shard
    if not totals:
        return affected
    tasks = {j: max(1, -(-n // task_bytes)) for j, n in totals.items()}
    share = F.pmod(F.col("slot"), F.element_at(F.create_map(*(F.lit(x) for kv in tasks.items() for x in kv)), F.col("shard")))
    rows.repartition(sum(tasks.values()), "shard", share).sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)
    return affected
