"""Connected components by repeated contraction, for graphs larger than one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookweave.plans.scratch import discard, stage_table


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node on an edge; component is the smallest node it reaches.

    edges: two columns of one orderable type. Null ends and loops are ignored; repeated and
    reversed edges are allowed. No edges gives no rows.

    A round maps every node to the smallest node among itself and its neighbours. These maps
    form trees that lead to smaller nodes; each node then jumps to its parent's parent until
    all point at their roots, which halves the depth at every jump, and the graph is
    contracted to the roots. After the contraction every edge has a root that was the smallest
    neighbour of a node that is gone, so nodes at least halve in two rounds: rounds, and jumps
    within a round, grow with the logarithm of the nodes, for chains too. Each table is written
    to the shared scratch folder and dropped when the next is. Hot nodes are safe: minima are pre-aggregated and the
    joins on a node are plain equi-joins that adaptive execution can split.
    """
    left = (
        edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") < F.col("b")))
        .distinct()
    )
    left = stage_table(left, "edges")
    labels = None
    while left.limit(1).count():
        ends = left.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            left.select(F.col("b").alias("node"), F.col("a").alias("other"))
        )
        step = ends.groupBy("node").agg(F.min("other").alias("o")).select("node", F.least("node", "o").alias("to"))
        step = _to_roots(stage_table(step, "contract"))
        moved = (
            left.join(step.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a")
            .join(step.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
            .where("a < b")
            .distinct()
        )
        before, left = left, stage_table(moved, "edges")
        discard(before)
        if labels is None:
            labels = step
        else:
            nxt = step.select(F.col("node").alias("to"), F.col("to").alias("far"))
            before = labels
            labels = stage_table(labels.join(nxt, "to", "left").select("node", F.coalesce("far", "to").alias("to")), "labels")
            discard(before, step)
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.select("node", F.col("to").alias("component"))


def _to_roots(step: DataFrame) -> DataFrame:
    """(node, to) with `to` at the root of each node's tree; step is a staged table, and so is the result."""
    while True:
        far = step.select(F.col("node").alias("to"), F.col("to").alias("far"))
        jumped = stage_table(step.join(far, "to").select("node", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("moved")), "contract")
        discard(step)
        deep = jumped.where("moved").limit(1).count()
        step, path = jumped.drop("moved"), jumped.staged_at
        step.staged_at = path
        if not deep:
            return step
