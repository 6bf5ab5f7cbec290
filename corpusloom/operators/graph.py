"""Connected components of an undirected graph given by its edges."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusloom.plans.staging import discard, stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: neighbours are re-linked to the least node of a node's neighbourhood.

    The large step moves neighbours greater than the node, the small step those not
    greater.  The minimum is a partial aggregate and is joined back, so no task ever
    holds the neighbours of a hub.
    """
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    around = both if large else both.where("b < a")
    least = around.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    linked = around.join(least, F.col("a") == F.col("n"))
    if large:
        moved = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select(F.col("n").alias("a"), F.col("m").alias("b"))
        )
    return moved.where("a <> b").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Label every node of ``edges`` with the least node of its component: ``(node, component)``.

    Alternates large-star and small-star steps until the edges form stars around the
    least nodes; each round is staged, so the plan stays short and a lost executor costs
    one round.  Edges with a null end and self-loops give no link (a node with only a
    self-loop is its own component); repeated edges count once; an empty table gives none.
    """
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    lonely = ends.where("a = b").select(F.col("a").alias("node")).distinct()
    state = stage(
        ends.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    mark = None
    for _ in range(max_rounds):
        before, state = state, stage(_star(_star(state, large=True), large=False))
        discard(before)  # the rounds leave one table each at a time
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    labels = state.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = state.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    found = labels.union(roots)
    alone = lonely.join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.union(alone)
