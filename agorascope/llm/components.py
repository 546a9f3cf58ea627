"""Connected components by alternating stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agorascope.settings import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. Large: each node's larger neighbours go to the least of it and its
    neighbours. Small: the same for the node and its smaller neighbours."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return moved.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) to (node, component): the least node reachable, for each node with an edge.

    Each round is cut with checkpoint(); the number of rounds is logarithmic. Loops and repeated
    edges are harmless.
    """
    state = cut(edges.select("a", "b").where("a != b").distinct())
    seen = None
    while True:
        mark = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen or mark.n == 0:
            break
        seen = mark
        state = cut(_star(_star(state, True), False))
    # all edges now lead to the least node of their component
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
