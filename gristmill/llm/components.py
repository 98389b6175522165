"""Connected components over edges (native): alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over edges (a > b). Every node's least neighbour is found by a partial aggregate and joined
    back, so a node of any degree is split over tasks (the join is one that skew handling can split)."""
    if large:
        pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    # Cut, so that the join has an exchange of its own on either side and its hot partitions can be split.
    least = cut(pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")))
    met = pairs.join(least, F.col("u") == F.col("w"))
    moved = met.where("v > u" if large else "v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = moved.union(least.select(F.col("w").alias("a"), F.col("m").alias("b")))
    return moved.where("a > b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for every node of an undirected edge list the least node that it can reach.

    Null ends and loops make no edge; a node of no other edge is not returned. Each pair of rounds is
    checkpointed; they end when the edges, then stars around the roots, no longer change.
    """
    x, y = F.col(a), F.col(b)
    now = cut(
        edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()
    )

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    old, new = None, state(now)
    while new != old and new[0]:
        now = cut(_star(_star(now, True), False))
        old, new = new, state(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())
