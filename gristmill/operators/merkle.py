"""Merkle trees as rows (level, idx, hash), the root at level 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.session import cut


def leaves(df: DataFrame, idx: str = "idx", content: str = "content") -> DataFrame:
    """(idx, hash): the hex SHA-256 of each content. idx must count 0, 1, 2, ... without gaps."""
    return df.select(F.col(idx).cast("bigint").alias("idx"), F.sha2(F.col(content), 256).alias("hash"))


def _parents(nodes: DataFrame) -> DataFrame:
    """The next level up: pairs meet in a partial aggregate; an odd last node is paired with itself."""
    up = nodes.groupBy(F.expr("idx div 2").alias("idx")).agg(F.min_by("hash", "idx").alias("l"), F.max_by("hash", "idx").alias("r"))
    return up.select("idx", F.sha2(F.concat("l", "r"), 256).alias("hash"))


def height(n: int) -> int:
    """Levels of a tree of n leaves."""
    return 0 if n == 0 else 1 + (n - 1).bit_length()


def build(df: DataFrame, idx: str = "idx", content: str = "content") -> DataFrame:
    """(level, idx, hash) of all nodes; without rows no node. One aggregate a level, each cut, of halving size."""
    nodes = cut(leaves(df, idx, content))
    n = nodes.count()
    if not n:
        return nodes.select(F.lit(0).alias("level"), "idx", "hash")
    out = []
    for level in range(height(n) - 1, -1, -1):
        out.append(nodes.select(F.lit(level).alias("level"), "idx", "hash"))
        if level:
            nodes = cut(_parents(nodes))
    return reduce(DataFrame.unionByName, out)


def root(tree: DataFrame) -> DataFrame:
    return tree.where("level = 0").select("hash")


def node(tree: DataFrame, level: int, idx: int) -> DataFrame:
    """The node's hash; no row out of range."""
    return tree.where((F.col("level") == level) & (F.col("idx") == idx)).select("hash")


def leaf_hashes(tree: DataFrame) -> DataFrame:
    deepest = tree.agg(F.max("level").alias("deepest"))
    return tree.join(F.broadcast(deepest), F.col("level") == F.col("deepest")).select("idx", "hash")


def widths(tree: DataFrame) -> DataFrame:
    return tree.groupBy("level").agg(F.count(F.lit(1)).alias("width"))


def equals(a: DataFrame, b: DataFrame) -> DataFrame:
    """(equal): whether both have a root and the roots are equal."""
    x, y = root(a).select(F.col("hash").alias("x")), root(b).select(F.col("hash").alias("y"))
    return x.join(y, F.col("x") == F.col("y")).agg((F.count(F.lit(1)) > 0).alias("equal"))


def diff_leaves(a: DataFrame, b: DataFrame, max_diffs: int | None = None) -> DataFrame:
    """(idx) of leaves (idx, hash) that differ or that one side lacks, in order, the first max_diffs."""
    x, y = a.select(F.col("idx").alias("i"), F.col("hash").alias("x")), b.select(F.col("idx").alias("j"), F.col("hash").alias("y"))
    out = x.join(y, F.col("i") == F.col("j"), "full").where(~F.col("x").eqNullSafe(F.col("y"))).select(F.coalesce("i", "j").alias("idx"))
    return out if max_diffs is None else out.orderBy("idx").limit(max(0, max_diffs))


def diff_nodes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(level, idx) of the nodes that differ or that one tree lacks, by their true level and index."""
    x = a.select(F.col("level").alias("la"), F.col("idx").alias("i"), F.col("hash").alias("x"))
    y = b.select(F.col("level").alias("lb"), F.col("idx").alias("j"), F.col("hash").alias("y"))
    met = x.join(y, (F.col("la") == F.col("lb")) & (F.col("i") == F.col("j")), "full").where(~F.col("x").eqNullSafe(F.col("y")))
    return met.select(F.coalesce("la", "lb").alias("level"), F.coalesce("i", "j").alias("idx"))


def first_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(level, idx) of the first differing node from the root on; (-1, -1) where the trees are equal."""
    first = F.min(F.struct("level", "idx"))
    return diff_nodes(a, b).agg(first.alias("f")).select(
        F.coalesce("f.level", F.lit(-1)).alias("level"), F.coalesce("f.idx", F.lit(-1).cast("bigint")).alias("idx")
    )


def set_leaf(tree: DataFrame, idx: int, content: str) -> DataFrame:
    """The tree with one leaf changed: only that leaf's path is computed anew. ValueError out of range."""
    tree = cut(tree)
    deepest = tree.agg(F.max("level")).first()[0]
    if deepest is None or node(tree, deepest, idx).isEmpty():
        raise ValueError("leaf index out of range")
    path = [(deepest, idx, tree.sparkSession.range(1).select(F.sha2(F.lit(content), 256)).first()[0])]
    for level in range(deepest, 0, -1):
        _, i, h = path[-1]
        beside = node(tree, level, i ^ 1).first()
        other = beside[0] if beside else h
        pair = (h, other) if i % 2 == 0 else (other, h)
        path.append((level - 1, i // 2, tree.sparkSession.range(1).select(F.sha2(F.lit("".join(pair)), 256)).first()[0]))
    new = tree.sparkSession.createDataFrame(path, "nl int, ni long, nh string")
    return tree.join(F.broadcast(new), (F.col("level") == F.col("nl")) & (F.col("idx") == F.col("ni")), "left").select(
        "level", "idx", F.coalesce("nh", "hash").alias("hash")
    )


def append(df: DataFrame, more: list[str], idx: str = "idx", content: str = "content") -> DataFrame:
    """The tree of df's leaves and the further ones after them."""
    n = df.count()
    new = df.sparkSession.createDataFrame([(n + k, c) for k, c in enumerate(more)], f"{idx} long, {content} string")
    return build(df.select(F.col(idx).cast("bigint").alias(idx), content).unionByName(new), idx, content)
