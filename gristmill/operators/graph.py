"""Undirected graphs as edge rows (u, v), both ways."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.session import cut


def from_edges(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(u, v) both ways, distinct; rows with a null end are left out. ValueError unless both columns exist."""
    if u not in edges.columns or v not in edges.columns:
        raise ValueError("an edge needs two ends")
    e = edges.where(F.col(u).isNotNull() & F.col(v).isNotNull()).select(F.col(u).alias("u"), F.col(v).alias("v"))
    return e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def vertices(graph: DataFrame, alone: DataFrame | None = None) -> DataFrame:
    """(v): all ends of edges, and the vertices given without one."""
    out = graph.select(F.col("u").alias("v"))
    return (out.union(alone.select("v")) if alone is not None else out).distinct()


def remove_vertex(graph: DataFrame, vertex) -> DataFrame:
    return graph.where((F.col("u") != vertex) & (F.col("v") != vertex))


def remove_edge(graph: DataFrame, a, b) -> DataFrame:
    return graph.where(~(((F.col("u") == a) & (F.col("v") == b)) | ((F.col("u") == b) & (F.col("v") == a))))


def edge_exists(graph: DataFrame, a, b) -> DataFrame:
    return graph.where((F.col("u") == a) & (F.col("v") == b)).agg((F.count(F.lit(1)) > 0).alias("found"))


def neighbours(graph: DataFrame, vertex) -> DataFrame:
    return graph.where(F.col("u") == vertex).select("v").distinct()


def degree(graph: DataFrame) -> DataFrame:
    return graph.groupBy("u").agg(F.count("v").alias("degree"))


def hops(graph: DataFrame, source, limit: int | None = None, goal=None) -> DataFrame:
    """(v, hops) of every vertex that source reaches, itself included, by breadth: a join and an anti-join a
    round, each cut. Rounds end when the frontier is empty, or holds the goal."""
    graph = cut(graph)
    spark = graph.sparkSession
    kind = graph.schema["u"].dataType.simpleString()
    seen = frontier = cut(spark.range(1).select(F.lit(source).cast(kind).alias("v"), F.lit(0).cast("bigint").alias("hops")))
    k = 0
    while limit is None or k < limit:
        k += 1
        step = graph.join(frontier.select(F.col("v").alias("f")), F.col("u") == F.col("f")).select("v").distinct()
        frontier = cut(step.join(seen.select("v"), "v", "left_anti").select("v", F.lit(k).cast("bigint").alias("hops")))
        if frontier.isEmpty():
            break
        seen = cut(seen.union(frontier))
        if goal is not None and not frontier.where(F.col("v") == goal).isEmpty():
            break
    return seen


def shortest_path(graph: DataFrame, a, b) -> DataFrame:
    """(hops) from a to b: 0 from any vertex to itself, known or not; -1 where there is no path."""
    if a == b:
        return graph.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("hops"))
    return hops(graph, a, goal=b).where(F.col("v") == b).agg(F.coalesce(F.max("hops"), F.lit(-1).cast("bigint")).alias("hops"))


def has_path(graph: DataFrame, a, b) -> DataFrame:
    return shortest_path(graph, a, b).select((F.col("hops") >= 0).alias("found"))
