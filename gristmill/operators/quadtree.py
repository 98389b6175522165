"""Quadtrees: the leaf of every point. A cell is split exactly when it holds more than max_points points, so
the tree is a function of the points alone, whatever order they came in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.plans.ranking import small
from gristmill.session import cut

#: Cells of this depth are not split further; equal points would be without end.
MAX_DEPTH = 30


def _checked(width: float, height: float, max_points: int) -> None:
    if not (width > 0 and height > 0 and isinstance(max_points, int) and max_points > 0):
        raise ValueError("width and height must be positive and max_points a positive integer")


def inside(points: DataFrame, width: float, height: float) -> DataFrame:
    """Points of the half-open box [0, width) x [0, height)."""
    return points.where("x >= 0 AND y >= 0").where((F.col("x") < width) & (F.col("y") < height))


def _cell(c: str, side: float, depth: int):
    return F.floor(F.col(c) / F.lit(side / (1 << depth))).cast("bigint")


def leaves(points: DataFrame, width: float, height: float, max_points: int, max_depth: int = MAX_DEPTH) -> DataFrame:
    """points with depth, cx, cy: the leaf that holds each, cx and cy counting cells of its depth. Points outside
    the box are left out. One aggregate a depth, over the points of crowded cells only."""
    _checked(width, height, max_points)
    rest = cut(inside(points, width, height))
    out = None
    for depth in range(max_depth + 1):
        here = rest.withColumns({"depth": F.lit(depth), "cx": _cell("x", width, depth), "cy": _cell("y", height, depth)})
        if depth == max_depth:
            return here if out is None else out.union(here)
        crowded = here.groupBy("cx", "cy").count().where(F.col("count") > max_points)
        crowded = small(crowded.select(F.col("cx").alias("kx"), F.col("cy").alias("ky"), F.lit(True).alias("split")))
        marked = cut(here.join(crowded, (F.col("cx") == F.col("kx")) & (F.col("cy") == F.col("ky")), "left").drop("kx", "ky"))
        done = marked.where("split IS NULL").drop("split")
        out = done if out is None else out.union(done)
        rest = marked.where("split").drop("split", "depth", "cx", "cy")
        if rest.isEmpty():
            break
    return out


def query(points: DataFrame, x: float, y: float, width: float, height: float, max_points: int, max_depth: int = MAX_DEPTH) -> DataFrame:
    """All points of the leaf that covers (x, y), which may be none; no rows outside the box."""
    _checked(width, height, max_points)
    rest = inside(points, width, height)
    if not (0 <= x < width and 0 <= y < height):
        return rest.limit(0)
    for depth in range(1, max_depth + 1):
        if rest.limit(max_points + 1).count() <= max_points:
            break
        w, h = width / (1 << depth), height / (1 << depth)
        rest = rest.where((F.floor(F.col("x") / w) == int(x // w)) & (F.floor(F.col("y") / h) == int(y // h)))
    return rest


def insert(points: DataFrame, new: DataFrame, width: float, height: float) -> DataFrame:
    """The points with those of new that lie in the box."""
    return points.unionByName(inside(new, width, height))


def delete(points: DataFrame, x: float, y: float) -> DataFrame:
    """Without every point at exactly (x, y); leaves are a function of what is left."""
    return points.where(~((F.col("x") == x) & (F.col("y") == y)))
