"""Quantiles: exact Hazen ranks over all rows, and a mergeable digest."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.plans.ranking import positions, small
from gristmill.session import ship

# --- exact ---------------------------------------------------------------------------------------


def quantiles(df: DataFrame, value: str, qs: list[float], by: list[str] | None = None) -> DataFrame:
    """(by, q, value): the Hazen quantile: with h = q N + 1/2, x_floor(h) + frac(h) (x_floor(h)+1 - x_floor(h)),
    held to the first and the last value. AssertionError unless every q is in [0, 1].

    Values are ranked over the whole cluster (no group is sorted by one task); only the ranks that a q
    needs leave the ranked table. Null values are skipped.
    """
    for q in qs:
        assert 0 <= q <= 1, "q must be in [0, 1]"
    by = by or []
    ranked = positions(df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("x")), ["x"], by, "r")
    n = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    asked = n.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs]))).withColumn("h", F.col("q") * F.col("n") + 0.5)
    asked = asked.withColumn("lo", F.greatest(F.lit(1), F.least("n", F.floor("h")))).withColumn("hi", F.least("n", F.floor("h") + 1))
    asked = asked.withColumn("want", F.explode(F.array_distinct(F.array("lo", F.greatest("lo", "hi")))))
    right = small(asked.select(*[F.col(c).alias(f"a_{c}") for c in by], "q", "h", "n", "lo", "want"))
    on = F.col("r") + 1 == F.col("want")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"a_{c}"))
    got = ranked.join(right, on).groupBy(*by, "q", "h", "n").agg(F.min("x").alias("a"), F.max("x").alias("z"))
    inner = F.col("a") + (F.col("h") - F.floor("h")) * (F.col("z") - F.col("a"))
    held = F.when(F.col("h") <= 1, F.col("a")).when(F.col("h") >= F.col("n"), F.col("z")).otherwise(inner)
    return got.select(*by, "q", held.alias("value"))


def summary(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, count, min, max, mean, p50, p90, p95, p99), all but the count null where no value is."""
    at = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    q = quantiles(df, value, list(at.values()), by).groupBy(*by).agg(
        *[F.max(F.when(F.col("q") == v, F.col("value"))).alias(k) for k, v in at.items()]
    )
    q = q.select(*[F.col(c).alias(f"q_{c}") for c in by], *at)
    base = df.groupBy(*by).agg(F.count(value).alias("count"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"))
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"q_{c}"))
    return base.join(q, on, "left").select(*by, "count", "min", "max", "mean", *at)


def cdf(df: DataFrame, value: str, probes: list[float]) -> DataFrame:
    """(x, cdf, rank) of each probe over the values: 0 below the least, 1 from the greatest on, else between the
    centres (i - 1/2) / N of the values next to it; within ties the last centre. One aggregate, no sort."""
    x = F.col(value).cast("double")
    aggs = [F.count(x).alias("n"), F.min(x).alias("least"), F.max(x).alias("most")]
    for i, p in enumerate(probes):
        aggs += [
            F.count(F.when(x <= p, 1)).alias(f"le{i}"), F.max(F.when(x <= p, x)).alias(f"lo{i}"), F.min(F.when(x > p, x)).alias(f"hi{i}"),
        ]
    one = df.agg(*aggs)
    each = [
        F.struct(F.lit(float(p)).alias("x"), F.col(f"le{i}").alias("le"), F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi"))
        for i, p in enumerate(probes)
    ]
    e = one.select("n", "least", "most", F.explode(F.array(*each)).alias("e")).select("n", "least", "most", "e.*")
    between = (F.col("le") - 0.5 + (F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo"))) / F.col("n")
    c = F.when((F.col("n") == 0) | (F.col("x") < F.col("least")), 0.0).when(F.col("x") >= F.col("most"), 1.0).otherwise(between)
    return e.select("x", c.alias("cdf"), "n").select("x", "cdf", (F.col("cdf") * F.col("n")).alias("rank"))


# --- mergeable digest ------------------------------------------------------------------------------

#: Groups whose digests a task holds at a time.
HELD = 10_000
CENTROIDS = "array<struct<mean:double,weight:double>>"


def _checked(alpha: float) -> float:
    assert alpha > 0, "alpha must be positive"
    return alpha


def compress(means: np.ndarray, weights: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Centroids merged from left to right while a centroid spans at most one unit of the scale
    alpha / 2 pi * asin(2 q - 1): small at the tails, large in the middle. Weight is preserved."""
    order = np.argsort(means, kind="stable")
    m, w = means[order], weights[order]
    if len(m) < 2:
        return m, w
    total = w.sum()
    scale = alpha / (2 * math.pi) * np.arcsin(np.clip(2 * np.cumsum(w) / total - 1, -1, 1))
    start = alpha / (2 * math.pi) * math.asin(-1)
    group, k, edge = np.zeros(len(m), np.int64), 0, start
    for i in range(len(m)):
        if i and scale[i] - edge > 1:
            k, edge = k + 1, scale[i - 1]
        group[i] = k
    total_w = np.bincount(group, w)
    return np.bincount(group, m * w) / total_w, total_w


def centre_quantile(means: list[float], weights: list[float], q: float, least: float, most: float) -> float:
    """The quantile of a digest: linear between centroid centres, the tails towards least and most."""
    assert 0 <= q <= 1 and means, "q must be in [0, 1] and the digest not empty"
    if q in (0, 1) or len(means) == 1:
        return least if q == 0 else most if q == 1 else means[0]
    w = np.array(weights, float)
    centres = np.cumsum(w) - w / 2
    return float(np.interp(q * w.sum(), [0, *centres, w.sum()], [least, *means, most]))


def digest(df: DataFrame, value: str, by: list[str], alpha: float = 100.0, weight: str | None = None) -> DataFrame:
    """(by, centroids, total, least, most): a digest of about alpha / 2 centroids for each group.

    Every task digests its own rows in batches; only centroids are shuffled, and a group's partial
    digests are merged by one task: (tasks x alpha) rows at most, however many rows the group has.
    """
    ship(df.sparkSession)
    _checked(alpha)
    rows = df.where(F.col(value).isNotNull()).select(
        F.to_json(F.struct(*by)).alias("k"), F.col(value).cast("double").alias("x"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w")
    )

    def made(held: dict[str, tuple]) -> pa.RecordBatch:
        ks, ms, ws, ls, hs = [], [], [], [], []
        for k, (m, w, lo, hi) in held.items():
            ks += [k] * len(m)
            ms += m.tolist()
            ws += w.tolist()
            ls += [lo] * len(m)
            hs += [hi] * len(m)
        return pa.RecordBatch.from_arrays([pa.array(ks), pa.array(ms), pa.array(ws), pa.array(ls), pa.array(hs)], ["k", "mean", "weight", "least", "most"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple] = {}
        for batch in batches:
            t = batch.to_pandas()
            for k, g in t.groupby("k"):
                m, w = g["x"].to_numpy(), g["w"].to_numpy()
                lo, hi = m.min(), m.max()
                if k in held:
                    a, b, c, d = held[k]
                    m, w, lo, hi = np.concatenate([a, m]), np.concatenate([b, w]), min(lo, c), max(hi, d)
                held[k] = (*compress(m, w, alpha), lo, hi)
            if len(held) > HELD:  # a task of many groups hands its partial digests on; they are merged like any others
                yield made(held)
                held = {}
        if held:
            yield made(held)
    parts = rows.mapInArrow(partial, "k string, mean double, weight double, least double, most double")

    return _merged(parts, {c: df.schema[c].dataType.simpleString() for c in by}, alpha)


def merge(*digests: DataFrame, by: list[str], alpha: float = 100.0) -> DataFrame:
    """One digest of each group from several; the sources are left as they are, weights add up."""
    _checked(alpha)
    every = digests[0]
    for d in digests[1:]:
        every = every.unionByName(d)
    rows = every.select(F.to_json(F.struct(*by)).alias("k"), "least", "most", F.explode("centroids").alias("c"))
    parts = rows.select("k", "c.mean", "c.weight", "least", "most")
    return _merged(parts, {c: every.schema[c].dataType.simpleString() for c in by}, alpha)


def _merged(parts: DataFrame, kinds: dict[str, str], alpha: float) -> DataFrame:
    """Digests from rows (k, mean, weight, least, most), k being the group as JSON."""

    def work(key, t):
        m, w = compress(t["mean"].to_numpy(), t["weight"].to_numpy(), alpha)
        kind = pa.list_(pa.struct([("mean", pa.float64()), ("weight", pa.float64())]))
        cents = pa.array([[{"mean": float(a), "weight": float(b)} for a, b in zip(m, w)]], kind)
        return pa.table({"k": [key[0].as_py()], "centroids": cents, "total": [float(w.sum())], "least": [min(t["least"].to_pylist())], "most": [max(t["most"].to_pylist())]})

    merged = parts.groupBy("k").applyInArrow(work, f"k string, centroids {CENTROIDS}, total double, least double, most double")
    schema, by = ", ".join(f"`{c}` {k}" for c, k in kinds.items()), list(kinds)
    return merged.select(*([F.from_json("k", schema).getField(c).alias(c) for c in by]), "centroids", "total", "least", "most")


def digest_quantile(q: float, centroids: Column | str = "centroids") -> Column:
    """centre_quantile as an expression over a digest's columns (centroids, total, least, most)."""
    assert 0 <= q <= 1, "q must be in [0, 1]"
    return F.expr(
        f"""CASE WHEN size({centroids}) = 0 THEN null WHEN {q} = 0 THEN least WHEN {q} = 1 THEN most WHEN size({centroids}) = 1 THEN {centroids}[0].mean
        ELSE aggregate(concat({centroids}, array(struct(most AS mean, 0D AS weight))),
          struct(0D AS seen, 0D AS at, least AS mean, cast(null AS double) AS out),
          (s, c) -> struct(s.seen + c.weight AS seen, s.seen + c.weight / 2 AS at, c.mean AS mean,
            coalesce(s.out, CASE WHEN {q} * total <= s.seen + c.weight / 2 THEN
              CASE WHEN s.seen + c.weight / 2 = s.at THEN c.mean ELSE s.mean + ({q} * total - s.at) / (s.seen + c.weight / 2 - s.at) * (c.mean - s.mean) END END) AS out),
          s -> coalesce(s.out, most)) END"""
    )


def native_quantiles(df: DataFrame, value: str, qs: list[float], by: list[str]) -> DataFrame:
    """The engine's own approximate percentiles, for speed."""
    return df.groupBy(*by).agg(F.percentile_approx(value, qs, 10_000).alias("values"))
