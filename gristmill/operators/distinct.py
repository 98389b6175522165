"""Approximate distinct counts: registers of 2^b buckets as rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.hashing import sha_int, typed


def _checked(b: int) -> int:
    if b < 1:
        raise ValueError("b must be 1 or more")
    if b > 30:
        raise ValueError("b must be 30 or less: 2 b bits are taken from 60")
    return b


def alpha(b: int) -> float:
    """The bias constant for 2^b registers."""
    return {16: 0.673, 32: 0.697, 64: 0.709}.get(m := 1 << _checked(b), 0.7213 / (1 + 1.079 / m))


def relative_error(b: int) -> float:
    return 1.04 / math.sqrt(1 << _checked(b))


def item_bits(item: str | Column, kind: str, b: int) -> tuple[Column, Column]:
    """(bucket, rho) of an item: the first b bits, and the leading zeros of the next b bits plus one."""
    h = sha_int(typed(item, kind))
    rest = F.shiftright(h, 60 - 2 * b).bitwiseAND((1 << b) - 1)
    rho = F.when(rest == 0, b + 1).otherwise(b + 1 - F.length(F.bin(rest)))
    return F.shiftright(h, 60 - b), rho.cast("int")


def registers(df: DataFrame, item: str, kind: str, b: int = 10, by: list[str] | None = None) -> DataFrame:
    """(by, bucket, rho): the greatest rho of each bucket that has an item; null items are skipped."""
    bucket, rho = item_bits(item, kind, _checked(b))
    return df.where(F.col(item).isNotNull()).groupBy(*(by or []), bucket.alias("bucket")).agg(F.max(rho).alias("rho"))


def union(*sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The sketch of all items of the sketches, which must have the same b."""
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return out.groupBy(*(by or []), "bucket").agg(F.max("rho").alias("rho"))


def harmonic(m: int) -> Column:
    """The sum of 2^-rho over all m registers; those without a row hold 0. Scaled by 2^40, the terms are integers and
    their sum is exact in any order."""
    scaled = F.lit(float(1 << 40)) / F.pow(F.lit(2.0), F.col("rho"))
    return F.coalesce(F.sum(scaled), F.lit(0.0)) / F.lit(float(1 << 40)) + (F.lit(m) - F.count("rho"))


def estimate(sketch: DataFrame, b: int = 10, by: list[str] | None = None) -> DataFrame:
    """(by, estimate): raw where above 2.5 m, else linear counting while a register is empty. Without rows and
    keys the estimate is 0."""
    m, a = 1 << _checked(b), alpha(b)
    zeros = F.lit(m) - F.count("rho")
    raw = F.lit(a * m * m) / harmonic(m)
    linear = F.lit(float(m)) * F.ln(F.lit(float(m)) / F.nullif(zeros, F.lit(0)))
    value = F.when((raw <= 2.5 * m) & (zeros > 0), linear).otherwise(raw)
    return sketch.groupBy(*(by or [])).agg(F.round(value, 6).alias("estimate"))


def reciprocal(sketch: DataFrame, index: int, b: int = 10) -> DataFrame:
    """(recip): 2^-rho of one register. ValueError outside 0 to 2^b - 1."""
    if not 0 <= index < 1 << _checked(b):
        raise ValueError("index out of range")
    return sketch.where(F.col("bucket") == index).agg(F.coalesce(F.max(F.pow(F.lit(2.0), -F.col("rho"))), F.lit(1.0)).alias("recip"))


def native_estimate(df: DataFrame, item: str, by: list[str], lg_k: int = 12) -> DataFrame:
    """The engine's own sketch, for speed; its hash and so its estimate differ."""
    return df.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_sketch_agg(item, lg_k)).alias("estimate"))
