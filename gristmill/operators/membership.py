"""Membership filters (Bloom) as sets of positions, and set algebra over bitmaps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.hashing import md5_u64, sha_u64

# --- Bloom -----------------------------------------------------------------------------------------


def plan(n: float, p: float = 0.1) -> tuple[int, int]:
    """(bits, hashes) for n keys at false-positive rate p; the hash count is rounded half to even."""
    if not 0 < p < 1:
        raise ValueError("p must be between 0 and 1")
    n = max(1, int(n))
    m = math.ceil(-n * math.log(p) / math.log(2) ** 2)
    return m, max(1, round(m / n * math.log(2)))


def bit_positions(key: Column, m: int, k: int) -> Column:
    """The k positions (h1 + i h2) mod m of a key; h1 from SHA-256, h2 from MD5, or 1 where that is 0."""
    h1 = F.pmod(sha_u64(key), F.lit(m).cast("decimal(20,0)")).cast("bigint")
    md5 = md5_u64(key)
    h2 = F.pmod(F.when(md5 == 0, F.lit(1).cast("decimal(20,0)")).otherwise(md5), F.lit(m).cast("decimal(20,0)")).cast("bigint")
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.pmod(h1 + i * h2, F.lit(m).cast("bigint")))


def build(keys: DataFrame, key: str, m: int, k: int) -> DataFrame:
    """(pos): the set bits of the filter of all keys; null keys are skipped. At most m rows."""
    text = F.col(key).cast("string")
    return keys.where(F.col(key).isNotNull()).select(F.explode(bit_positions(text, m, k)).alias("pos")).distinct()


def probe(bits: DataFrame, probes: DataFrame, key: str, m: int, k: int) -> DataFrame:
    """(key, found) for the distinct keys of probes: found when every distinct position of the key is set."""
    asked = probes.where(F.col(key).isNotNull()).select(F.col(key).alias("key")).distinct()
    each = asked.select("key", F.explode(F.array_distinct(bit_positions(F.col("key").cast("string"), m, k))).alias("p"))
    hit = bits.select("pos", F.lit(True).alias("set"))
    return each.join(hit, F.col("p") == F.col("pos"), "left").groupBy("key").agg(F.bool_and(F.coalesce("set", F.lit(False))).alias("found"))


def union(a: DataFrame, b: DataFrame, size_a: tuple[int, int], size_b: tuple[int, int]) -> DataFrame:
    """Set bits of either filter; both must have the same (bits, hashes)."""
    if size_a != size_b:
        raise ValueError("filters differ in size")
    return a.select("pos").union(b.select("pos")).distinct()


def intersect(a: DataFrame, b: DataFrame, size_a: tuple[int, int], size_b: tuple[int, int]) -> DataFrame:
    if size_a != size_b:
        raise ValueError("filters differ in size")
    return a.select("pos").intersect(b.select("pos"))


def count_set(bits: DataFrame) -> DataFrame:
    return bits.agg(F.count("pos").alias("n_set"))


# --- bitmaps ---------------------------------------------------------------------------------------


def _universe(b: int) -> int:
    if b < 0:
        raise ValueError("b must not be negative")
    return 1 << b


def bits_of(df: DataFrame, idx: str, b: int | None = 16) -> DataFrame:
    """(idx): the distinct indices as BIGINT; an index outside [0, 2^b) fails the query. Without b, any index counts."""
    i = F.col(idx).cast("bigint")
    if b is None:
        return df.where(i.isNotNull()).select(i.alias("idx")).distinct()
    top = _universe(b)
    checked = F.when((i >= 0) & (i < top), i).otherwise(F.raise_error(F.concat(F.lit("index out of range: "), i.cast("string"))).cast("bigint"))
    return df.where(i.isNotNull()).select(checked.alias("idx")).distinct()


def delete(bits: DataFrame, gone: DataFrame) -> DataFrame:
    return bits.join(gone.select("idx").distinct(), "idx", "left_anti")


def contains_all(bits: DataFrame, asked: DataFrame, idx: str = "idx", b: int = 16) -> DataFrame:
    """(found): whether every asked index is set; of none asked, true; one out of range is not set."""
    a = asked.select(F.col(idx).cast("bigint").alias("a")).distinct()
    met = a.join(bits, F.col("a") == F.col("idx"), "left")
    return met.agg(F.coalesce(F.bool_and(F.col("idx").isNotNull()), F.lit(True)).alias("found"))


def _same(b_left: int, b_right: int) -> None:
    if b_left != b_right:
        raise ValueError("bitmaps differ in size")


def bit_union(x: DataFrame, y: DataFrame, bx: int = 16, by: int = 16) -> DataFrame:
    _same(bx, by)
    return x.select("idx").union(y.select("idx")).distinct()


def bit_intersect(x: DataFrame, y: DataFrame, bx: int = 16, by: int = 16) -> DataFrame:
    _same(bx, by)
    return x.select("idx").intersect(y.select("idx"))


def bit_xor(x: DataFrame, y: DataFrame, bx: int = 16, by: int = 16) -> DataFrame:
    """Indices of exactly one side, by one aggregate over both."""
    _same(bx, by)
    both = x.select("idx").distinct().union(y.select("idx").distinct())
    return both.groupBy("idx").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("idx")


def complement(bits: DataFrame, b: int = 16) -> DataFrame:
    return bits.sparkSession.range(_universe(b)).select(F.col("id").alias("idx")).join(bits, "idx", "left_anti")


def _bounds(lo: int, hi: int, b: int) -> None:
    if not 0 <= lo <= hi <= _universe(b):
        raise ValueError("bad range")


def set_range(bits: DataFrame, lo: int, hi: int, b: int = 16) -> DataFrame:
    """Sets [lo, hi)."""
    _bounds(lo, hi, b)
    return bits.select("idx").union(bits.sparkSession.range(lo, hi).select(F.col("id").alias("idx"))).distinct()


def clear_range(bits: DataFrame, lo: int, hi: int, b: int = 16) -> DataFrame:
    """Clears [lo, hi)."""
    _bounds(lo, hi, b)
    return bits.where((F.col("idx") < lo) | (F.col("idx") >= hi))


def packed(bits: DataFrame) -> DataFrame:
    """(bucket, map): bitmaps in binary, 32768 bits a bucket, the least significant bit of each byte first."""
    at = F.col("idx") + 1
    return bits.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("map"))


def cardinality(maps: DataFrame) -> DataFrame:
    return maps.agg(F.coalesce(F.sum(F.bitmap_count("map")), F.lit(0)).alias("n"))


def equals(x: DataFrame, y: DataFrame, bx: int = 16, by: int = 16) -> DataFrame:
    if bx != by:
        return x.sparkSession.range(1).select(F.lit(False).alias("equal"))
    return bit_xor(x, y).agg((F.count(F.lit(1)) == 0).alias("equal"))
