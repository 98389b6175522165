"""Shared pieces of the corpus operators: words, seeded orders, row keys, and joins back to whole rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.plans.ranking import positions, small
from gristmill.session import checkpoint_dir, cut, ship

__all__ = ["KEY", "ROW", "WORD", "checkpoint_dir", "cut", "keyed", "positions", "rejoin", "ship", "small", "spread", "table", "unit"]

#: Java and DuckDB pattern of a word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread(c: str | Column, seed: int) -> Column:
    """A seeded order key that DuckDB can compute too."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c, F.lit(""))))


def unit(c: Column, seed: int) -> Column:
    """A seeded number in [0, 1) from a string, of 13 hex digits of its MD5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(c, F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


#: Columns that identify a row in the joins back to whole documents, and the struct that holds the whole row.
KEY = ["gm_id", "gm_one", "gm_two"]
ROW = "gm_row"


def _told(c: Column, kind: T.DataType) -> list[Column]:
    """Columns whose hash tells values of c apart: nulls at any depth are marked, maps are sorted by key, and numbers
    that compare as equal but are not the same (0.0 and -0.0) go by their digits."""
    if isinstance(kind, T.StructType):
        return [c.isNull(), *[x for f in kind.fields for x in _told(c.getField(f.name), f.dataType)]]
    if isinstance(kind, T.ArrayType):
        return [c.isNull(), F.size(c), F.transform(c, lambda x: F.struct(*_told(x, kind.elementType)))]
    if isinstance(kind, T.MapType):
        entries = F.transform(F.array_sort(F.map_keys(c)), lambda k: F.struct(*_told(k, kind.keyType), *_told(F.element_at(c, k), kind.valueType)))
        return [c.isNull(), F.size(c), entries]
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return [c.isNull(), c.cast("string")]
    if isinstance(kind, T.StringType):
        return [c.isNull(), c.cast("binary")]
    if isinstance(kind, T.NullType):
        return [F.lit(True)]
    if isinstance(kind, T.VariantType):
        return [c.isNull(), F.to_json(c)]
    return [c.isNull(), c]


def keyed(docs: DataFrame) -> DataFrame:
    """KEY and ROW: doc_id, two 64-bit hashes over all columns, and the columns themselves in one struct, so that no
    name of theirs meets one of ours. Rows that agree on the hashes are repeats of one row: nulls count, whichever
    columns they stand in, and columns may have any type."""
    told = [x for f in docs.schema.fields for x in _told(F.col(f"`{f.name}`"), f.dataType)]
    return docs.select(
        F.col("doc_id").alias("gm_id"), *[F.xxhash64(F.lit(seed), *told).alias(name) for seed, name in ((1, "gm_one"), (2, "gm_two"))],
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW),
    )


def rejoin(docs: DataFrame, take: DataFrame) -> DataFrame:
    """ROW of the rows of docs whose key is in take, once for each row of take, with take's further columns.

    Repeats of a row meet as one before the join (the rank limit prunes them before the shuffle), so
    take decides alone how often a row is returned. Both sides are dealt by the same key: the text
    moves once.
    """
    hashes = KEY[1:]
    first = Window.partitionBy(*hashes).orderBy(F.lit(0))
    one = keyed(docs).withColumn("gm_rank", F.row_number().over(first)).where("gm_rank = 1").select(*hashes, ROW)
    more = [c for c in take.columns if c not in KEY]
    right = take.select(*[F.col(c).alias(f"gm_t_{c}") for c in hashes], *more)
    on = (F.col(hashes[0]) == F.col(f"gm_t_{hashes[0]}")) & (F.col(hashes[1]) == F.col(f"gm_t_{hashes[1]}"))
    return one.join(right, on).select(ROW, *more)
