"""Sharding by proportional stratified interleaving (native).

Within each source the rows are ranked in a seeded shuffle; all rows are then sorted by fractional rank
(rank - 1/2) / rows of the source, so any run of that order holds every source in its share of the whole;
cutting the order into equal runs gives shards that all match the mixture, with row counts at most one apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import KEY, ROW, cut, keyed, positions, rejoin, small, spread, table

SEED = 29
SHARDS = 24


def interleave(rows: DataFrame, id_cols: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Adds shard (0 to shards - 1) and slot (gapless from 0 in its shard) to narrow rows of (id_cols, source).

    Null sources are a source of their own. Repeated rows are separate rows that may land in any shard
    in turn. With fewer rows than shards some shards stay empty; without rows the result is empty.
    """
    rows = cut(rows.withColumn("gm_spread", spread(id_cols[0], seed)))
    totals = rows.groupBy("source").agg(F.count(F.lit(1)).alias("gm_total")).withColumnRenamed("source", "gm_source")
    ranked = positions(rows, ["gm_spread", *id_cols], ["source"], "gm_rank").join(
        small(totals), F.col("source").eqNullSafe(F.col("gm_source"))
    )
    frac = F.expr("((gm_rank * 2 + 1) / (gm_total * 2))")
    placed = positions(cut(ranked.withColumn("gm_frac", frac).drop("gm_source", "gm_rank", "gm_total")), ["gm_frac", "gm_spread", *id_cols], name="gm_pos")
    n = rows.count()
    shard = F.expr(f"gm_pos * {shards} div {max(n, 1)}")
    first = F.expr(f"(gm_shard * {n} + {shards - 1}) div {shards}")
    return (
        placed.withColumn("gm_shard", shard)
        .withColumns({"shard": F.col("gm_shard").cast("int"), "slot": F.col("gm_pos") - first})
        .drop("gm_spread", "gm_frac", "gm_pos", "gm_shard")
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """All rows of docs, whole, with shard and slot, which replace columns of these names.

    Rows go by all their columns, nulls and nested values included; repeats of a row get a slot each. Texts are not
    looked at, so null, empty and long ones are rows like any other. Without rows the result is empty.
    """
    docs = docs.drop("shard", "slot")
    narrow = keyed(docs).select(*KEY, F.col(ROW)["source"].alias("source"))
    return rejoin(docs, interleave(narrow, KEY, shards, seed).select(*KEY, "shard", "slot")).select(f"{ROW}.*", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Writes docs as Parquet in one folder per shard, in slot order."""
    out = shard_documents(docs, shards, seed)
    out.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law (rows), shard, slot, grown_shard (null) of every document.

    A null text counts as empty: size 8, CRC 0. Equal texts are ordinary rows of their sources. Rows of equal (or null)
    doc_id are told apart by CRC and size; repeats beyond that take the slots of their run in any order. Texts of any
    length are read once, for these two numbers. An empty table gives no row; other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")
    )
    return interleave(rows, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
