"""Sources and sinks: Parquet tables, bit images in bytes, balancer configurations, pixel tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SERVER_SCHEMA = (
    "name string, url string, active_connections int, healthy boolean, weight int, max_connections int, "
    "metadata struct<total_requests:int,speeds:array<double>,total_time:double,latency:double,success:int,failure:int,success_rate:double>"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bits_from_bytes(spark: SparkSession, data: bytes, b: int) -> DataFrame:
    """(idx) of the set bits of 2^b bits, least significant bit of each byte first. ValueError unless the length fits."""
    if b < 0 or len(data) != max(1, (1 << b) + 7 >> 3):
        raise ValueError("data must hold exactly 2^b bits")
    one = spark.createDataFrame([(bytearray(data),)], "data binary")
    byte = F.conv(F.hex(F.expr("substr(data, cast(i div 8 as int) + 1, 1)")), 16, 10).cast("int")
    every = one.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((1 << b) - 1).cast("long"))))
    return every.where(F.getbit(byte, F.expr("cast(i % 8 as int)")) != 0).select(F.col("i").alias("idx"))


def servers_from_config(spark: SparkSession, config: dict) -> DataFrame:
    """A balancer's server table from {'servers': [{name, url, ...}], ...}; weight 1, 100 connections and
    healthy where nothing is said. ValueError for an unknown strategy or without servers."""
    if config.get("strategy", "round_robin") not in ("round_robin", "weighted_round_robin", "least_connections", "least_time"):
        raise ValueError("unknown strategy")
    if not config.get("servers"):
        raise ValueError("servers must not be empty")
    empty = (0, [], 0.0, 0.0, 0, 0, 1.0)
    rows = [
        (s["name"], s["url"], s.get("active_connections", 0), s.get("healthy", True), s.get("weight", 1), s.get("max_connections", 100), empty)
        for s in config["servers"]
    ]
    return spark.createDataFrame(rows, SERVER_SCHEMA)


def pixels(df: DataFrame, image_id: str = "image_id") -> DataFrame:
    """(image_id, y, x, r, g, b) from images in columns (image_id, pixels: array of rows of structs r, g, b)."""
    rows = df.select(image_id, F.posexplode("pixels").alias("y", "line"))
    return rows.select(image_id, "y", F.posexplode("line").alias("x", "p")).select(image_id, "y", "x", "p.r", "p.g", "p.b")


def write(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)
