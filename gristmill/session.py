"""Sessions, and the shared folder that lineage is cut into."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def build(name: str = "gristmill", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and the RocksDB state store, which the stateful streams need."""
    builder = SparkSession.builder.appName(name)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    return builder.config(map=defaults | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from the driver's path when it is not installed on them."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder. Where it names none, a folder of this machine, which only a master
    that runs in this process can use; RuntimeError for any other."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="gristmill-checkpoint-"))
    return jsc.getCheckpointDir().get()


#: Size estimates of so many bits are taken for what products of joins have made of them.
LARGEST = 62


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the checkpoint folder that all executors share, and reads on from there.

    A checkpoint keeps the plan's size estimate. Joins multiply estimates, so over rounds of joins it would grow to
    a number of millions of digits, and planning would never end; such an estimate is given up.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    out = df.checkpoint(eager=True)
    plan = out._jdf.queryExecution()
    if plan.optimizedPlan().stats().sizeInBytes().bit_length() <= LARGEST:
        return out
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.toRdd(), out._jdf.schema(), False), spark)
