"""A corpus pipeline: quality rules, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last
return the columns of documents, whatever further ones there are; the last adds shard and slot. Without rows every stage
returns none.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from gristmill.llm import decontam, mixing, quality, sharding, simhash
from gristmill.llm.common import checkpoint_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go.

    Null, empty and wordless texts go; texts of any length are measured whole; repeated rows stay or go alike."""
    return quality.keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one of least doc_id (a null one last).

    Null, empty and wordless texts are one group; repeated rows are one document; long texts are compared whole."""
    return simhash.dedup_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, within its error budget, go.

    Null, empty and wordless texts hold nothing and stay, and such items are held by nothing; without items all stay."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay as often as the mixture draws them.

    Null and empty texts have no words and are not drawn; a null source is a source of its own; repeated rows are drawn
    each for itself; ties in size go by a seeded hash."""
    return mixing.mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets a shard and a slot, in place of columns of these names; repeated rows get a slot each."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mix", mix),
    ("shard", shard),
]

#: The estimated posteriors and the edit distances can't be expressed in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store, if the session still runs."""
    if spark.sparkContext._jsc and not spark.sparkContext._jsc.sc().isStopped():
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages the rows are written to the shared checkpoint folder. A stage's folder is
    deleted when the next one has been written, and the last, which the result is read from, when the process ends."""
    docs = table(spark, sf_dir, "documents")
    folder, last = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    atexit.register(_remove, spark, folder)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(path := f"{folder}/{k}-{name}")
            docs = spark.read.parquet(path)
            if last:
                _remove(spark, last)
            last = path
    return docs
