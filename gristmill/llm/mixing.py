"""Mixing sources to target weights by systematic sampling (native).

Each source has a target of words; a document's expected copies are target / source size. The expected
copies are prefix-summed along a total order of the source (by size, then a seeded hash), one random
offset per source is added, and the document is emitted once for each integer boundary that its part of
the sum crosses. Ordering by size makes the sample of words, not only of documents, follow the target:
the error of a source is about the size of one of its largest documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.llm.common import KEY, ROW, WORD, cut, keyed, positions, rejoin, small, spread, table, unit

SEED = 17
#: No source's target, and so no document, exceeds its size by this factor.
MAX_REPEAT = 3


def word_count(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, weight) to (source, source_size, target).

    Sources share the sum of all sizes by weight; a target stops at max_repeat times its source's size
    and the excess is shared by the rest, by weight, until none is above. In closed form: in the order
    of max_repeat * size / weight the capped sources are a prefix, and the level is taken from the
    first prefix after which no source is above its cap. sizes has one row per source.
    """
    sizes = sizes.withColumn("cap", F.col("source_size") * max_repeat).withColumn("gm_ratio", F.col("cap") / F.col("weight"))
    w = Window.orderBy("gm_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = sizes.withColumns(
        {
            "gm_rest": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(w), F.lit(0)),
            "gm_weight": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(w), F.lit(0)),
        }
    ).withColumn("gm_level", F.greatest(F.col("gm_rest"), F.lit(0)) / F.col("gm_weight"))
    level = F.min(F.when(F.col("gm_level") <= F.col("gm_ratio"), F.struct("gm_ratio", "gm_level"))).over(everything)["gm_level"]
    return x.select(
        "source", "source_size", F.least(F.col("cap").cast("double"), level * F.col("weight")).alias("target")
    )


def cycled_weights(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Sources by code point, null last, take the weights in turn."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")))


def mix(rows: DataFrame, id_cols: list[str], seed: int = SEED, max_repeat: int = MAX_REPEAT, weights=None) -> DataFrame:
    """Adds source_size, target and copies to narrow rows of (id_cols, source, size).

    weights: a function from (source, source_size) to (source, source_size, weight); the default is
    cycled_weights. A source of size 0 has target 0 and no copies; a null source is a source of its
    own. Repeated rows are separate rows. Without rows the result is empty.
    """
    rows = cut(rows)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = cut(targets((weights or cycled_weights)(sizes), max_repeat))
    goals = goals.select(F.col("source").alias("gm_source"), "source_size", "target")
    ranked = positions(rows.withColumn("gm_spread", spread(id_cols[0], seed)), ["size", "gm_spread", *id_cols], ["source"], "gm_pos")
    each = F.least(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0), F.lit(float(max_repeat)))
    crossed = lambda k: F.floor(unit(F.col("source"), seed) + each * (F.col("gm_pos") + k))
    return (
        ranked.join(small(goals), F.col("source").eqNullSafe(F.col("gm_source")))
        .withColumn("copies", crossed(1) - crossed(0))
        .select(*rows.columns, "source_size", "target", "copies")
    )


def mix_documents(docs: DataFrame, seed: int = SEED, max_repeat: int = MAX_REPEAT, weights=None) -> DataFrame:
    """The documents of the mixture, whole rows, each as often as it is drawn.

    Rows go by all their columns, nulls and nested values included: repeats of a row are drawn each for itself, and
    rows that differ in anything are never taken for one another. A null or empty text has size 0 and is not
    drawn; a text of any length is one document. Ties in size go by a seeded hash of doc_id. Without rows the
    result is empty; further columns pass through, whatever their names and types.
    """
    narrow = keyed(docs).select(*KEY, F.col(ROW)["source"].alias("source"), word_count(F.col(ROW)["text"]).alias("size"))
    drawn = mix(narrow, KEY, seed, max_repeat, weights).groupBy(*KEY).agg(F.sum("copies").alias("gm_copies")).where("gm_copies > 0")
    each = F.explode(F.sequence(F.lit(1), F.col("gm_copies").cast("int")))
    return rejoin(docs, drawn).select(ROW, each.alias("gm_each")).select(f"{ROW}.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document.

    A null or empty text has size 0 and takes 0; texts of any length are counted whole. Ties in size are ordered by a
    seeded hash of doc_id, then doc_id; repeated rows are drawn each for itself. An empty table gives no row; other
    columns of the table are not read.
    """
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", word_count().alias("size"))
    return mix(rows, ["doc_id"]).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


ORACLE = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
c AS (SELECT source, source_size, k % 3 + 1 AS weight, {MAX_REPEAT} * source_size AS cap, ({MAX_REPEAT} * source_size)::DOUBLE / (k % 3 + 1) AS ratio FROM s),
r AS (SELECT *, greatest(sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0), 0)::DOUBLE
        / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS lvl
      FROM c WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap::DOUBLE, (SELECT lvl FROM r WHERE lvl <= ratio ORDER BY ratio, lvl LIMIT 1) * weight) AS target FROM r),
e AS (SELECT d.doc_id, d.size, t.source_size, t.target,
        least(CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END, {float(MAX_REPEAT)})::DOUBLE AS each,
        ('0x' || substr(md5('{SEED}:' || coalesce(d.source, 'null')), 1, 13))::BIGINT::DOUBLE / {float(2**52)}::DOUBLE AS u,
        row_number() OVER (PARTITION BY d.source ORDER BY d.size, md5('{SEED}:' || coalesce(d.doc_id::VARCHAR, '')), d.doc_id NULLS LAST) - 1 AS pos
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(u + each * (pos + 1)) - floor(u + each * pos)) * size)::BIGINT AS taken FROM e
"""
