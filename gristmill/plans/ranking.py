"""Ranks in a total order without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.session import cut


def small(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Hints a broadcast only after counting: beyond max_rows the join shuffles instead."""
    df = cut(df)
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def positions(df: DataFrame, order: list[str | Column], group: list[str] | None = None, name: str = "pos") -> DataFrame:
    """Adds the 0-based position of each row in the total order of its group.

    Rows are dealt by range over (group, order), so a group of any size spreads over many tasks; each
    task numbers its own rows and a table of one row per task and group carries the prefix counts.
    Rows equal in all of (group, order) take the positions of their run in an unspecified order.
    """
    group = group or []
    keys = [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in [*group, *order]]
    dealt = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("gm_mid", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("gm_part", F.shiftrightunsigned("gm_mid", 33))
    before = Window.partitionBy(*group or [F.lit(0)]).orderBy("gm_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy("gm_part", *group)
        .agg(F.min("gm_mid").alias("gm_first"), F.count(F.lit(1)).alias("gm_n"))
        .withColumn("gm_before", F.coalesce(F.sum("gm_n").over(before), F.lit(0)))
        .drop("gm_n")
    )
    starts = starts.select(*[F.col(c).alias(f"gm_r_{c}") for c in ["gm_part", *group]], "gm_first", "gm_before")
    on = F.lit(True)
    for c in ["gm_part", *group]:
        on = on & F.col(c).eqNullSafe(F.col(f"gm_r_{c}"))
    return dealt.join(small(starts), on).select(
        *df.columns, (F.col("gm_before") + F.col("gm_mid") - F.col("gm_first")).alias(name)
    )


def running(df: DataFrame, order: list[str], group: list[str], sums: dict[str, Column] | None = None, least: dict[str, Column] | None = None) -> DataFrame:
    """Adds running sums and minima, the row's own value included, in the total order of each group.

    As in positions, rows are dealt by range over (group, order); a task aggregates its own rows and a table of one row
    per task and group carries what came before. order must be total.
    """
    sums, least = sums or {}, least or {}
    keys = [F.col(c).asc_nulls_last() for c in [*group, *order]]
    values = {f"gm_v_{k}": v for k, v in {**sums, **least}.items()}
    dealt = cut(df.withColumns(values).repartitionByRange(*keys).withColumn("gm_part", F.spark_partition_id()))
    own = Window.partitionBy("gm_part", *group).orderBy(*[F.col(c).asc_nulls_last() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group or [F.lit(0)]).orderBy("gm_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("gm_part", *group).agg(
        *[F.sum(f"gm_v_{k}").alias(f"gm_v_{k}") for k in sums], *[F.min(f"gm_v_{k}").alias(f"gm_v_{k}") for k in least]
    )
    carried = totals.select(
        *[F.col(c).alias(f"gm_r_{c}") for c in ["gm_part", *group]],
        *[F.sum(f"gm_v_{k}").over(before).alias(f"gm_b_{k}") for k in sums], *[F.min(f"gm_v_{k}").over(before).alias(f"gm_b_{k}") for k in least],
    )
    on = F.lit(True)
    for c in ["gm_part", *group]:
        on = on & F.col(c).eqNullSafe(F.col(f"gm_r_{c}"))
    local = dealt.withColumns({f"gm_l_{k}": F.sum(f"gm_v_{k}").over(own) for k in sums} | {f"gm_l_{k}": F.min(f"gm_v_{k}").over(own) for k in least})
    met = local.join(small(carried), on)
    return met.select(
        *df.columns, *[(F.col(f"gm_l_{k}") + F.coalesce(f"gm_b_{k}", F.lit(0))).alias(k) for k in sums],
        *[F.when(F.col(f"gm_b_{k}") <= F.col(f"gm_l_{k}"), F.col(f"gm_b_{k}")).otherwise(F.coalesce(f"gm_l_{k}", f"gm_b_{k}")).alias(k) for k in least],
    )
