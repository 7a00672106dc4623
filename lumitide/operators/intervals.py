"""Joins by time: intervals that hold a point, and the last row at or before a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bucket widths grow by this factor from one tier to the next.
TIER, TIERS = 64, 4


def interval_join(points: DataFrame, spans: DataFrame, t: str, start: str, end: str, keys: Sequence[str] = (), width: int = 1_000_000, how: str = "inner") -> DataFrame:
    """Points with every span of the same keys that holds them: ``start <= t < end``.

    An equi-join on time buckets.  A span lies in the first of ``TIERS`` tiers (widths ``width``,
    ``width * TIER``, ...) in which it touches two buckets at most, so that long and short spans can
    mix; only spans beyond the widest tier are in more buckets.  A point looks into one bucket of
    each tier.  Empty spans hold nothing.  how: inner or left.
    """
    widths = [width * TIER**k for k in range(TIERS)]
    size = F.col(end) - F.col(start)
    tier = F.lit(TIERS - 1)
    for k in range(TIERS - 2, -1, -1):
        tier = F.when(size <= widths[k], k).otherwise(tier)
    table = F.array(*map(F.lit, widths))
    cell = lambda c: F.floor(c / F.get(table, F.col("tier_")))
    right = spans.where(size > 0).withColumn("tier_", tier)
    right = right.withColumn("cell_", F.explode(F.sequence(cell(F.col(start)), cell(F.col(end) - 1))))
    if how == "inner":
        left = points.withColumn("tier_", F.explode(F.array(*map(F.lit, range(TIERS))))).withColumn("cell_", cell(F.col(t)))
        both = left.join(right, [*keys, "tier_", "cell_"])
        return both.where((F.col(start) <= F.col(t)) & (F.col(t) < F.col(end))).drop("tier_", "cell_")
    tagged = points.withColumn("point_", F.monotonically_increasing_id())
    found = interval_join(tagged.select("point_", *keys, t), spans, t, start, end, keys, width)
    return tagged.join(found.drop(*keys, t), "point_", "left").drop("point_")


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], t: str, right_t: str, values: Sequence[str]) -> DataFrame:
    """left with the values of the last right row of the same keys with ``right_t <= t``, else nulls.

    One shuffle by the keys: both sides are united, sorted, and each right row's values carried on.
    Of right rows at one time, the one with the greatest values wins.
    """
    if not keys:
        raise ValueError("an as-of join without keys would sort everything in one task")
    pack = F.struct(F.col(right_t).alias("at"), *values)
    a = left.select(*keys, F.col(t).alias("t_"), F.lit(1).alias("side_"), F.struct(*left.columns).alias("row_"), F.lit(None).cast(right.select(pack.alias("p")).schema["p"].dataType).alias("pack_"))
    b = right.select(*keys, F.col(right_t).alias("t_"), F.lit(0).alias("side_"), F.lit(None).cast(a.schema["row_"].dataType).alias("row_"), pack.alias("pack_"))
    w = Window.partitionBy(*keys).orderBy("t_", "side_", "pack_").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn("last_", F.last("pack_", ignorenulls=True).over(w)).where("side_ = 1")
    return out.select("row_.*", *[F.col(f"last_.{v}").alias(v) for v in values])


def in_force(rows: DataFrame, keys: Sequence[str], t: str, order: Sequence[str] = (), last: Column | None = None, end: str = "e_us") -> DataFrame:
    """rows with the time of the next row of the same keys as ``end``; of the last row: ``last``."""
    w = Window.partitionBy(*keys).orderBy(t, *order)
    return rows.withColumn(end, F.coalesce(F.lead(t).over(w), last if last is not None else F.lit(None).cast("bigint")))
