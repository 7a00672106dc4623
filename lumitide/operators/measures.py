"""Aggregates over samples and pictures: waveforms, peaks, quality and percentiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ParamError


def waveform(samples: DataFrame, total: Column | str, buckets: int = 200, group: Sequence[str] = ("clip_id",)) -> DataFrame:
    """``bucket, lo, hi`` of each group: the extreme peaks of the samples in each bucket, 0 in empty ones.

    A sample frame's peak is the greatest absolute value of its channels.
    """
    if buckets < 1:
        raise ParamError("a waveform needs buckets")
    n = F.col(total) if isinstance(total, str) else total
    peaks = samples.withColumn("n_", n).groupBy(*group, "i", "n_").agg(F.max(F.abs("v")).alias("peak_"))
    bucket = F.least(F.floor(F.col("i") * buckets / F.col("n_")), F.lit(buckets - 1)).cast("bigint")
    got = peaks.groupBy(*group, bucket.alias("bucket")).agg(F.max("peak_").alias("hi"))
    groups = samples.select(*group).distinct()
    grid = groups.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(buckets - 1).cast("bigint"))))
    out = grid.join(got, [*group, "bucket"], "left").withColumn("hi", F.coalesce("hi", F.lit(0.0)))
    return out.select(*group, "bucket", (-F.col("hi")).alias("lo"), "hi")


def bucket_extremes(rows: DataFrame, value: str, dur_us: int, buckets: int, group: Sequence[str]) -> DataFrame:
    """Least and greatest value of the frames that begin in each bucket of the timeline; 0 in empty ones."""
    bucket = F.least(F.floor(F.col("t_us") * buckets / F.lit(dur_us)), F.lit(buckets - 1)).cast("bigint")
    got = rows.groupBy(*group, bucket.alias("bucket")).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    groups = rows.select(*group).distinct()
    grid = groups.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(buckets - 1).cast("bigint"))))
    return grid.join(got, [*group, "bucket"], "left").select(*group, "bucket", F.coalesce("lo", F.lit(0.0)).alias("lo"), F.coalesce("hi", F.lit(0.0)).alias("hi"))


def normalize(samples: DataFrame, target: float = 1.0, group: Sequence[str] = ("clip_id",)) -> DataFrame:
    """Scaled so that each group's peak is the target; groups that are silent stay so."""
    peak = samples.groupBy(*group).agg(F.max(F.abs("v")).alias("peak_"))
    gain = F.when(F.col("peak_") > 1e-9, F.lit(float(target)) / F.col("peak_")).otherwise(1.0)
    return samples.join(peak, list(group)).withColumn("v", F.col("v") * gain).select(*samples.columns)


def mse(a: Column, b: Column) -> Column:
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0).cast("bigint"), lambda s, v: s + v.cast("bigint"))
    return F.when(F.size(a) == F.size(b), total / F.size(a))


def psnr(a: Column, b: Column) -> Column:
    """In dB; infinite for equal pictures, null for two sizes."""
    m = mse(a, b)
    return F.when(m == 0, float("inf")).when(m > 0, F.lit(10.0) * F.log10(F.lit(65025.0) / m))


def ssim(a: Column, b: Column, channels: int = 1) -> Column:
    """Over the whole picture, the mean of the channels' values; null for two sizes."""
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    of = lambda px, k: px if channels == 1 else F.filter(px, lambda v, i: i % channels == k)
    mean = lambda px: F.aggregate(px, F.lit(0.0), lambda s, v: s + v) / F.size(px)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: (p * q).cast("double")), F.lit(0.0), lambda s, v: s + v) / F.size(x)

    def one(k: int) -> Column:
        x, y = of(a, k), of(b, k)
        mx, my = mean(x), mean(y)
        vx, vy, cov = dot(x, x) - mx * mx, dot(y, y) - my * my, dot(x, y) - mx * my
        return (mx * my * 2 + c1) * (cov * 2 + c2) / ((mx * mx + my * my + c1) * (vx + vy + c2))

    total = one(0)
    for k in range(1, channels):
        total = total + one(k)
    return F.when(F.size(a) == F.size(b), total / channels)


def percentile(rows: DataFrame, value: str, p: float, group: Sequence[str]) -> DataFrame:
    """Exact, linear between neighbours; groups without values give 0."""
    return rows.groupBy(*group).agg(F.coalesce(F.percentile(value, F.lit(p)), F.lit(0.0)).alias("percentile"))


def hit_rate(hits: Column, misses: Column) -> Column:
    return F.when(hits + misses > 0, hits / (hits + misses)).otherwise(0.0)
