"""Retiming of frame relations: projections of their intervals, without a shuffle.

``fps`` never has to be known: a frame's interval is mapped, and :func:`to_grid` samples the result.
Frames whose interval becomes empty are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ParamError
from ..scratch import folder
from .intervals import asof_join

SECOND = 1_000_000
#: Stills of up to so many bytes are broadcast.
PICTURE_BYTES = 64 << 20


def _to(df: DataFrame, t: Column, e: Column, dur: Column) -> DataFrame:
    out = df.withColumns({"t_us": t.cast("bigint"), "e_us": e.cast("bigint"), "dur_us": dur.cast("bigint")})
    return out.where("t_us < e_us")


def contains(df: DataFrame, secs: float) -> DataFrame:
    """Frames in force at a time; none if the time is outside of the clip."""
    t = F.lit(round(secs * SECOND))
    return df.where((F.col("t_us") <= t) & (t < F.col("e_us")) & (t >= 0) & (t < F.col("dur_us")))


def trim(df: DataFrame, start_us: int, duration_us: int) -> DataFrame:
    """The part [start, start + duration), moved to 0; what a clip lacks of it is left out."""
    if start_us < 0 or duration_us <= 0:
        raise ParamError("a trim needs start >= 0 and duration > 0")
    stop = start_us + duration_us
    part = df.where((F.col("e_us") > start_us) & (F.col("t_us") < stop))
    return _to(part, F.greatest(F.col("t_us") - start_us, F.lit(0)), F.least(F.col("e_us"), F.lit(stop)) - start_us, F.least(F.lit(duration_us), F.col("dur_us") - start_us))


def speed(df: DataFrame, factor: float) -> DataFrame:
    if not (math.isfinite(factor) and factor > 0):
        raise ParamError(f"speed factor must be above 0, not {factor}")
    scale = lambda c: F.round(F.col(c) / factor)
    return _to(df, scale("t_us"), scale("e_us"), scale("dur_us"))


def freeze(df: DataFrame, at_us: int, hold_us: int) -> DataFrame:
    """The frame in force at ``at`` stays ``hold`` longer; clips that end before it pass through."""
    if at_us < 0 or hold_us <= 0:
        raise ParamError("a freeze needs at >= 0 and hold > 0")
    inside = F.col("dur_us") > at_us
    late = lambda c: F.col(c) + F.when(inside & (F.col(c) > at_us), hold_us).otherwise(0)
    return _to(df, late("t_us"), late("e_us"), F.col("dur_us") + F.when(inside, hold_us).otherwise(0))


def loop(df: DataFrame, until_us: int | None = None, times: int | None = None) -> DataFrame:
    """Repeated until a duration, or a number of times; the duration goes first if both are given."""
    if until_us is None and times is None or until_us is not None and until_us <= 0 or until_us is None and times < 1:
        raise ParamError("a loop needs a duration or times above 0")
    total = F.lit(until_us) if until_us is not None else F.col("dur_us") * times
    last = F.greatest(F.ceil(total / F.col("dur_us")).cast("int") - 1, F.lit(0))
    out = df.where("dur_us > 0").withColumn("k_", F.explode(F.sequence(F.lit(0), last)))
    move = F.col("k_") * F.col("dur_us")
    out = out.withColumn("total_", total).withColumns({"t_us": F.col("t_us") + move, "e_us": F.least(F.col("e_us") + move, F.col("total_"))})
    return _to(out, F.col("t_us"), F.col("e_us"), F.col("total_")).drop("k_", "total_")


def mirror(df: DataFrame) -> DataFrame:
    return _to(df, F.col("dur_us") - F.col("e_us"), F.col("dur_us") - F.col("t_us"), F.col("dur_us"))


def speed_samples(df: DataFrame, factor: float) -> DataFrame:
    """Samples ``i`` played ``factor`` times as fast: each is read at its own time, so the pitch changes too."""
    if not (math.isfinite(factor) and factor > 0):
        raise ParamError(f"speed factor must be above 0, not {factor}")
    first, end = (F.ceil((F.col("i") + k) / F.lit(float(factor))) for k in (0, 1))
    served = F.when(first < end, F.sequence(first, end - 1))
    return df.withColumn("i_", F.explode(served)).withColumn("i", F.col("i_")).drop("i_")


def mirror_samples(df: DataFrame, frames: int | Column) -> DataFrame:
    """Samples in reverse; frames: how many there are at each channel."""
    return df.withColumn("i", (frames if isinstance(frames, Column) else F.lit(frames)) - 1 - F.col("i"))


def symmetrize(df: DataFrame) -> DataFrame:
    """Forwards, then backwards, in twice the time."""
    d = F.col("dur_us")
    halves = F.array(F.struct(F.col("t_us").alias("t"), F.col("e_us").alias("e")), F.struct((d * 2 - F.col("e_us")).alias("t"), (d * 2 - F.col("t_us")).alias("e")))
    out = df.withColumn("half_", F.explode(halves))
    return _to(out, F.col("half_.t"), F.col("half_.e"), d * 2).drop("half_")


def served(fps: float) -> tuple[Column, Column]:
    """The first grid point that a frame serves, and the one after its last."""
    first, stop = (F.ceil(F.col(c) * F.lit(float(fps)) / SECOND).cast("bigint") for c in ("t_us", "e_us"))
    n = F.greatest(F.round(F.col("dur_us") * F.lit(float(fps)) / SECOND).cast("bigint"), F.lit(1))
    # the last grid point may lie at the clip's end; the last frame then still holds
    return first, F.when(F.col("e_us") >= F.col("dur_us"), n).otherwise(F.least(stop, n))


def to_grid(df: DataFrame, fps: float) -> DataFrame:
    """One row ``idx`` for each time idx / fps of the clip, with the frame in force then."""
    if not (math.isfinite(fps) and fps > 0):
        raise ParamError("fps must be above 0")
    first, stop = served(fps)
    out = df.withColumns({"a_": first, "b_": stop}).where("a_ < b_").withColumn("idx", F.explode(F.sequence(F.col("a_"), F.col("b_") - 1)))
    at = lambda i: F.round(i * SECOND / F.lit(float(fps)))
    return out.withColumns({"t_us": at(F.col("idx")).cast("bigint"), "e_us": at(F.col("idx") + 1).cast("bigint")}).drop("a_", "b_")


def spread(stills: DataFrame, fps: float) -> DataFrame:
    """As :func:`to_grid`, for few pictures that serve many grid points each.

    The pictures are written once; grid points carry none until they meet them, by broadcast if they are few
    bytes (measured), otherwise by a shuffle, so that all cores take part.
    """
    spark, names = stills.sparkSession, stills.columns
    at = folder(spark)
    stills.write.parquet(at)
    kept = spark.read.schema(stills.schema).parquet(at)
    grid = to_grid(kept.drop("w", "h", "channels", "data").withColumn("from_", F.col("t_us")), fps).repartition(spark.sparkContext.defaultParallelism, "idx")
    pictures = kept.select("clip_id", F.col("t_us").alias("from_"), "w", "h", "channels", "data")
    if (pictures.agg(F.sum(F.length("data"))).first()[0] or 0) <= PICTURE_BYTES:
        pictures = F.broadcast(pictures)
    return grid.join(pictures, ["clip_id", "from_"]).select(*names, "idx")


def accel_decel(df: DataFrame, new_dur_us: int, fps: float) -> DataFrame:
    """Ease in and out over a new duration, sampled at fps: u -> 3u^2 - 2u^3 of the clip.

    The grid points of a frame are bounded by the curve's inverse, then tested by the curve itself.
    """
    if new_dur_us <= 0:
        raise ParamError("the new duration must be above 0")
    n = max(1, round(new_dur_us * fps / SECOND))
    d = F.col("dur_us")

    def inverse(c: Column) -> Column:
        s = F.least(F.greatest(c / d, F.lit(0.0)), F.lit(1.0))
        return F.lit(0.5) - F.sin(F.asin(F.lit(1.0) - s * 2) / 3)

    lo = F.greatest(F.floor(inverse(F.col("t_us")) * n) - 1, F.lit(0))
    hi = F.least(F.ceil(inverse(F.col("e_us")) * n) + 1, F.lit(n - 1))
    out = df.where("dur_us > 0").withColumns({"a_": lo.cast("bigint"), "b_": hi.cast("bigint")}).where("a_ <= b_")
    out = out.withColumn("idx", F.explode(F.sequence("a_", "b_")))
    u = F.col("idx") / F.lit(float(n))
    source = F.floor(u * u * (F.lit(3.0) - u * 2.0) * d)
    out = out.withColumn("source_us", source.cast("bigint")).where("t_us <= source_us and source_us < e_us")
    at = lambda i: F.round(i * F.lit(float(new_dur_us)) / n).cast("bigint")
    return out.withColumns({"t_us": at(F.col("idx")), "e_us": at(F.col("idx") + 1), "dur_us": F.lit(new_dur_us).cast("bigint")}).drop("a_", "b_")


def blink(df: DataFrame, on_us: int, off_us: int) -> DataFrame:
    """Intervals cut where the blink turns, with ``lit``: whether the picture shows then."""
    cycle = on_us + off_us
    if on_us < 0 or off_us < 0:
        raise ParamError("blink times can't be negative")
    if cycle == 0:
        return df.withColumn("lit", F.lit(True))
    cuts = F.sequence(F.floor(F.col("t_us") / cycle), F.floor((F.col("e_us") - 1) / cycle))
    out = df.withColumn("k_", F.explode(cuts)).withColumn("lit", F.explode(F.array(F.lit(True), F.lit(False))))
    begin = F.col("k_") * cycle + F.when(F.col("lit"), 0).otherwise(on_us)
    end = (F.col("k_") + F.when(F.col("lit"), 0).otherwise(1)) * cycle + F.when(F.col("lit"), on_us).otherwise(0)
    return _to(out, F.greatest(F.col("t_us"), begin), F.least(F.col("e_us"), end), F.col("dur_us")).drop("k_")


def lit_at(t: Column, on_us: int, off_us: int) -> Column:
    return F.lit(True) if on_us + off_us == 0 else F.pmod(t, F.lit(on_us + off_us)) < on_us


def supersample(df: DataFrame, d_us: int, n: int, fps: float, px: str = "px") -> DataFrame:
    """At each grid point the floored mean of n frames at even times over [t - d, t + d].

    A frame finds the grid points that it serves itself, so the only shuffle is the mean's.
    """
    grid = ["clip_id", "idx", "t_us", "e_us", "dur_us", px]
    if n <= 1 or d_us <= 0:
        return to_grid(df, fps).select(*grid)
    step = F.lit(SECOND / fps)
    last = F.greatest(F.round(F.col("dur_us") / step), F.lit(1.0)).cast("bigint") - 1
    lo = F.when(F.col("t_us") <= 0, 0).otherwise(F.greatest(F.floor((F.col("t_us") - d_us) / step) - 1, F.lit(0)))
    hi = F.when(F.col("e_us") >= F.col("dur_us"), last).otherwise(F.least(F.ceil((F.col("e_us") + d_us) / step) + 1, last))
    out = df.withColumns({"a_": lo.cast("bigint"), "b_": hi.cast("bigint")}).where("a_ <= b_").withColumn("idx", F.explode(F.sequence("a_", "b_")))
    base = F.round(F.col("idx") * step).cast("bigint")
    times = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.least(F.greatest(base - d_us + F.round(k * F.lit(2.0 * d_us / (n - 1))).cast("bigint"), F.lit(0)), F.col("dur_us") - 1))
    hits = F.size(F.filter(times, lambda s: (F.col("t_us") <= s) & (s < F.col("e_us"))))
    out = out.withColumn("hits_", hits).where("hits_ > 0")
    weighted = F.transform(F.col(px), lambda v: v.cast("bigint") * F.col("hits_"))
    got = out.groupBy("clip_id", "dur_us", "idx").agg(F.collect_list(weighted).alias("all_"), F.sum("hits_").alias("n_"))
    total = F.aggregate(F.slice("all_", 2, 1 << 20), F.get("all_", 0), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    at = lambda i: F.round(i * step).cast("bigint")
    return got.withColumn(px, F.transform(total, lambda v: F.floor(v / F.col("n_")).cast("int"))).withColumns({"t_us": at(F.col("idx")), "e_us": at(F.col("idx") + 1)}).select(*grid)


def delay(samples: DataFrame, delay_us: int, rate: int) -> DataFrame:
    """Samples after a leading silence, which is left out: absent samples are silent."""
    if delay_us < 0:
        raise ParamError("a delay can't be negative")
    return samples.withColumn("i", F.col("i") + delay_us * rate // SECOND)


def silence(spark: SparkSession, rate: int, duration_us: int, channels: int = 1, clip_id: str = "silence") -> DataFrame:
    n = duration_us * rate // SECOND
    return spark.range(n * channels).select(F.lit(clip_id).alias("clip_id"), F.floor(F.col("id") / channels).alias("i"), (F.col("id") % channels).cast("int").alias("ch"), F.lit(0.0).alias("v"))


def zero_filled(samples: DataFrame, n: int, channels: int = 1) -> DataFrame:
    """Every sample 0 .. n-1 of every clip, 0 where there was none."""
    clips = samples.select("clip_id").distinct()
    grid = clips.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))).withColumn("ch", F.explode(F.array(*[F.lit(c) for c in range(channels)])))
    return grid.join(samples.select("clip_id", "i", F.col("ch").cast("int").alias("ch"), "v"), ["clip_id", "i", "ch"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def keyframes(points: DataFrame, keys: DataFrame, t: str = "t_us", group: tuple[str, ...] = ("clip_id",)) -> DataFrame:
    """points with ``value`` of the keyframes ``t_us, value, easing`` of their group: the ends hold.

    easing is the left key's: hold, linear or smooth.  A group without keys gives 0.
    """
    w = Window.partitionBy(*group).orderBy("t_us", "value")
    spans = keys.select(*group, F.col("t_us").alias("ta_"), F.col("value").alias("va_"), "easing", F.lead("t_us").over(w).alias("tb_"), F.lead("value").over(w).alias("vb_"))
    heads = keys.groupBy(*group).agg(F.min_by("value", F.struct("t_us", "value")).alias("head_"))
    got = asof_join(points, spans, list(group), t, "ta_", ["ta_", "va_", "tb_", "vb_", "easing"]).join(heads, list(group), "left")
    u = (F.col(t) - F.col("ta_")) / F.greatest(F.col("tb_") - F.col("ta_"), F.lit(1))
    eased = F.when(F.col("easing") == "hold", 0.0).when(F.col("easing") == "smooth", u * u * (F.lit(3.0) - u * 2.0)).otherwise(u)
    value = F.when(F.col("ta_").isNull(), F.coalesce("head_", F.lit(0.0))).when(F.col("tb_").isNull(), F.col("va_")).otherwise(F.col("va_") + (F.col("vb_") - F.col("va_")) * eased)
    return got.withColumn("value", value).drop("ta_", "va_", "tb_", "vb_", "easing", "head_")


def timing_index(points: DataFrame, group: tuple[str, ...] = ("clip_id",), t: str = "pts_us") -> DataFrame:
    """Distinct non-negative times with their ordinal and duration (null for the last)."""
    w = Window.partitionBy(*group).orderBy(t)
    ok = points.where(F.col(t).isNotNull() & (F.col(t) >= 0)).select(*group, t).distinct()
    return ok.select(*group, t, (F.row_number().over(w) - 1).cast("bigint").alias("ordinal"), (F.lead(t).over(w) - F.col(t)).alias("duration_us"))


def frame_index_at(points: DataFrame, index: DataFrame, group: tuple[str, ...] = ("clip_id",), t: str = "t_us") -> DataFrame:
    """points with ``ordinal``: of the last time at or before theirs, 0 before the first."""
    return asof_join(points, index, list(group), t, "pts_us", ["ordinal"]).withColumn("ordinal", F.coalesce("ordinal", F.lit(0).cast("bigint")))


def first_packets(packets: DataFrame, most: int, t: str, streams: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The first packets of each stream by time: what a reader with a limit takes."""
    if most < 0:
        raise ParamError("a limit can't be negative")
    nth = F.row_number().over(Window.partitionBy(*streams).orderBy(t, *order))
    return packets.withColumn("nth_", nth).where(F.col("nth_") <= most).drop("nth_")
