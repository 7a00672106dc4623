"""Media time as a column: ``struct<ticks: bigint, timescale: bigint>``.

Products are made in decimals and clamped to 64 bits; an invalid timescale or a value that isn't
finite gives null rather than failing a job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..mediatime import I64

WIDE = "decimal(38,0)"


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def wide(x) -> Column:
    return col(x).cast(WIDE)


def saturate(x: Column) -> Column:
    """A decimal clamped to a bigint."""
    return F.least(F.greatest(x, wide(I64[0])), wide(I64[1])).cast("bigint")


def floor_div(num: Column, den) -> Column:
    """Floor of num / den for decimals without fraction, den > 0."""
    den = wide(den)
    rest = F.pmod(num, den)
    return ((num - rest) / den).cast(WIDE)


def media_time(ticks, timescale) -> Column:
    scale = col(timescale).cast("bigint")
    made = F.struct(col(ticks).cast("bigint").alias("ticks"), scale.alias("timescale"))
    return F.when((scale > 0) & (scale < 1 << 32), made)


def from_secs(secs, timescale) -> Column:
    s, scale = col(secs).cast("double"), col(timescale)
    x = F.round(s * scale)
    bounded = F.when(x >= float(I64[1]), F.lit(I64[1])).when(x <= float(I64[0]), F.lit(I64[0])).otherwise(x.cast("bigint"))
    finite = ~F.isnan(s) & (F.abs(s) < float("inf"))
    return F.when(finite, media_time(bounded, scale))


def from_pts(pts, num, den) -> Column:
    return media_time(saturate(wide(pts) * col(num).cast("decimal(10,0)")), den)


def to_secs(t: Column) -> Column:
    return t["ticks"].cast("double") / t["timescale"]


def rebase(t: Column, timescale) -> Column:
    """At another timescale; a negative half tick rounds down once more than a positive one."""
    n = t["ticks"].cast("decimal(19,0)") * col(timescale).cast("decimal(10,0)")
    half = F.floor(t["timescale"] / 2).cast("decimal(10,0)")
    moved = F.when(n >= 0, n + half).otherwise(n - half).cast(WIDE)
    return media_time(saturate(floor_div(moved, t["timescale"])), timescale)


def _sum(a: Column, b: Column, sign: int) -> Column:
    return media_time(saturate(wide(a["ticks"]) + sign * wide(rebase(b, a["timescale"])["ticks"])), a["timescale"])


def add(a: Column, b: Column) -> Column:
    return _sum(a, b, 1)


def subtract(a: Column, b: Column) -> Column:
    return _sum(a, b, -1)


def longest(a: Column, b: Column) -> Column:
    return media_time(F.greatest(a["ticks"], rebase(b, a["timescale"])["ticks"]), a["timescale"])


def over(t: Column, factor) -> Column:
    f = col(factor).cast("double")
    return F.when(f > 0, media_time(F.round(t["ticks"] / f).cast("bigint"), t["timescale"]))


def times(t: Column, n) -> Column:
    return media_time(saturate(t["ticks"].cast("decimal(19,0)") * col(n).cast("decimal(10,0)")), t["timescale"])


def since(a: Column, b: Column) -> Column:
    """a - b of the same timescale; null for two timescales."""
    return F.when(a["timescale"] == b["timescale"], media_time(saturate(wide(a["ticks"]) - wide(b["ticks"])), a["timescale"]))


def frame_index(t: Column, fps) -> Column:
    f = col(fps).cast("double")
    whole = floor_div((t["ticks"].cast("decimal(19,0)") * f.cast("decimal(10,0)")).cast(WIDE), t["timescale"])
    part = F.floor(t["ticks"] * f / t["timescale"])
    return F.when((t["ticks"] <= 0) | (f <= 0), F.lit(0)).when(f == F.floor(f), saturate(whole)).otherwise(part).cast("bigint")


def frame_range(start: Column, end: Column, fps) -> Column:
    """``struct<first, stop>``, half-open; empty ranges give (first, first)."""
    a, b = frame_index(start, fps), frame_index(end, fps)
    return F.struct(a.alias("first"), F.greatest(a, b).alias("stop"))


def as_nanos(t: Column) -> Column:
    n = (t["ticks"].cast("decimal(19,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")).cast(WIDE)
    rest = n % wide(t["timescale"])
    return saturate(((n - rest) / wide(t["timescale"])).cast(WIDE))


def from_json(text: Column, timescale: int = 1_000_000) -> Column:
    """Of a JSON number of seconds or of an object with both fields; null for anything else."""
    ticks, scale = (F.get_json_object(text, f"$.{k}").try_cast("bigint") for k in ("ticks", "timescale"))
    number = text.try_cast("double")
    return F.when(number.isNotNull(), from_secs(number, timescale)).otherwise(F.when(ticks.isNotNull(), media_time(ticks, scale)))


def audio_index(t: Column, rate) -> Column:
    """The sample that sounds at t."""
    n = (t["ticks"].cast("decimal(19,0)") * col(rate).cast("decimal(10,0)")).cast(WIDE)
    return saturate(floor_div(n, t["timescale"]))


def frame_count(duration_secs, fps) -> Column:
    """Frames of a grid: rounded, at least 1; 0 for an invalid duration or rate."""
    d, f = col(duration_secs).cast("double"), col(fps).cast("double")
    return F.when((d > 0) & (f > 0), F.greatest(F.lit(1), F.round(d * f).cast("bigint"))).otherwise(0).cast("bigint")
