"""Small values from probe and track documents, as columns; what doesn't parse is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def frame_rate(text: Column) -> Column:
    """``n/d`` or a number; null unless above 0."""
    parts = F.split(F.trim(text), "/")
    rate = F.try_divide(F.get(parts, 0).try_cast("double"), F.coalesce(F.get(parts, 1).try_cast("double"), F.when(F.size(parts) == 1, F.lit(1.0))))
    return F.when(rate > 0, rate)


def time_base(text: Column) -> Column:
    """``struct<num, den>`` of ``n/d``."""
    parts = F.split(F.trim(text), "/")
    n, d = F.get(parts, 0).try_cast("bigint"), F.get(parts, 1).try_cast("bigint")
    return F.when((n > 0) & (d > 0), F.struct(n.alias("num"), d.alias("den")))


def occlusion(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.isin("visible", "partial", "occluded", "unknown"), low)


def _tag(text: Column, names: dict[str, tuple[str, ...]]) -> Column:
    low = F.lower(F.trim(text))
    return F.coalesce(*[F.when(low.isin(*tags), value) for value, tags in names.items()], F.lit("unspecified"))


def colour_range(text: Column) -> Column:
    return _tag(text, {"full": ("pc", "full", "jpeg"), "limited": ("tv", "limited", "mpeg")})


def colour_space(text: Column) -> Column:
    return _tag(text, {"bt709": ("bt709",), "bt601": ("smpte170m", "bt470bg", "bt601"), "bt2020": ("bt2020nc", "bt2020c", "bt2020"), "rgb": ("gbr", "rgb")})


def pixel_format(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.isin("yuv420p", "yuvj420p"), "yuv420p").when(low == "rgb24", "rgb8").when(low == "rgba", "rgba8").when(low == "bgra", "bgra8").when(low == "nv12", "nv12")


def varies(avg: Column, real: Column, n_frames: Column, secs: Column) -> Column:
    """Whether the frame rate varies: rates 2 % apart, or a frame count 5 % off the average rate's."""
    apart = F.abs(avg - real) / F.greatest(avg, real) > 0.02
    want = F.round(secs * avg)
    off = F.abs(n_frames - want) / F.greatest(want, F.lit(1.0)) > 0.05
    return F.coalesce(apart & (avg > 0) & (real > 0), F.lit(False)) | F.coalesce(off & (n_frames > 0) & (secs > 0) & (avg > 0), F.lit(False))


def normalised_hash(text: Column) -> Column:
    """Lower case, without a ``sha256:`` prefix."""
    return F.regexp_replace(F.lower(F.trim(text)), "^sha256:", "")
