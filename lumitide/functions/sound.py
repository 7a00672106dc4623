"""Sample values and positions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .mediatime import col


def gain(v: Column, factor) -> Column:
    return v * col(factor)


def stereo_gain(v: Column, ch: Column, left, right) -> Column:
    """Channel 0 by left, channel 1 by right, others as they are."""
    return F.when(ch == 0, v * col(left)).when(ch == 1, v * col(right)).otherwise(v)


def _unit(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def fade_in(v: Column, secs: Column, duration) -> Column:
    return v * _unit(secs / col(duration))


def fade_out(v: Column, secs: Column, total: Column, duration) -> Column:
    start = F.greatest(total - col(duration), F.lit(0.0))
    return v * (F.lit(1.0) - _unit((secs - start) / col(duration)))


def clip1(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(-1.0)), F.lit(1.0))


def frames_for(secs, rate) -> Column:
    """Whole samples of a duration, cut off."""
    return (col(secs) * col(rate)).cast("bigint")


def resample(pcm: Column, rate: int, target: int, channels: int = 1) -> Column:
    """Linear resampling of an interleaved array; the last sample holds."""
    if rate == target:
        return pcm
    n = F.floor(F.size(pcm) / channels)
    out = F.floor(n * target / rate)

    def at(k: Column) -> Column:
        i, c = F.floor(k / channels), k % channels
        pos = i.cast("double") * rate / target
        lo = F.floor(pos)
        part = pos - lo
        v = lambda j: F.get(pcm, (F.least(j, n - 1) * channels + c).cast("int"))
        return v(lo) * (F.lit(1.0) - part) + v(lo + 1) * part

    empty = F.expr("cast(array() as array<double>)")
    return F.when(out > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), out * channels - 1), at)).otherwise(empty)


def drift_ok(video_secs, audio_secs, fps) -> Column:
    """Whether both streams end together, but for a frame and 50 ms."""
    return F.abs(col(video_secs) - col(audio_secs)) <= F.lit(1.0) / col(fps) + 0.05


def cue_duration(start: Column, end: Column) -> Column:
    return F.greatest(end - start, F.lit(0.0))
