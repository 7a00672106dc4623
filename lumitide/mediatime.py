"""Exact rational media time on the driver: ticks over a timescale, all in integers."""

from __future__ import annotations

import math
from typing import Any, NamedTuple

from .errors import ParamError

I64 = (-(1 << 63), (1 << 63) - 1)
HZ_90K, HZ_1M, HZ_1K, HZ_1 = 90_000, 1_000_000, 1_000, 1


def clamp(x: int) -> int:
    return max(I64[0], min(I64[1], x))


def round_away(x: float) -> int:
    """To the nearest integer, halves away from zero."""
    return int(math.copysign(math.floor(abs(x) + 0.5), x)) if math.isfinite(x) else 0


class MediaTime(NamedTuple):
    """``ticks / timescale`` seconds.  Equality compares both fields, not the quotient."""

    ticks: int
    timescale: int

    @classmethod
    def of(cls, ticks: int, timescale: int) -> MediaTime:
        if not 0 < timescale < 1 << 32:
            raise ParamError(f"timescale {timescale} is out of range")
        return cls(clamp(ticks), timescale)

    @classmethod
    def from_secs(cls, secs: float, timescale: int = HZ_1M) -> MediaTime:
        if not math.isfinite(secs):
            raise ParamError("time must be finite")
        return cls.of(round_away(secs * timescale), timescale)

    @classmethod
    def from_json(cls, x: Any, timescale: int = HZ_1M) -> MediaTime | None:
        """Of seconds, or of an object with both fields; None for anything else."""
        if isinstance(x, bool):
            return None
        if isinstance(x, (int, float)):
            return cls.from_secs(float(x), timescale) if math.isfinite(x) else None
        if isinstance(x, dict) and isinstance(x.get("ticks"), int) and isinstance(x.get("timescale"), int) and 0 < x["timescale"] < 1 << 32:
            return cls.of(x["ticks"], x["timescale"])
        return None

    def to_json(self) -> dict[str, int]:
        return {"ticks": self.ticks, "timescale": self.timescale}

    @property
    def secs(self) -> float:
        return self.ticks / self.timescale

    @property
    def micros(self) -> int:
        return self.rebase(HZ_1M).ticks

    def rebase(self, timescale: int) -> MediaTime:
        """At another timescale.  A negative half tick rounds down once more than a positive one."""
        n, half = self.ticks * timescale, self.timescale // 2
        return MediaTime.of((n + half if n >= 0 else n - half) // self.timescale, timescale)

    def plus(self, other: MediaTime) -> MediaTime:
        return MediaTime(clamp(self.ticks + other.rebase(self.timescale).ticks), self.timescale)

    def minus(self, other: MediaTime) -> MediaTime:
        return MediaTime(clamp(self.ticks - other.rebase(self.timescale).ticks), self.timescale)

    def over(self, factor: float) -> MediaTime:
        if not (math.isfinite(factor) and factor > 0):
            raise ParamError(f"factor must be above 0, not {factor}")
        return MediaTime(clamp(round_away(self.ticks / factor)), self.timescale)

    def times(self, n: int) -> MediaTime:
        return MediaTime(clamp(self.ticks * n), self.timescale)

    def longest(self, other: MediaTime) -> MediaTime:
        return MediaTime(max(self.ticks, other.rebase(self.timescale).ticks), self.timescale)

    def frame_index(self, fps: float) -> int:
        if self.ticks <= 0 or not (math.isfinite(fps) and fps > 0):
            return 0
        return self.ticks * int(fps) // self.timescale if fps == int(fps) else math.floor(self.ticks * fps / self.timescale)


ZERO_MS = MediaTime(0, HZ_1K)
