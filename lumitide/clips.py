"""A clip: relations of one picture stream, one sound stream and masks, with what is known of them."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import MediaError
from .kernels.pictures import Kernel
from .operators import frames, timing

DEFAULT_FPS = 24.0
#: A clip of more pictures isn't taken for stills.
STILLS = 64


@dataclasses.dataclass(frozen=True)
class Clip:
    """Lazy: nothing is computed until the relation is written or read.

    Pixel kernels wait in ``chain`` and are run in one pass when :meth:`pictures` is asked for, so
    retiming that is written after them still comes before them where they don't look at the time.
    """

    video: DataFrame | None
    duration_us: int
    w: int = 0
    h: int = 0
    fps: float | None = None
    audio: DataFrame | None = None
    rate: int = 48_000
    channels: int = 2
    masks: DataFrame | None = None
    chain: tuple[Kernel, ...] = ()
    hints: dict = dataclasses.field(default_factory=dict)
    #: ``video`` made for a span of time only, from and to, where that is cheaper than a filter of all of it.
    part: Callable[[int, int], DataFrame] | None = None

    def replace(self, **changes) -> Clip:
        return dataclasses.replace(self, **({"part": None} if "video" in changes else {}), **changes)

    def kernel(self, k: Kernel) -> Clip:
        if self.video is None:
            raise MediaError("a clip without pictures has no pixels")
        w, h = k.size(self.w, self.h)
        return self.replace(chain=(*self.chain, k), w=w, h=h)

    def _looks_at_time(self) -> bool:
        return any(k.by_time for k in self.chain)

    def pictures(self) -> DataFrame:
        """Frames after the chain; sampled first if a kernel's result changes while a frame is in force."""
        if self.video is None:
            raise MediaError("the clip has no pictures")
        base = timing.to_grid(self.video, self.fps or DEFAULT_FPS).drop("idx") if self._looks_at_time() else self.video
        return frames.apply(base, self.chain)

    def settled(self) -> Clip:
        """With no kernels waiting."""
        return self.replace(video=self.pictures(), chain=()) if self.chain else self

    def timed(self, f: Callable[[DataFrame], DataFrame], duration_us: int, fps: float | None = None) -> Clip:
        """After a change of its frames' times; kernels that look at the time are run before."""
        base = self.settled() if self._looks_at_time() else self
        return base.replace(video=f(base.video) if base.video is not None else None, duration_us=duration_us, fps=fps or self.fps)

    def sampled(self, fps: float) -> DataFrame:
        """Rows ``idx`` on a grid of fps; kernels run after sampling, on the frames of the grid.

        Of a clip without a rate of its own that has ``STILLS`` pictures at most, kernels up to the first one that
        looks at the time run before, once for each picture.
        """
        static = next((k for k, x in enumerate(self.chain) if x.by_time), len(self.chain)) if self.fps is None else 0
        if not static or self.video.select("t_us").limit(STILLS + 1).count() > STILLS:
            return frames.apply(timing.to_grid(self.video, fps), self.chain)
        return frames.apply(timing.spread(frames.apply(self.video, self.chain[:static]), fps), self.chain[static:])

    def around(self, lo_us: int, hi_us: int) -> Clip:
        """With the frames that are in force from lo to hi, both inclusive, or end at lo; before the kernels."""
        video = self.part(lo_us, hi_us) if self.part else self.video
        return self if video is None else self.replace(video=video.where((F.col("t_us") <= hi_us) & (F.col("e_us") >= lo_us)))

    def frame_at(self, t_us: int) -> DataFrame:
        """The frame in force at a time: one row at most; only it goes through the kernels."""
        at = F.lit(t_us)
        row = self.around(t_us, t_us).video.where((F.col("t_us") <= at) & (at < F.col("e_us")))
        return frames.apply(row.withColumn("t_us", at.cast("bigint")), self.chain)


def apply_all(clip: Clip, effects: Sequence[Callable[[Clip], Clip]]) -> Clip:
    for e in effects:
        clip = e(clip)
    return clip
