"""Writers: sampled frames and chunks of samples to Parquet, documents to JSON."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ParamError
from ..kernels.pictures import EvenSize, Resize
from ..operators.frames import apply
from ..operators.timing import to_grid
from .documents import pack


def frames(clip: DataFrame, path: str, fps: float, size: tuple[int, int] | None = None, mode: str = "errorifexists") -> None:
    """The clip sampled at fps, of even size, a folder for each clip."""
    chain = [EvenSize()]
    if size is not None:
        if min(size) < 2:
            raise ParamError("an output has at least 2x2 pixels")
        chain = [Resize(size[0] - size[0] % 2, size[1] - size[1] % 2)]
    apply(to_grid(clip, fps), chain).write.mode(mode).partitionBy("clip_id").parquet(path)


def proxy(clip: DataFrame, path: str, fps: float, box: tuple[int, int] = (640, 360), mode: str = "errorifexists") -> tuple[int, int]:
    """The clip sampled at fps within a box: never larger than it is, of even size; gives that size."""
    row = clip.select("w", "h").first()
    if row is None:
        raise ParamError("a proxy needs pictures")
    scale = min(box[0] / row["w"], box[1] / row["h"], 1.0)
    size = tuple(max(2, max(2, math.floor(v * scale + 0.5)) // 2 * 2) for v in (row["w"], row["h"]))
    frames(clip, path, fps, size, mode)
    return size


def samples(clip: DataFrame, path: str, channels: int, mode: str = "errorifexists") -> None:
    """Chunks of samples, in order of clips; not a folder for each, as clips may be many and short."""
    pack(clip, channels).sortWithinPartitions("clip_id", "i0").write.mode(mode).parquet(path)


def waveform_json(waveform: DataFrame, group: str = "clip_id") -> DataFrame:
    """``group, json``: a waveform document for each clip."""
    peaks = F.array_sort(F.collect_list(F.struct("bucket", F.col("lo").alias("min"), F.col("hi").alias("max"))))
    out = waveform.groupBy(group).agg(peaks.alias("p"))
    return out.select(group, F.to_json(F.struct(F.size("p").alias("buckets"), F.transform("p", lambda x: F.struct(x["min"].alias("min"), x["max"].alias("max"))).alias("peaks"))).alias("json"))


def png(px) -> bytes:
    """A PNG of (h, w, 3 or 4) bytes."""
    import struct
    import zlib

    h, w, c = px.shape
    raw = b"".join(b"\0" + px[y].tobytes() for y in range(h))
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw, 6)) + part(b"IEND", b"")


def thumbnail(clip: DataFrame, t_us: int) -> bytes | None:
    """A PNG of the frame at a time; None where there is none.  One row comes to the driver."""
    import numpy as np

    row = clip.where((F.col("t_us") <= t_us) & (F.lit(t_us) < F.col("e_us"))).select("w", "h", "channels", "data").first()
    return None if row is None else png(np.frombuffer(row["data"], np.uint8).reshape(row["h"], row["w"], row["channels"]))
