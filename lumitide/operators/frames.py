"""Pictures as rows, and chains of kernels over them in one Arrow pass.

``clip_id, t_us, e_us, dur_us, w, h, channels, data`` (and ``idx`` after sampling): ``data`` holds
the bytes of a picture, rows from the top.  A chain of kernels runs in one Python step, however long
it is; time columns aren't touched by it, so that time filters written after it still reach the scan.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

from ..errors import MediaError
from ..kernels.masks import Decoder, Region, redact
from ..kernels.pictures import Crop, Kernel, Times

#: Pictures are handed over in batches of about so many bytes, small ones stacked, and so many at most.
STACK_BYTES, STACK_ROWS = 8 << 20, 1024


def batched(spark: SparkSession, records: int = 32) -> None:
    """Bounds the rows of an Arrow batch, and of a batch read from Parquet, for relations whose rows are pictures of megabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(records))


def _stacks(b: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Ranges of rows of one size, of bounded bytes."""
    shape = list(zip(*(b.column(c).to_pylist() for c in ("w", "h", "channels"))))
    i = 0
    while i < len(shape):
        w, h, c = shape[i]
        most = min(STACK_ROWS, max(1, STACK_BYTES // max(1, (w or 0) * (h or 0) * (c or 0))))
        j = i + 1
        while j < len(shape) and shape[j] == shape[i] and j - i < most:
            j += 1
        yield i, j
        i = j


def _parts(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Of ``STACK_ROWS`` at most, so that Python objects are made of few rows at a time."""
    return (b.slice(i, STACK_ROWS) for i in range(0, b.num_rows, STACK_ROWS))


def pictures(b: pa.RecordBatch) -> np.ndarray:
    """(n, h, w, channels) of rows of one size."""
    w, h, c = (b.column(k)[0].as_py() for k in ("w", "h", "channels"))
    data = b.column("data")
    size = w * h * c
    offsets = np.frombuffer(data.buffers()[1], np.int32, len(data) + 1 + data.offset)[data.offset :]
    if (np.diff(offsets) != size).any() or data.null_count:
        raise MediaError(f"a picture of {w}x{h}x{c} has other than {size} bytes")
    return np.frombuffer(data.buffers()[2], np.uint8, size * len(data), int(offsets[0])).reshape(len(data), h, w, c)


def _binary(px: np.ndarray) -> pa.Array:
    n = len(px)
    px = np.ascontiguousarray(px)
    size = px.nbytes // max(1, n)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, size * n + 1, max(1, size), dtype=np.int32)[: n + 1]), pa.py_buffer(px)])


def apply(frames: DataFrame, kernels: Sequence[Kernel]) -> DataFrame:
    """Frames after all kernels, in one pass."""
    if not kernels:
        return frames
    names = frames.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i, j in _stacks(whole):
                b = whole.slice(i, j - i)
                px = pictures(b)
                secs = lambda c, b=b: np.asarray(b.column(c)).astype(float) / 1e6
                at = Times(secs("t_us"), secs("dur_us"))
                for k in kernels:
                    k.size(px.shape[2], px.shape[1])  # raises where the picture is too small
                    px = k(px, at)
                n, h, w, c = px.shape
                new = {"w": pa.array(np.full(n, w, np.int32)), "h": pa.array(np.full(n, h, np.int32)), "channels": pa.array(np.full(n, c, np.int32)), "data": _binary(px)}
                yield pa.RecordBatch.from_arrays([new.get(x, b.column(x)) for x in names], names=names)

    return frames.select(*[F.col(x).cast("int").alias(x) if x in ("w", "h", "channels") else F.col(x) for x in names]).mapInArrow(run, _schema(frames))


def _schema(frames: DataFrame):
    return frames.select(*[F.col(x).cast("int").alias(x) if x in ("w", "h", "channels") else F.col(x) for x in frames.columns]).schema


def redacted(frames: DataFrame, style: str = "gaussian", amount: float = 12.0, colour: tuple[int, int, int, int] = (0, 0, 0, 255), feather: float = 0.35, min_conf: float = 0.05) -> DataFrame:
    """Frames with the regions of their ``regions`` column (``array<struct<cx, cy, radius, conf>>``) hidden; the column is dropped.

    A region with an ``asset`` that decodes is hidden by that coverage, others by a feathered disc.
    """
    names = [c for c in frames.columns if c != "regions"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder()
        for whole in batches:
            for i, j in _stacks(whole):
                b = whole.slice(i, j - i)
                px = pictures(b)
                rows = [[Region(r["cx"], r["cy"], max(r["radius"], 1.0), r["conf"], decode(r.get("asset"))) for r in rs or []] for rs in b.column("regions").to_pylist()]
                out = np.stack([redact(p, r, style, amount, colour, feather, min_conf) for p, r in zip(px, rows)])
                yield pa.RecordBatch.from_arrays([_binary(out) if x == "data" else b.column(x) for x in names], names=names)

    return frames.mapInArrow(run, frames.select(*names).schema)


def captioned(frames: DataFrame, room: int = 24) -> DataFrame:
    """RGB frames with the texts of their ``cues`` column over each other, centred, ``room`` above the bottom; the column is dropped."""
    from functools import lru_cache

    from ..kernels.pictures import over
    from ..sources.generate import raster

    names = [c for c in frames.columns if c != "cues"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(256)
        def text(cue: str, w: int, h: int) -> tuple | None:
            """What is seen of a cue on a canvas, and where."""
            lines = cue.split("\n")
            tw, th = max(map(len, lines)) * 6, len(lines) * 8
            x, y = (w - tw) // 2, h - th - room
            view = max(0, -x), max(0, -y), min(tw, w - x), min(th, h - y)
            return (raster(cue, view=view), x + view[0], y + view[1]) if view[0] < view[2] and view[1] < view[3] else None

        for whole in batches:
            for i, j in _stacks(whole):
                b = whole.slice(i, j - i)
                px = pictures(b)
                out = np.zeros((*px.shape[:3], 3), np.uint8)
                for k, cues in enumerate(b.column("cues").to_pylist()):
                    over(out[k], px[k] if px.shape[-1] > 1 else px[k].repeat(3, -1), 0, 0, 1.0)
                    for cue in cues or []:
                        seen = text(cue, px.shape[2], px.shape[1])
                        if seen is not None:
                            over(out[k], *seen, 1.0)
                yield pa.RecordBatch.from_arrays([_binary(out) if x == "data" else pa.array(np.full(len(out), 3, np.int32)) if x == "channels" else b.column(x) for x in names], names=names)

    return frames.select(*[F.col(x).cast("int").alias(x) if x == "channels" else F.col(x) for x in frames.columns]).mapInArrow(run, _schema(frames.select(*names)))


def packed(df: DataFrame, columns: Sequence[str], names: Sequence[str]) -> DataFrame:
    """df with columns of ``array<int>`` as bytes under other names behind the rest, all in one pass."""
    keep = [c for c in df.columns if c not in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _parts(whole):
                flat = (b.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.uint8).reshape(b.num_rows, -1) for c in columns)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *map(_binary, flat)], names=[*keep, *names])

    schema = df.select(*keep).schema
    for n in names:
        schema = schema.add(n, BinaryType())
    return df.select(*keep, *[F.col(c).cast("array<int>").alias(c) for c in columns]).mapInArrow(run, schema)


def from_arrays(df: DataFrame, px: str, w: int, h: int, channels: int = 1) -> DataFrame:
    """Frames of ``array<int>`` pixels."""
    return packed(df, [px], ["data"]).select("*", F.lit(w).alias("w"), F.lit(h).alias("h"), F.lit(channels).alias("channels"))


def to_arrays(frames: DataFrame, px: str = "px") -> DataFrame:
    names = [c for c in frames.columns if c != "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _parts(whole):
                lists = pa.array([np.frombuffer(d, np.uint8).astype(np.int32) for d in b.column("data").to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], lists], names=[*names, px])

    return frames.mapInArrow(run, frames.select(*names).schema.add(px, ArrayType(IntegerType())))


def freeze_region(frames: DataFrame, at_us: int, x: int, y: int, w: int, h: int) -> DataFrame:
    """The patch that is at (x, y) at a time, pasted onto every frame of its clip.

    A clip without a frame at that time stays as it is.
    """
    patch = apply(frames.where((F.col("t_us") <= at_us) & (F.lit(at_us) < F.col("e_us"))).select("clip_id", "t_us", "dur_us", "w", "h", "channels", "data"), [Crop(x, y, w, h)])
    both = frames.join(patch.select("clip_id", F.col("data").alias("patch_")), "clip_id", "left")
    names = frames.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i, j in _stacks(whole):
                b = whole.slice(i, j - i)
                px = pictures(b).copy()
                for k, d in enumerate(b.column("patch_").to_pylist()):
                    if d is not None:
                        px[k, y : y + h, x : x + w] = np.frombuffer(d, np.uint8).reshape(h, w, px.shape[-1])
                yield pa.RecordBatch.from_arrays([_binary(px) if c == "data" else b.column(c) for c in names], names=names)

    return both.select(*names, "patch_").mapInArrow(run, frames.schema)


def surfaces_to_rgb(surfaces: DataFrame) -> DataFrame:
    """``..., format, w, h, planes array<binary>, colour_space, colour_range`` to frames of RGB."""
    from ..kernels.surfaces import to_rgb

    keep = [c for c in surfaces.columns if c not in ("format", "planes", "colour_space", "colour_range")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _parts(whole):
                cols = [b.column(c).to_pylist() for c in ("format", "w", "h", "planes", "colour_space", "colour_range")]
                data = pa.array([to_rgb(f, w, h, p, None, s, r).tobytes() for f, w, h, p, s, r in zip(*cols)], pa.binary())
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(np.full(b.num_rows, 3, np.int32)), data], names=[*keep, "channels", "data"])

    return surfaces.mapInArrow(run, surfaces.select(*keep).schema.add("channels", IntegerType()).add("data", BinaryType()))
