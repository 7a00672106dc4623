"""Clips that are made, not read."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ParamError

SECOND = 1_000_000


def _duration(duration_us: int) -> None:
    if duration_us <= 0:
        raise ParamError("a clip's duration must be above 0")


def still(spark: SparkSession, data: bytes, w: int, h: int, duration_us: int, channels: int = 3, clip_id: str = "still") -> DataFrame:
    """One picture for a duration: a single row."""
    _duration(duration_us)
    if len(data) != w * h * channels:
        raise ParamError(f"{len(data)} bytes aren't a picture of {w}x{h}x{channels}")
    row = (clip_id, 0, duration_us, duration_us, w, h, channels, bytearray(data))
    return spark.createDataFrame([row], "clip_id string, t_us long, e_us long, dur_us long, w int, h int, channels int, data binary")


def solid(spark: SparkSession, w: int, h: int, colour: tuple[int, ...], duration_us: int, clip_id: str = "solid") -> DataFrame:
    return still(spark, bytes(colour) * (w * h), w, h, duration_us, len(colour), clip_id)


def gradient(spark: SparkSession, n: int, w: int, h: int, fps: float, clip_id: str = "gradient") -> DataFrame:
    """n moving RGB pictures, made on the executors; for tests and benchmarks."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        y, x = np.arange(h).astype(np.uint8)[:, None], np.arange(w).astype(np.uint8)
        for b in batches:
            for i in b.column("idx").to_pylist():
                px = np.empty((h, w, 3), np.uint8)  # sums wrap as bytes do
                px[..., 0], px[..., 1] = x + np.uint8(i % 256), y + np.uint8(2 * i % 256)
                px[..., 2] = x + y + np.uint8(3 * i % 256)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([px.tobytes()], pa.binary())], names=["idx", "data"])

    made = spark.range(n).withColumnRenamed("id", "idx").mapInArrow(run, "idx long, data binary")
    at = lambda i: F.round(i * F.lit(SECOND / fps)).cast("bigint")
    return made.select(F.lit(clip_id).alias("clip_id"), at(F.col("idx")).alias("t_us"), at(F.col("idx") + 1).alias("e_us"), F.lit(round(n * SECOND / fps)).cast("bigint").alias("dur_us"), F.lit(w).alias("w"), F.lit(h).alias("h"), F.lit(3).alias("channels"), "data")


def tone(spark: SparkSession, hz: float, rate: int, duration_us: int, channels: int = 1, clip_id: str = "tone") -> DataFrame:
    _duration(duration_us)
    n = duration_us * rate // SECOND
    i = F.floor(F.col("id") / channels)
    return spark.range(n * channels).select(F.lit(clip_id).alias("clip_id"), i.alias("i"), (F.col("id") % channels).cast("int").alias("ch"), F.sin(i * F.lit(6.283185307179586 * hz / rate)).alias("v"))


#: Rows of the 5x7 glyphs, five bits each; the repertoire is what captions need.
GLYPHS = {
    "0": "0E11131519110E", "1": "040C040404040E", "2": "0E11010204081F", "3": "1F02040201110E", "4": "02060A121F0202", "5": "1F101E0101110E", "6": "0608101E11110E", "7": "1F010204080808", "8": "0E11110E11110E", "9": "0E11110F01020C",
    "A": "0E11111F111111", "B": "1E11111E11111E", "C": "0E11101010110E", "D": "1C12111111121C", "E": "1F10101E10101F", "F": "1F10101E101010", "G": "0E11101711110F", "H": "1111111F111111", "I": "0E04040404040E", "J": "0702020202120C", "K": "11121418141211", "L": "1010101010101F", "M": "111B1515111111",
    "N": "11111915131111", "O": "0E11111111110E", "P": "1E11111E101010", "Q": "0E11111115120D", "R": "1E11111E141211", "S": "0F10100E01011E", "T": "1F040404040404", "U": "1111111111110E", "V": "11111111110A04", "W": "1111111515150A", "X": "11110A040A1111", "Y": "11110A04040404", "Z": "1F01020408101F",
    " ": "00000000000000", ".": "00000000000C0C", ",": "000000000C0408", "!": "04040404040004", "?": "0E110102040004", ":": "000C0C000C0C00", "-": "0000001F000000", "'": "0C040800000000",
}


def layout(text: str, size: int = 8) -> tuple[int, int, list[tuple[str, int, int]]]:
    """Width, height and the pen position of each character; every line has the same height."""
    scale = max(1, size // 8)
    lines = text.split("\n")
    out = [(c, k * 6 * scale, n * 8 * scale) for n, line in enumerate(lines) for k, c in enumerate(line)]
    return max((len(x) for x in lines), default=0) * 6 * scale, len(lines) * 8 * scale, out


@functools.cache
def glyph(c: str, scale: int = 1):
    """(7 * scale, 5 * scale) of 0 and 255; a box for what has no glyph."""
    import numpy as np

    rows = bytes.fromhex(GLYPHS.get(c.upper(), "1F11111111111F"))
    return np.array([[r >> (4 - k) & 1 for k in range(5)] for r in rows], np.uint8).repeat(scale, 0).repeat(scale, 1) * 255


def raster(text: str, colour: tuple[int, int, int] = (255, 255, 255), size: int = 8, view: tuple[int, int, int, int] | None = None):
    """(h, w, 4) of the text; alpha is its coverage.  Characters without a glyph are drawn as boxes.

    view: left, top, right and bottom of the part that is wanted; only its characters are drawn.
    """
    import numpy as np

    w, h, pens = layout(text, size) if view is None else (0, 0, [])
    scale = max(1, size // 8)
    x0, y0, x1, y1 = view or (0, 0, max(1, w), max(1, h))
    if view is not None:
        first, last = x0 // (6 * scale), -(-x1 // (6 * scale))
        lines = text.split("\n")[y0 // (8 * scale) : -(-y1 // (8 * scale))]
        pens = [(c, k * 6 * scale, n * 8 * scale) for n, line in enumerate(lines, y0 // (8 * scale)) for k, c in enumerate(line[first:last], first)]
    out = np.zeros((y1 - y0, x1 - x0, 4), np.uint8)
    out[..., :3] = np.array(colour, np.uint8)
    for c, x, y in pens:
        bits = glyph(c, scale)[max(0, y0 - y) : y1 - y, max(0, x0 - x) : x1 - x]
        part = out[max(0, y - y0) : max(0, y - y0) + bits.shape[0], max(0, x - x0) : max(0, x - x0) + bits.shape[1], 3]
        np.maximum(part, bits, out=part)
    return out


def text_clip(spark: SparkSession, text: str, duration_us: int, colour: tuple[int, int, int] = (255, 255, 255), size: int = 8, clip_id: str = "text") -> DataFrame:
    px = raster(text, colour, size)
    return still(spark, px.tobytes(), px.shape[1], px.shape[0], duration_us, 4, clip_id)
