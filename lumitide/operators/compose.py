"""Joining clips in time: one after the other, over each other, and mixed."""

from __future__ import annotations

import math
from bisect import insort
from collections import deque
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ContractError, ParamError
from ..functions.sound import clip1
from .intervals import interval_join

#: Result bytes, and grid points, of a stretch of the grid that one call composes at most.
STRETCH_BYTES, STRETCH_POINTS = 16 << 20, 4096


def running_ends(clips: DataFrame, order: Sequence[str], duration: str, group: Sequence[str] = ()) -> DataFrame:
    """clips with ``start_us`` and ``end_us`` on a common timeline, one after the other.

    The running sum is made per group; without one, of what should be few rows.
    """
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = clips.withColumn("end_us", F.sum(duration).over(w).cast("bigint"))
    return out.withColumn("start_us", (F.col("end_us") - F.col(duration)).cast("bigint"))


def map_concat_time(points: DataFrame, ends: DataFrame, t: str, group: Sequence[str] = (), width: int = 1_000_000) -> DataFrame:
    """points with the clip that plays at their time and the time within it, ``local_us``."""
    return interval_join(points, ends, t, "start_us", "end_us", group, width).withColumn("local_us", F.col(t) - F.col("start_us"))


def concatenate(parts: Sequence[DataFrame], durations_us: Sequence[int], clip_id: str = "concat") -> DataFrame:
    """Frame relations played one after the other, as one clip."""
    if not parts or any(d <= 0 for d in durations_us):
        raise ParamError("a concatenation needs clips with durations above 0")
    at, total, out = 0, sum(durations_us), None
    for df, d in zip(parts, durations_us):
        moved = df.where(F.col("t_us") < d).withColumns({"e_us": F.least(F.col("e_us"), F.lit(d)) + at, "t_us": F.col("t_us") + at, "dur_us": F.lit(total).cast("bigint"), "clip_id": F.lit(clip_id)})
        out = moved if out is None else out.unionByName(moved)
        at += d
    return out


def concatenate_audio(parts: Sequence[DataFrame], frames: Sequence[int], clip_id: str = "concat") -> DataFrame:
    """Samples played one after the other; reads over a border go on in the next part."""
    at, out = 0, None
    for df, n in zip(parts, frames):
        moved = df.where((F.col("i") >= 0) & (F.col("i") < n)).withColumns({"i": F.col("i") + at, "clip_id": F.lit(clip_id)})
        out = moved if out is None else out.unionByName(moved)
        at += n
    if out is None:
        raise ParamError("a concatenation needs clips")
    return out


def active(t: Column, start: Column, duration: Column) -> Column:
    return (t >= start) & (t < start + duration)


def compose_values(grid: DataFrame, layers: DataFrame, t: str, background: Column, keys: Sequence[str], width: int = 1_000_000, group: Sequence[str] = ()) -> DataFrame:
    """The blended value of all layers that are on at each point of the grid.

    layers: ``start_us, dur_us, layer_index, seq, opacity, value``; they're laid over each other in
    order of layer_index, then seq, with 8-bit rounding after each: an ordered fold, not a sum.
    """
    spans = layers.withColumn("end_us", F.col("start_us") + F.col("dur_us"))
    hit = interval_join(grid, spans, t, "start_us", "end_us", group, width)
    stack = F.array_sort(F.collect_list(F.struct("layer_index", "seq", "opacity", "value")))
    laid = hit.groupBy(*keys).agg(stack.alias("stack_"))
    o = lambda x: F.least(F.greatest(x["opacity"].cast("double"), F.lit(0.0)), F.lit(1.0))
    fold = F.aggregate("stack_", background.cast("double"), lambda a, x: F.round(x["value"] * o(x) + a * (F.lit(1.0) - o(x))))
    out = grid.join(laid, list(keys), "left")
    return out.withColumn("value", F.coalesce(fold, background.cast("double")).cast("int")).withColumn("n_layers", F.coalesce(F.size("stack_"), F.lit(0))).drop("stack_")


def compose_frames(layers: Sequence[dict], w: int, h: int, fps: float, total_us: int, background: tuple[int, int, int] = (0, 0, 0), clip_id: str = "comp", points: tuple[int, int] | None = None) -> DataFrame:
    """Pictures of several clips over each other, on a grid.

    layers: dicts with ``frames`` (clips, each of one clip id) and ``start_us, dur_us, x, y, opacity,
    layer_index``, in input order.  One shuffle, by stretches of the grid that take about ``STRETCH_BYTES``
    of the result, or of ``STRETCH_POINTS`` if that is less: a picture goes once to each stretch that it serves,
    however many grid points these have.  A stretch is gone through once, with the pictures that are on at hand.
    points: the first of the grid's points to be made and the one after the last, all by default.
    """
    from ..kernels.pictures import over
    from .timing import served

    if not layers:
        raise ParamError("a composition needs layers")
    n = max(1, round(total_us * fps / 1e6))
    lo, hi = (0, n) if points is None else (max(0, points[0]), min(n, points[1]))
    per = min(STRETCH_POINTS, max(1, STRETCH_BYTES // max(1, w * h * 3)))
    names = ["layer", "seq", "x", "y", "opacity", "first", "stop", "w", "h", "channels", "data"]
    rows = None
    for seq, layer in enumerate(layers):
        start = int(layer.get("start_us", 0))
        moved = layer["frames"].withColumns({"t_us": F.col("t_us") + start, "e_us": F.col("e_us") + start, "dur_us": F.lit(total_us).cast("bigint")})
        first, stop = served(fps)
        end = math.ceil((start + int(layer["dur_us"]) - 0.5) * fps / 1e6)  # grid points before the layer's end
        fixed = {"layer": F.lit(int(layer.get("layer_index", seq))), "seq": F.lit(seq), "x": F.lit(int(layer.get("x", 0))), "y": F.lit(int(layer.get("y", 0))), "opacity": F.lit(float(layer.get("opacity", 1.0)))}
        one = moved.withColumns({"first": F.greatest(first, F.lit(lo)), "stop": F.least(stop, F.lit(min(hi, end)))}).where("first < stop").withColumns(fixed)
        one = one.select(F.explode(F.sequence(F.floor(F.col("first") / per), F.floor((F.col("stop") - 1) / per))).alias("stretch"), *names)
        rows = one if rows is None else rows.unionByName(one)
    every = rows.sparkSession.range(lo // per, max(-(-hi // per), lo // per)).select(F.col("id").alias("stretch"))  # also where no layer is on
    canvas = np.empty((h, w, 3), np.uint8)
    canvas[...] = np.array(background, np.uint8)

    def run(t: pa.Table) -> pa.Table:
        facts = sorted(zip(*(t.column(c).to_pylist() for c in names[:-1]), range(t.num_rows)), key=lambda r: (r[0] is None, *(r[k] or 0 for k in (0, 1, 5))))
        data, stretch = t.column("data"), t.column("stretch")[0].as_py()
        pictures = {r[-1]: np.frombuffer(data[r[-1]].as_buffer(), np.uint8).reshape(r[8], r[7], r[9]) for r in facts if r[0] is not None}
        idx, out = range(max(lo, stretch * per), min(hi, (stretch + 1) * per)), []
        due = deque(sorted((max(r[5], idx.start), k) for k, r in enumerate(facts) if r[0] is not None))
        on: list[int] = []  # places in facts, which are in the order of layers
        for i in idx:
            on = [k for k in on if i < facts[k][6]]
            while due and due[0][0] <= i:
                insort(on, due.popleft()[1])
            px = canvas.copy()
            for r in (facts[k] for k in on):
                over(px, pictures[r[-1]], r[2], r[3], r[4])
            out.append(px.tobytes())
        return pa.table({"idx": pa.array(idx, pa.int64()), "data": pa.array(out, pa.binary())})

    made = every.join(rows, "stretch", "left").groupBy("stretch").applyInArrow(run, "idx long, data binary")
    at = lambda i: F.round(i * F.lit(1e6 / fps)).cast("bigint")
    return made.select(F.lit(clip_id).alias("clip_id"), "idx", at(F.col("idx")).alias("t_us"), at(F.col("idx") + 1).alias("e_us"), F.lit(total_us).cast("bigint").alias("dur_us"), F.lit(w).alias("w"), F.lit(h).alias("h"), F.lit(3).alias("channels"), "data")


def mix(tracks: Sequence[tuple[DataFrame, float, int]], rate: int, clip_id: str = "mix") -> DataFrame:
    """The clamped sum of sample relations, each (samples, gain, start in microseconds)."""
    out = None
    for df, gain, start_us in tracks:
        first = -(-start_us * rate // 1_000_000)
        one = df.select((F.col("i") + first).alias("i"), "ch", (F.col("v") * max(0.0, float(gain))).alias("v"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ContractError("a mix needs at least one audio input")
    return out.groupBy("i", "ch").agg(F.sum("v").alias("v")).select(F.lit(clip_id).alias("clip_id"), "i", "ch", clip1(F.col("v")).alias("v"))


def mix_groups(samples: DataFrame, group: Sequence[str]) -> DataFrame:
    """As :func:`mix`, of samples that carry their ``gain`` and ``start_i``, for many mixes at once."""
    shifted = samples.withColumns({"i": F.col("i") + F.col("start_i"), "v": F.col("v") * F.greatest(F.col("gain"), F.lit(0.0))})
    return shifted.groupBy(*group, "i", "ch").agg(F.sum("v").alias("v")).withColumn("v", clip1(F.col("v")))
