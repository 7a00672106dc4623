"""Layout, boxes and regions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .mediatime import col

ANCHORS = ("top_left", "top", "top_right", "left", "center", "right", "bottom_left", "bottom", "bottom_right")


def _half(v: Column) -> Column:
    return (v / 2).cast("int")  # cuts towards zero


def anchor(name, canvas_w, canvas_h, w, h, dx=0, dy=0) -> tuple[Column, Column]:
    """Top left corner of a w x h picture at one of ANCHORS, moved by (dx, dy)."""
    a, cw, ch, w, h = col(name), col(canvas_w), col(canvas_h), col(w), col(h)
    x = F.when(a.isin("top_left", "left", "bottom_left"), F.lit(0)).when(a.isin("top", "center", "bottom"), _half(cw - w)).otherwise(cw - w)
    y = F.when(a.isin("top_left", "top", "top_right"), F.lit(0)).when(a.isin("left", "center", "right"), _half(ch - h)).otherwise(ch - h)
    return (x + dx).cast("int"), (y + dy).cast("int")


def even(n) -> Column:
    return (col(n) - col(n) % 2).cast("int")


def proxy_size(w, h, max_w, max_h) -> Column:
    """``struct<w, h>``: fitted into a box, never larger than the source, even, at least 2."""
    sw, sh = F.greatest(col(w), F.lit(1)), F.greatest(col(h), F.lit(1))
    mw, mh = F.greatest(col(max_w), F.lit(2)), F.greatest(col(max_h), F.lit(2))
    scale = F.least(mw / sw, mh / sh, F.lit(1.0))
    fit = lambda s: F.greatest(even(F.greatest(F.round(s * scale).cast("int"), F.lit(2))), F.lit(2))
    return F.struct(fit(sw).alias("w"), fit(sh).alias("h"))


def one_sided(w, h, width=None, height=None) -> Column:
    """``struct<w, h>`` with one side given, the other by the aspect, at least 1."""
    w, h = col(w), col(h)
    part = lambda n, d: F.greatest(F.floor(n / d), F.lit(1)).cast("int")
    if width is not None:
        return F.struct(col(width).cast("int").alias("w"), part(h * col(width), w).alias("h"))
    return F.struct(part(w * col(height), h).alias("w"), col(height).cast("int").alias("h"))


def from_box(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """``struct<cx, cy, radius>`` of a box: its centre and half its diagonal, at least 1."""
    w, h = F.abs(right - left), F.abs(bottom - top)
    return F.struct((left + w * 0.5).alias("cx"), (top + h * 0.5).alias("cy"), F.greatest(F.sqrt(w * w + h * h) * 0.5, F.lit(1.0)).alias("radius"))


def from_xywh(x: Column, y: Column, w: Column, h: Column) -> Column:
    return from_box(x, y, x + w, y + h)


def soft_mask(distance: Column, radius: Column, feather: float = 0.35) -> Column:
    """1 inside, 0 outside, and a smooth step over the feathered rim."""
    inner = F.greatest(radius - F.greatest(radius * feather, F.lit(0.5)), F.lit(0.0))
    t = (distance - inner) / F.greatest(radius - inner, F.lit(1e-6))
    return F.when(distance <= inner, 1.0).when(distance >= radius, 0.0).otherwise(F.lit(1.0) - t * t * (F.lit(3.0) - t * 2.0))


def contributes(occluded: Column, lifecycle: Column, conf: Column) -> Column:
    """Whether a mask sample makes a region."""
    return ~F.coalesce(occluded, F.lit(False)) & F.coalesce(lifecycle, F.lit("active")).isin("entering", "active", "exiting") & (F.coalesce(conf, F.lit(1.0)) > 0)


def occlusion_contributes(state: Column) -> Column:
    return F.coalesce(state, F.lit("visible")).isin("visible", "partial", "unknown")


def blur_sigma(mean_radius: Column) -> Column:
    return F.greatest(mean_radius * 2.0 / 3.0, F.lit(0.5))


def polygon_box(points: Column) -> Column:
    """``struct<l, t, r, b>`` around ``array<struct<x, y>>``."""
    x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(x).alias("l"), F.array_min(y).alias("t"), F.array_max(x).alias("r"), F.array_max(y).alias("b"))
