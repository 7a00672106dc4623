"""Pixel arrays as columns: ``array<int>``, rows from the top, channels interleaved.

Positions are moved by :func:`gather`; point operations are :func:`pyspark.sql.functions.transform`.
Whole frames of real size are faster through :mod:`lumitide.operators.frames`, with the same results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def gather(px: Column, w: int, h: int, source: Callable[[Column, Column], tuple[Column, Column]], channels: int = 1, width: int | None = None, fill: int | None = None, height: int | None = None) -> Column:
    """A w x h picture whose pixel (x, y) is px's at source(x, y); fill: for places outside of it."""
    width, height = width or w, height or h

    def at(i: Column) -> Column:
        p, c = F.floor(i / channels).cast("int"), (i % channels).cast("int")
        x, y = source((p % w).cast("int"), F.floor(p / w).cast("int"))
        got = F.get(px, ((y * width + x) * channels + c).cast("int"))
        return got if fill is None else F.when((x >= 0) & (x < width) & (y >= 0) & (y < height), got).otherwise(fill)

    return F.transform(F.sequence(F.lit(0), F.lit(w * h * channels - 1)), at)


def crop(px: Column, width: int, height: int, x: int, y: int, w: int, h: int, channels: int = 1) -> Column:
    if w <= 0 or h <= 0 or x < 0 or y < 0 or x + w > width or y + h > height:
        raise ValueError(f"crop {x},{y} {w}x{h} isn't inside {width}x{height}")
    rows = F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda r: F.slice(px, (r + y) * (width * channels) + (x * channels + 1), w * channels))
    return F.flatten(rows)


def hflip(px: Column, w: int, h: int, channels: int = 1) -> Column:
    if channels == 1:
        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda r: F.reverse(F.slice(px, r * w + 1, w))))
    return gather(px, w, h, lambda x, y: (F.lit(w - 1) - x, y), channels)


def vflip(px: Column, w: int, h: int, channels: int = 1) -> Column:
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda r: F.slice(px, (F.lit(h - 1) - r) * (w * channels) + 1, w * channels)))


def rotate(px: Column, w: int, h: int, degrees: int, channels: int = 1) -> Column:
    """By 90, 180 or 270 degrees clockwise; the first and last swap width and height."""
    turn = degrees % 360
    if turn == 0:
        return px
    if turn == 180:
        return gather(px, w, h, lambda x, y: (F.lit(w - 1) - x, F.lit(h - 1) - y), channels)
    if turn == 90:
        return gather(px, h, w, lambda x, y: (y, F.lit(h - 1) - x), channels, width=w, height=h)
    if turn == 270:
        return gather(px, h, w, lambda x, y: (F.lit(w - 1) - y, x), channels, width=w, height=h)
    raise ValueError("only quarter turns are expressions")


def resize_nearest(px: Column, width: int, height: int, w: int, h: int, channels: int = 1) -> Column:
    return gather(px, w, h, lambda x, y: (F.floor(x * width / w).cast("int"), F.floor(y * height / h).cast("int")), channels, width=width, height=height)


def axis(src: int, dst: int) -> tuple[list[int], list[int], list[int]]:
    """Left and right source index and the left one's weight of 256, centre-aligned, for each target index."""
    lo, hi, weight = [], [], []
    for d in range(dst):
        s = min(max((d + 0.5) * src / dst - 0.5, 0.0), src - 1.0)
        i = int(s)
        lo.append(i)
        hi.append(min(i + 1, src - 1))
        weight.append(int((1.0 - (s - i)) * 256.0 + 0.5))
    return lo, hi, weight


def resize_bilinear(px: Column, width: int, height: int, w: int, h: int, channels: int = 1) -> Column:
    if (w, h) == (width, height):
        return px
    xs, ys = axis(width, w), axis(height, h)
    table = lambda v: F.array(*map(F.lit, v))
    x0, x1, wx = map(table, xs)
    y0, y1, wy = map(table, ys)

    def at(i: Column) -> Column:
        p, c = F.floor(i / channels).cast("int"), (i % channels).cast("int")
        dx, dy = (p % w).cast("int"), F.floor(p / w).cast("int")
        v = lambda x, y: F.get(px, ((y * width + x) * channels + c).cast("int"))
        a, b, m = F.get(x0, dx), F.get(x1, dx), F.get(wx, dx)
        top, low, n = F.get(y0, dy), F.get(y1, dy), F.get(wy, dy)
        first = v(a, top) * m + v(b, top) * (F.lit(256) - m)
        second = v(a, low) * m + v(b, low) * (F.lit(256) - m)
        return F.shiftright(first * n + second * (F.lit(256) - n), 16)

    return F.transform(F.sequence(F.lit(0), F.lit(w * h * channels - 1)), at)


def margin(px: Column, w: int, h: int, size: int, fill: int = 0, channels: int = 1) -> Column:
    return gather(px, w + 2 * size, h + 2 * size, lambda x, y: (x - size, y - size), channels, width=w, height=h, fill=fill)


def shift(px: Column, w: int, h: int, ox: Column, oy: Column, channels: int = 1) -> Column:
    """Moved by an offset; the vacated pixels are 0."""
    return gather(px, w, h, lambda x, y: (x - ox, y - oy), channels, fill=0)


def window(px: Column, width: int, height: int, x0: Column, y0: Column, w: int, h: int, channels: int = 1) -> Column:
    """A crop whose origin is a column."""
    return gather(px, w, h, lambda x, y: (x + x0, y + y0), channels, width=width, height=height)


def scroll_origin(start: float, speed: float, secs: Column, most: int) -> Column:
    return F.least(F.greatest(F.round(F.lit(start) + F.lit(speed) * secs), F.lit(0.0)), F.lit(float(most))).cast("int")


def slide_offset(secs: Column, total: Column, duration: float, side: str, entering: bool, w: int, h: int) -> tuple[Column, Column]:
    """How far off its place a sliding picture is; an unknown side counts as the right one."""
    if entering:
        on = F.least(F.greatest(secs / duration, F.lit(0.0)), F.lit(1.0))
    else:
        start = F.greatest(total - duration, F.lit(0.0))
        on = F.when(secs < start, 1.0).otherwise(1.0 - F.least(F.greatest((secs - start) / duration, F.lit(0.0)), F.lit(1.0)))
    off = F.lit(1.0) - on
    whole = lambda v: v.cast("int")  # noqa: E731  cuts towards zero
    zero = F.lit(0)
    return {"left": (whole(-off * w), zero), "top": (zero, whole(-off * h)), "bottom": (zero, whole(off * h))}.get(side, (whole(off * w), zero))


def each(px: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(px, f)


def clamp8(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0)), F.lit(255)).cast("int")


def invert(px: Column) -> Column:
    return each(px, lambda v: F.lit(255) - v)


def multiply(px: Column, factor: float) -> Column:
    scale = int(min(max(factor, 0.0), 16.0) * 256 + 0.5)
    return each(px, lambda v: F.least(F.lit(255), F.shiftright(v * scale, 8)))


def gamma_table(g: float) -> list[int]:
    g = max(g, 1e-4)
    return [int(min(255.0, (i / 255.0) ** g * 255.0 + 0.5)) for i in range(256)]


def gamma(px: Column, g: float) -> Column:
    table = F.array(*map(F.lit, gamma_table(g)))
    return each(px, lambda v: F.get(table, v))


def lum_contrast(px: Column, lum: float, contrast: float) -> Column:
    return each(px, lambda v: clamp8(F.round((v - 128.0) * contrast + 128.0 + lum)))


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(r * 77 + g * 150 + b * 29, 8)


def black_and_white(px: Column, w: int, h: int) -> Column:
    """Of RGB pixels; all three channels get the luma."""
    grey = F.transform(F.sequence(F.lit(0), F.lit(w * h - 1)), lambda p: luma(F.get(px, p * 3), F.get(px, p * 3 + 1), F.get(px, p * 3 + 2)))
    return F.flatten(F.transform(grey, lambda v: F.array(v, v, v)))


def to_rgb(px: Column) -> Column:
    return F.flatten(F.transform(px, lambda v: F.array(v, v, v)))


def fade(px: Column, amount: Column, colour: int = 0) -> Column:
    """Towards a colour, in steps of 1/256."""
    a = F.round(F.least(F.greatest(amount, F.lit(0.0)), F.lit(1.0)) * 256).cast("int")
    return each(px, lambda v: F.shiftright(v * (F.lit(256) - a) + a * colour, 8))


def fade_in_amount(secs: Column, duration: float) -> Column:
    return F.when(secs >= duration, 0.0).otherwise(F.lit(1.0) - secs / duration)


def fade_out_amount(secs: Column, total: Column, duration: float) -> Column:
    start = F.greatest(total - duration, F.lit(0.0))
    return F.when(secs <= start, 0.0).otherwise(F.least((secs - start) / duration, F.lit(1.0)))


def mask_color(px: Column, colour: tuple[int, ...], threshold: int, w: int, h: int) -> Column:
    """0 where all channels are within threshold of the colour, else 1."""
    n = len(colour)
    near = lambda p: [F.abs(F.get(px, p * n + k) - v) <= threshold for k, v in enumerate(colour)]

    def at(p: Column) -> Column:
        hit = near(p)
        every = hit[0]
        for x in hit[1:]:
            every = every & x
        return F.when(every, 0).otherwise(1)

    return F.transform(F.sequence(F.lit(0), F.lit(w * h - 1)), at)


def masks_and(a: Column, b: Column) -> Column:
    """Pixelwise minimum; a missing mask is opaque, masks of two sizes give the first."""
    return F.when(b.isNull() | (F.size(a) != F.size(b)), a).when(a.isNull(), b).otherwise(F.zip_with(a, b, lambda x, y: F.least(x, y)))


def masks_or(a: Column, b: Column) -> Column:
    ones = lambda m: F.transform(m, lambda v: F.lit(1).cast("int"))
    return F.when(b.isNull(), ones(a)).when(a.isNull(), ones(b)).when(F.size(a) != F.size(b), a).otherwise(F.zip_with(a, b, lambda x, y: F.greatest(x, y)))


def premultiply(px: Column, w: int, h: int) -> Column:
    """Of RGBA pixels."""

    def at(i: Column) -> Column:
        v, a = F.get(px, i), F.get(px, (i - i % 4 + 3).cast("int"))
        return F.when(i % 4 == 3, v).otherwise(F.floor((v * a + 127) / 255).cast("int"))

    return F.transform(F.sequence(F.lit(0), F.lit(w * h * 4 - 1)), at)


def unpremultiply(px: Column, w: int, h: int) -> Column:
    def at(i: Column) -> Column:
        v, a = F.get(px, i), F.get(px, (i - i % 4 + 3).cast("int"))
        return F.when(i % 4 == 3, v).when(a == 0, 0).otherwise(F.least(F.lit(255), F.round(v * 255.0 / F.when(a > 0, a)).cast("int")))

    return F.transform(F.sequence(F.lit(0), F.lit(w * h * 4 - 1)), at)


def pixelate(px: Column, w: int, h: int, block: int) -> Column:
    """Each pixel gets the rounded mean of its block, which ends at the picture's edge."""
    bw = -(-w // block)

    def mean(k: Column) -> Column:
        bx, by = (k % bw) * block, F.floor(k / bw).cast("int") * block
        xs = F.sequence(bx.cast("int"), F.least(bx + block, F.lit(w)).cast("int") - 1)
        ys = F.sequence(by.cast("int"), F.least(by + block, F.lit(h)).cast("int") - 1)
        cells = F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.get(px, (y * w + x).cast("int")))))
        return F.round(F.aggregate(cells, F.lit(0), lambda a, v: a + v) / F.size(cells)).cast("int")

    means = F.transform(F.sequence(F.lit(0), F.lit(bw * (-(-h // block)) - 1)), mean)
    return F.transform(F.sequence(F.lit(0), F.lit(w * h - 1)), lambda i: F.get(means, (F.floor(F.floor(i / w) / block) * bw + F.floor((i % w) / block)).cast("int")))


def blend(dst: Column, src: Column, opacity: Column) -> Column:
    """src over dst, each pixel rounded to 8 bits."""
    o = F.least(F.greatest(opacity, F.lit(0.0)), F.lit(1.0))
    return F.zip_with(dst, src, lambda d, s: F.round(s * o + d * (F.lit(1.0) - o)).cast("int"))


def rle_decode(runs: Column) -> Column:
    """Of ``array<struct<count, value>>``."""
    return F.flatten(F.transform(runs, lambda r: F.array_repeat(r["value"], r["count"].cast("int"))))


def rle_total(runs: Column) -> Column:
    return F.aggregate(runs, F.lit(0).cast("bigint"), lambda a, r: a + r["count"].cast("bigint"))
