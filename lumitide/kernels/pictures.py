"""Kernels that move, resample and recolour pictures.

Each is an object with ``size(w, h) -> (w, h)`` and a call on pictures and their times, which may be
stacked along leading axes.  They are pure, so a lost task gives the same rows when it's rerun.
"""

from __future__ import annotations

import dataclasses
import math
from functools import lru_cache

import numpy as np

from ..errors import ParamError
from ..functions.pixels import axis, gamma_table


@dataclasses.dataclass(frozen=True)
class Times:
    """Seconds of each picture and of its clip, as arrays over the leading axis."""

    t: np.ndarray
    total: np.ndarray


class Kernel:
    """Base: keeps the size, keeps alpha.  by_time: whether the result depends on the time."""

    by_time = False

    def size(self, w: int, h: int) -> tuple[int, int]:
        return w, h

    def __call__(self, px: np.ndarray, at: Times) -> np.ndarray:
        raise NotImplementedError


def to_byte(x: np.ndarray) -> np.ndarray:
    """Rounded half away from zero and clamped."""
    return np.clip(np.floor(x + np.float32(0.5)), 0, 255).astype(np.uint8)


def on_colour(px: np.ndarray, f) -> np.ndarray:
    """f of the first three channels, with the rest as it was."""
    if px.shape[-1] <= 3:
        return f(px)
    return np.concatenate([f(px[..., :3]), px[..., 3:]], -1)


@dataclasses.dataclass(frozen=True)
class Crop(Kernel):
    x: int
    y: int
    w: int
    h: int

    def size(self, w, h):
        if self.w <= 0 or self.h <= 0 or self.x < 0 or self.y < 0 or self.x + self.w > w or self.y + self.h > h:
            raise ParamError(f"crop {self.x},{self.y} {self.w}x{self.h} isn't inside {w}x{h}")
        return self.w, self.h

    def __call__(self, px, at):
        return px[..., self.y : self.y + self.h, self.x : self.x + self.w, :]


@dataclasses.dataclass(frozen=True)
class EvenSize(Kernel):
    def size(self, w, h):
        return max(2, w - w % 2) if w > 1 else w, max(2, h - h % 2) if h > 1 else h

    def __call__(self, px, at):
        w, h = self.size(px.shape[-2], px.shape[-3])
        return px[..., :h, :w, :]


#: Rows that are resampled at a time.
TILE = 64


@lru_cache(64)
def _nearest(src: int, dst: int) -> np.ndarray:
    return np.arange(dst) * src // dst


@lru_cache(64)
def _axis(src: int, dst: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lo, hi, w = axis(src, dst)
    return np.array(lo), np.array(hi), np.array(w, np.uint16)


@lru_cache(64)
def _cubic(src: int, dst: int) -> tuple[np.ndarray, np.ndarray]:
    s = np.zeros(dst, np.float32) if dst == 1 else (np.arange(dst, dtype=np.float32) + np.float32(0.5)) * np.float32(src) / np.float32(dst) - np.float32(0.5)
    s = np.clip(s, 0, src - 1).astype(np.float32)
    i = np.floor(s).astype(np.int64)
    t = (s - i).astype(np.float32)
    w = np.stack([-0.5 * t**3 + t**2 - 0.5 * t, 1.5 * t**3 - 2.5 * t**2 + 1, -1.5 * t**3 + 2 * t**2 + 0.5 * t, 0.5 * t**3 - 0.5 * t**2]).astype(np.float32)
    return np.clip(i + np.arange(-1, 3)[:, None], 0, src - 1), w


@dataclasses.dataclass(frozen=True)
class Resize(Kernel):
    """To w x h; with one of them 0, that one follows from the aspect."""

    w: int
    h: int
    filter: str = "bilinear"

    def size(self, w, h):
        if self.w <= 0 and self.h <= 0 or self.filter not in ("nearest", "bilinear", "bicubic"):
            raise ParamError(f"can't resize to {self.w}x{self.h} by {self.filter}")
        return self.w if self.w > 0 else max(1, w * self.h // h), self.h if self.h > 0 else max(1, h * self.w // w)

    def __call__(self, px, at):
        sh, sw = px.shape[-3:-1]
        w, h = self.size(sw, sh)
        if (w, h) == (sw, sh):
            return px
        if self.filter == "bicubic":
            return self._bicubic(px, w, h)
        stack = px.reshape(-1, sh, sw * px.shape[-1]) if px.ndim > 3 else px.reshape(1, sh, sw * px.shape[-1])
        planes = (self._nearest if self.filter == "nearest" else self._bilinear)(stack, sh, sw, w, h, px.shape[-1])
        # each channel lies together in memory, which makes what follows faster; the axes are as they were
        return np.moveaxis(planes, 1, -1).reshape(*px.shape[:-3], h, w, px.shape[-1]) if px.ndim == 4 else np.moveaxis(planes, 1, -1)[0]

    @staticmethod
    def _nearest(rows, sh, sw, w, h, c):
        used, cols = rows[:, _nearest(sh, h)], _nearest(sw, w) * c
        out = np.empty((len(rows), c, h, w), np.uint8)
        for k in range(c):
            out[:, k] = used.take(cols + k, -1, mode="clip")
        return out

    @staticmethod
    def _bilinear(rows, sh, sw, w, h, c):
        y0, y1, wy = _axis(sh, h)
        x0, x1, wx = _axis(sw, w)
        left, right = wx.astype(np.uint16), (256 - wx).astype(np.uint16)
        out = np.empty((len(rows), c, h, w), np.uint8)
        for i in range(0, h, TILE):  # rows that stay in the processor's cache; the first products fit into 16 bits
            j = min(h, i + TILE)
            used, back = np.unique(np.concatenate([y0[i:j], y1[i:j]]), return_inverse=True)
            part = rows[:, used]
            top = wy[i:j].astype(np.uint32)[:, None]
            low = np.uint32(256) - top
            for k in range(c):
                across = part.take(x0 * c + k, -1, mode="clip") * left
                across += part.take(x1 * c + k, -1, mode="clip") * right
                both = across[:, back[: j - i]] * top
                both += across[:, back[j - i :]] * low
                both >>= np.uint32(16)
                out[:, k, i:j] = both
        return out

    @staticmethod
    def _bicubic(px, w, h):
        sh, sw = px.shape[-3:-1]
        ys, wy = _cubic(sh, h)
        xs, wx = _cubic(sw, w)
        used, back = np.unique(ys, return_inverse=True)
        rows = px.take(used, -3)
        across = rows.take(xs[0], -2) * wx[0][:, None]
        for k in range(1, 4):
            across += rows.take(xs[k], -2) * wx[k][:, None]
        back = back.reshape(ys.shape)
        out = across.take(back[0], -3) * wy[0][:, None, None]
        for k in range(1, 4):
            out += across.take(back[k], -3) * wy[k][:, None, None]
        return to_byte(out)


class HFlip(Kernel):
    def __call__(self, px, at):
        return px[..., ::-1, :]


class VFlip(Kernel):
    def __call__(self, px, at):
        return px[..., ::-1, :, :]


@dataclasses.dataclass(frozen=True)
class Rotate(Kernel):
    """Clockwise.  Quarter turns are exact; other angles keep the canvas, nearest pixel, black outside."""

    degrees: float

    def size(self, w, h):
        return (h, w) if self.degrees % 360 in (90, 270) else (w, h)

    def __call__(self, px, at):
        turn = self.degrees % 360
        if turn % 90 == 0:
            return np.rot90(px, -int(turn // 90), axes=(-3, -2))
        h, w = px.shape[-3:-1]
        a = math.radians(self.degrees)
        cx, cy = w / 2, h / 2
        y, x = np.mgrid[0:h, 0:w]
        dx, dy = x + 0.5 - cx, y + 0.5 - cy
        sx = np.floor(math.cos(a) * dx + math.sin(a) * dy + cx).astype(np.int64)
        sy = np.floor(-math.sin(a) * dx + math.cos(a) * dy + cy).astype(np.int64)
        ok = (sx >= 0) & (sy >= 0) & (sx < w) & (sy < h)
        out = px[..., np.clip(sy, 0, h - 1), np.clip(sx, 0, w - 1), :]
        return np.where(ok[..., None], out, np.uint8(0))


@dataclasses.dataclass(frozen=True)
class Margin(Kernel):
    px: int
    colour: tuple[int, int, int] = (0, 0, 0)

    def size(self, w, h):
        return w + 2 * self.px, h + 2 * self.px

    def __call__(self, px, at):
        h, w = px.shape[-3:-1]
        out = np.empty((*px.shape[:-3], h + 2 * self.px, w + 2 * self.px, min(3, px.shape[-1])), np.uint8)
        out[...] = np.array(self.colour[: out.shape[-1]], np.uint8)
        out[..., self.px : self.px + h, self.px : self.px + w, :] = px[..., :3]
        return out


def _moved(px: np.ndarray, ox: int, oy: int) -> np.ndarray:
    out = np.zeros_like(px)
    h, w = px.shape[-3:-1]
    if abs(ox) < w and abs(oy) < h:
        out[..., max(0, oy) : h + min(0, oy), max(0, ox) : w + min(0, ox), :] = px[..., max(0, -oy) : h - max(0, oy), max(0, -ox) : w - max(0, ox), :]
    return out


@dataclasses.dataclass(frozen=True)
class Slide(Kernel):
    duration: float
    side: str = "right"
    entering: bool = True

    by_time = True

    def __call__(self, px, at):
        h, w = px.shape[-3:-1]
        out = np.empty_like(px)
        for k, (t, total) in enumerate(zip(at.t, at.total)):
            if self.entering:
                on = min(max(t / self.duration, 0.0), 1.0)
            else:
                start = max(total - self.duration, 0.0)
                on = 1.0 if t < start else 1.0 - min(max((t - start) / self.duration, 0.0), 1.0)
            off = 1.0 - on
            move = {"left": (int(-off * w), 0), "top": (0, int(-off * h)), "bottom": (0, int(off * h))}.get(self.side, (int(off * w), 0))
            out[k] = _moved(px[k], *move)
        return out


@dataclasses.dataclass(frozen=True)
class Scroll(Kernel):
    w: int
    h: int
    x_speed: float
    y_speed: float
    x_start: float = 0.0
    y_start: float = 0.0

    by_time = True

    def size(self, w, h):
        return max(1, min(self.w, w)), max(1, min(self.h, h))

    def __call__(self, px, at):
        sh, sw = px.shape[-3:-1]
        w, h = self.size(sw, sh)
        out = np.empty((len(px), h, w, px.shape[-1]), np.uint8)
        for k, t in enumerate(at.t):
            x = int(min(max(math.floor(self.x_start + self.x_speed * t + 0.5), 0), sw - w))
            y = int(min(max(math.floor(self.y_start + self.y_speed * t + 0.5), 0), sh - h))
            out[k] = px[k, y : y + h, x : x + w]
        return out


class BlackAndWhite(Kernel):
    def __call__(self, px, at):
        def grey(c):
            if c.shape[-1] < 3:
                return c
            y = c[..., 0] * np.uint16(77)
            y += c[..., 1] * np.uint16(150)
            y += c[..., 2] * np.uint16(29)
            y >>= np.uint16(8)
            out = np.empty(c.shape, np.uint8)
            for k in range(3):
                out[..., k] = y
            return out

        return on_colour(px, grey)


class Invert(Kernel):
    def __call__(self, px, at):
        return on_colour(px, lambda c: np.uint8(255) - c)


@dataclasses.dataclass(frozen=True)
class Table(Kernel):
    """A value for each of the 256 levels."""

    levels: tuple[int, ...]

    def __call__(self, px, at):
        table = np.array(self.levels, np.uint8)
        return on_colour(px, lambda c: table[c])


def multiply(factor: float) -> Table:
    scale = int(min(max(factor, 0.0), 16.0) * 256 + 0.5)
    return Table(tuple(min(255, v * scale >> 8) for v in range(256)))


def gamma(g: float) -> Table:
    return Table(tuple(gamma_table(g)))


def lum_contrast(lum: float, contrast: float) -> Table:
    away = lambda x: math.copysign(math.floor(abs(x) + 0.5), x)
    return Table(tuple(int(min(255, max(0, away((v - 128.0) * contrast + 128.0 + lum)))) for v in range(256)))


@dataclasses.dataclass(frozen=True)
class Fade(Kernel):
    """From a colour at the start, or to it at the end."""

    duration: float
    entering: bool = True
    colour: tuple[int, int, int] = (0, 0, 0)

    by_time = True

    def amounts(self, at: Times) -> np.ndarray:
        if self.entering:
            a = np.where(at.t >= self.duration, 0.0, 1.0 - at.t / self.duration)
        else:
            start = np.maximum(at.total - self.duration, 0.0)
            a = np.where(at.t <= start, 0.0, (at.t - start) / self.duration)
        return np.floor(np.clip(a, 0.0, 1.0) * 256 + 0.5).astype(np.uint32)

    def __call__(self, px, at):
        amounts = self.amounts(at)
        if not amounts.any():
            return px
        out = np.empty_like(px)
        for k, a in enumerate(amounts.tolist()):
            if not a:
                out[k] = px[k]
                continue
            n = min(3, px.shape[-1])
            if px.shape[-1] > 3:
                out[k, ..., 3:] = px[k, ..., 3:]
            colour = np.array(self.colour[:n], np.uint16)
            if a >= 256:
                out[k, ..., :n] = colour
                continue
            v = px[k, ..., :n] * np.uint16(256 - a)
            if colour.any():
                v += colour * np.uint16(a)
            v >>= np.uint16(8)
            out[k, ..., :n] = v
        return out


@dataclasses.dataclass(frozen=True)
class Painting(Kernel):
    """Edges sharpened and inked, colours saturated."""

    saturation: float = 1.4
    black: float = 0.006

    def inky(self) -> Painting:
        return Painting(self.saturation, min(self.black * 2.5, 0.05))

    def __call__(self, px, at):
        pad = np.pad(px[..., :3].astype(np.int32), [(0, 0)] * (px.ndim - 3) + [(1, 1), (1, 1), (0, 0)], "edge")
        h, w = px.shape[-3:-1]
        near = sum(pad[..., dy : dy + h, dx : dx + w, :] for dy in range(3) for dx in range(3))
        sharp = np.clip(11 * pad[..., 1 : h + 1, 1 : w + 1, :] - near, 0, 255)
        grey = (sharp @ np.array([77, 150, 29])) >> 8
        edge = np.zeros(grey.shape, np.float32)
        if h > 2 and w > 2:
            g = lambda y, x: grey[..., 1 + y : h - 1 + y, 1 + x : w - 1 + x]
            gx = g(-1, 1) - g(-1, -1) + 2 * (g(0, 1) - g(0, -1)) + g(1, 1) - g(1, -1)
            gy = g(1, -1) - g(-1, -1) + 2 * (g(1, 0) - g(-1, 0)) + g(1, 1) - g(-1, 1)
            edge[..., 1 : h - 1, 1 : w - 1] = np.sqrt((gx * gx + gy * gy).astype(np.float32))
        top = np.maximum(edge.max((-2, -1), keepdims=True), np.float32(1e-6))
        ink = np.float32(max(self.black, 0.0)) * np.float32(255) * (edge / top)
        made = to_byte(np.float32(max(self.saturation, 0.0)) * sharp.astype(np.float32) - ink[..., None])
        return made if px.shape[-1] <= 3 else np.concatenate([made, px[..., 3:]], -1)


@dataclasses.dataclass(frozen=True)
class DropAlpha(Kernel):
    def __call__(self, px, at):
        return px[..., :3]


class SwapRedBlue(Kernel):
    def __call__(self, px, at):
        return px if px.shape[-1] < 3 else px[..., [2, 1, 0, 3][: px.shape[-1]]]


class Premultiply(Kernel):
    def __call__(self, px, at):
        if px.shape[-1] < 4:
            return px
        c = (px[..., :3].astype(np.uint32) * px[..., 3:].astype(np.uint32) + 127) // 255
        return np.concatenate([c.astype(np.uint8), px[..., 3:]], -1)


class Unpremultiply(Kernel):
    def __call__(self, px, at):
        if px.shape[-1] < 4:
            return px
        a = px[..., 3:].astype(np.float32)
        c = np.where(a > 0, px[..., :3] * np.float32(255) / np.maximum(a, 1), 0)
        return np.concatenate([to_byte(c), px[..., 3:]], -1)


def gaussian(sigma: float) -> np.ndarray:
    """Normalised weights, 3 sigma to each side but 32 pixels at most."""
    r = min(max(math.ceil(sigma * 3), 1), 32)
    x = np.arange(-r, r + 1, dtype=np.float32)
    k = np.exp(-(x * x) / np.float32(2 * sigma * sigma)).astype(np.float32)
    return k / k.sum(dtype=np.float32)


def blur(px: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian along x, then y; edges repeat, and the first pass is rounded to 8 bits."""
    k = gaussian(max(sigma, 0.5))
    r = len(k) // 2
    for dim in (-2, -3):
        n = px.shape[dim]
        pad = [(0, 0)] * px.ndim
        pad[dim] = (r, r)
        wide = np.pad(px, pad, "edge").astype(np.float32)
        acc = np.zeros(px.shape, np.float32)
        for i, v in enumerate(k):
            acc += wide.take(range(i, i + n), dim) * v if dim == -2 else wide[..., i : i + n, :, :] * v
        px = to_byte(acc)
    return px


def soft_mask(dist: np.ndarray, radius: float, feather: float) -> np.ndarray:
    inner = max(radius - max(feather * radius, 0.5), 0.0)
    t = np.clip((dist - inner) / max(radius - inner, 1e-6), 0.0, 1.0)
    return np.where(dist <= inner, 1.0, np.where(dist >= radius, 0.0, 1.0 - t * t * (3.0 - 2.0 * t))).astype(np.float32)


@dataclasses.dataclass(frozen=True)
class HeadBlur(Kernel):
    """A feathered disc of blur; path: points (secs, x, y), linear between, the ends held."""

    path: tuple[tuple[float, float, float], ...]
    radius: float
    intensity: float | None = None
    feather: float = 0.35

    by_time = True

    def __call__(self, px, at):
        sigma = self.intensity if self.intensity is not None else max(self.radius * 2 / 3, 0.5)
        r = max(self.radius, 1.0)
        p = np.array(sorted(self.path), float)
        out = px.copy()
        h, w = px.shape[-3:-1]
        soft = blur(px, sigma)
        y, x = np.mgrid[0:h, 0:w]
        for k, t in enumerate(at.t):
            cx, cy = np.interp(t, p[:, 0], p[:, 1]), np.interp(t, p[:, 0], p[:, 2])
            weight = soft_mask(np.hypot(x - cx, y - cy), r, self.feather)[..., None]
            c = min(3, px.shape[-1])
            out[k, ..., :c] = to_byte(px[k, ..., :c] * (1 - weight) + soft[k, ..., :c] * weight)
        return out


def chroma_mask(px: np.ndarray, colour: tuple[int, int, int], threshold: int) -> np.ndarray:
    """0 where all channels are within threshold of the colour, else 1."""
    away = np.abs(px[..., :3].astype(np.int16) - np.array(colour, np.int16)).max(-1)
    return (away > threshold).astype(np.float32)


def over(dst: np.ndarray, src: np.ndarray, x: int, y: int, opacity: float, mask: np.ndarray | None = None) -> None:
    """src blended onto the RGB canvas dst at (x, y), clipped to it, in place."""
    h, w = dst.shape[:2]
    x0, y0, x1, y1 = max(0, x), max(0, y), min(w, x + src.shape[1]), min(h, y + src.shape[0])
    if x0 >= x1 or y0 >= y1:
        return
    part = src[y0 - y : y1 - y, x0 - x : x1 - x]
    a = np.float32(min(max(opacity, 0.0), 1.0))
    if mask is not None:
        a = a * np.clip(mask[y0 - y : y1 - y, x0 - x : x1 - x, None], 0, 1).astype(np.float32)
    if part.shape[-1] == 4:
        a = a * (part[..., 3:] / np.float32(255))
    room = dst[y0:y1, x0:x1]
    if isinstance(a, np.float32) and a >= 1:
        room[:] = part[..., :3]
    else:
        room[:] = to_byte(part[..., :3] * a + room * (np.float32(1) - a))
