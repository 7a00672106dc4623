"""Pixel formats: planes to RGB and back to packed bytes, in integers."""

from __future__ import annotations

import numpy as np

from ..errors import MediaError

FORMATS = {"rgb8": 1, "rgba8": 1, "bgra8": 1, "yuv420p": 3, "nv12": 2}
#: luma gain, luma offset; red of V; green of U and V; blue of U; rounding
MATRICES = {"full": (256, 0, 359, 88, 183, 454, 0), "bt601": (298, 16, 409, 100, 208, 516, 128), "bt709": (298, 16, 459, 55, 136, 541, 128)}


def matrix(space: str | None, span: str | None) -> tuple[int, ...]:
    if span == "full":
        return MATRICES["full"]
    return MATRICES["bt709" if space in ("bt709", "bt2020") else "bt601"]


def compact(data: bytes, width: int, height: int, stride: int) -> np.ndarray:
    """A plane's rows without their padding."""
    if stride < width or len(data) < stride * (height - 1) + width:
        raise MediaError("a plane is shorter than its size and stride say")
    flat = np.frombuffer(data, np.uint8)
    if len(flat) < stride * height:
        flat = np.pad(flat, (0, stride * height - len(flat)))
    return flat[: stride * height].reshape(height, stride)[:, :width]


def _yuv(y: np.ndarray, u: np.ndarray, v: np.ndarray, m: tuple[int, ...]) -> np.ndarray:
    gain, base, rv, gu, gv, bu, half = m
    c, d, e = y.astype(np.int32) - base, u.astype(np.int32) - 128, v.astype(np.int32) - 128
    if base == 0:  # each term is shifted by itself
        parts = c + (rv * e >> 8), c - (gu * d + gv * e >> 8), c + (bu * d >> 8)
    else:
        parts = gain * c + rv * e + half >> 8, gain * c - gu * d - gv * e + half >> 8, gain * c + bu * d + half >> 8
    return np.clip(np.stack(parts, -1), 0, 255).astype(np.uint8)


def to_rgb(fmt: str, width: int, height: int, planes: list[bytes], strides: list[int] | None = None, space: str | None = None, span: str | None = None) -> np.ndarray:
    """(height, width, 3) of a surface; chroma is taken from the nearest sample."""
    if FORMATS.get(fmt) != len(planes):
        raise MediaError(f"{fmt} can't have {len(planes)} planes")
    cw, ch = -(-width // 2), -(-height // 2)
    widths = {"rgb8": [width * 3], "rgba8": [width * 4], "bgra8": [width * 4], "yuv420p": [width, cw, cw], "nv12": [width, cw * 2]}[fmt]
    heights = [height, ch, ch]
    p = [compact(d, w, h, (strides or widths)[k]) for k, (d, w, h) in enumerate(zip(planes, widths, heights))]
    if fmt == "rgb8":
        return p[0].reshape(height, width, 3)
    if fmt in ("rgba8", "bgra8"):
        px = p[0].reshape(height, width, 4)[..., :3]
        return px if fmt == "rgba8" else px[..., ::-1]
    u, v = (p[1], p[2]) if fmt == "yuv420p" else (p[1][:, 0::2], p[1][:, 1::2])
    wide = lambda c: c.repeat(2, 0).repeat(2, 1)[:height, :width]
    return _yuv(p[0], wide(u), wide(v), matrix(space, span))


def split_packed(fmt: str, width: int, height: int, data: bytes) -> list[bytes]:
    """Planes of tightly packed bytes."""
    c = -(-width // 2) * -(-height // 2)
    sizes = {"rgb8": [width * height * 3], "rgba8": [width * height * 4], "bgra8": [width * height * 4], "yuv420p": [width * height, c, c], "nv12": [width * height, 2 * c]}.get(fmt)
    if sizes is None or len(data) != sum(sizes):
        raise MediaError(f"{len(data)} bytes aren't a {width}x{height} picture of {fmt}")
    cuts = np.cumsum([0, *sizes])
    return [data[a:b] for a, b in zip(cuts, cuts[1:])]


def join_packed(planes: list[bytes]) -> bytes:
    return b"".join(planes)
