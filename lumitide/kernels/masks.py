"""Coverage masks: dense, cropped, run-length coded and polygon assets, and what regions cover."""

from __future__ import annotations

import dataclasses

import numpy as np

from ..errors import MediaError
from .pictures import blur, soft_mask, to_byte

MAX_SIDE, MAX_BYTES, MAX_RUNS, MAX_VERTICES = 8192, 64 << 20, 1 << 20, 4096


@dataclasses.dataclass
class Coverage:
    """Values 0..255 of a w x h box whose top left is (x, y) of the picture; 0 outside."""

    x: int
    y: int
    data: np.ndarray

    @property
    def bounds(self) -> tuple[int, int, int, int]:
        return self.x, self.y, self.x + self.data.shape[1], self.y + self.data.shape[0]

    def sample(self, x: int, y: int) -> float:
        l, t, r, b = self.bounds
        return self.data[y - t, x - l] / 255 if l <= x < r and t <= y < b else 0.0


def _size(w: int, h: int) -> None:
    if not (0 < w <= MAX_SIDE and 0 < h <= MAX_SIDE) or w * h > MAX_BYTES:
        raise MediaError(f"a mask of {w}x{h} is out of bounds")


def dense(w: int, h: int, data: bytes, x: int = 0, y: int = 0) -> Coverage:
    _size(w, h)
    if len(data) != w * h:
        raise MediaError(f"{len(data)} bytes aren't a mask of {w}x{h}")
    return Coverage(x, y, np.frombuffer(data, np.uint8).reshape(h, w))


def rle(w: int, h: int, runs: list[tuple[int, int]]) -> Coverage:
    _size(w, h)
    if len(runs) > MAX_RUNS or any(n < 0 or not 0 <= v <= 255 for n, v in runs) or sum(n for n, _ in runs) != w * h:
        raise MediaError("runs don't fill the mask")
    n, v = np.array(runs, np.int64).reshape(-1, 2).T
    return Coverage(0, 0, np.repeat(v.astype(np.uint8), n).reshape(h, w))


def polygon(w: int, h: int, points: list[tuple[float, float]]) -> Coverage:
    """Even-odd at pixel centres."""
    _size(w, h)
    if not 3 <= len(points) <= MAX_VERTICES:
        raise MediaError("a polygon has 3 to 4096 vertices")
    p = np.array(points, float)
    out = np.zeros((h, w), np.uint8)
    x = np.arange(w) + 0.5
    for row in range(max(0, int(p[:, 1].min())), min(h, int(np.ceil(p[:, 1].max())) + 1)):
        y = row + 0.5
        (x0, y0), (x1, y1) = p.T, np.roll(p, -1, 0).T
        cross = (y0 > y) != (y1 > y)
        at = x0[cross] + (y - y0[cross]) * (x1[cross] - x0[cross]) / (y1[cross] - y0[cross])
        out[row] = np.where((at[:, None] > x).sum(0) % 2 == 1, 255, 0)
    return Coverage(0, 0, out)


def polygon_box(points: list[tuple[float, float]]) -> Coverage:
    """A polygon as the coverage of its own box, from pixel (0, 0) on."""
    if len(points) < 3 or not np.isfinite(np.array(points, float)).all():
        raise MediaError("a polygon has 3 finite vertices or more")
    p = np.array(points, float)
    left, top = (max(0, int(np.floor(v))) for v in p.min(0))
    right, bottom = (int(np.ceil(v)) for v in p.max(0))
    made = polygon(max(1, right - left), max(1, bottom - top), (p - [left, top]).tolist())
    return Coverage(left, top, made.data)


def decode(asset: dict | None) -> Coverage | None:
    """The coverage of a mask asset as it stands in a row (:data:`ASSET`); None for what stands in a package."""
    if asset is None or asset["kind"] == "external":
        return None
    kind, w, h = asset["kind"], asset["w"] or 0, asset["h"] or 0
    if kind in ("dense", "cropped"):
        return dense(w, h, asset["data"] or b"", *((asset["left"] or 0, asset["top"] or 0) if kind == "cropped" else ()))
    if kind == "rle":
        return rle(w, h, [(n, v) for n, v in asset["runs"] or []])
    if kind == "polygon":
        return polygon_box([(x, y) for x, y in asset["points"] or []])
    raise MediaError(f"unknown kind of mask {kind}")


class Decoder:
    """:func:`decode`, once for runs or a polygon that rows repeat; what is kept takes about ``KEPT`` bytes at most."""

    KEPT = 4 << 20

    def __init__(self):
        self.made: dict[tuple, Coverage] = {}
        self.size = 0

    def __call__(self, asset: dict | None) -> Coverage | None:
        if asset is None or asset["kind"] not in ("rle", "polygon"):  # of the others, the bytes are the coverage
            return decode(asset)
        pairs = asset["runs"] if asset["kind"] == "rle" else asset["points"]
        key = asset["kind"], asset["w"], asset["h"], tuple(map(tuple, pairs or []))
        if key not in self.made:
            got = decode(asset)
            size = got.data.nbytes + 128 * len(key[-1])
            if size > self.KEPT:
                return got
            if self.size + size > self.KEPT:
                self.made, self.size = {}, 0
            self.made[key], self.size = got, self.size + size
        return self.made[key]


#: A mask asset as a column.
ASSET = "struct<kind: string, w: bigint, h: bigint, left: bigint, top: bigint, data: binary, runs: array<array<bigint>>, points: array<array<double>>, package_id: string, mask_ref: string>"


@dataclasses.dataclass
class Region:
    cx: float
    cy: float
    radius: float
    conf: float = 1.0
    coverage: Coverage | None = None


def union_roi(regions: list[Region], w: int, h: int, pad: int = 1) -> tuple[int, int, int, int] | None:
    """The box (x0, y0, x1, y1) around all regions, padded and clamped; None if it's empty."""
    boxes = []
    for r in regions:
        if r.coverage is not None:
            l, t, right, b = r.coverage.bounds
        else:
            rad, cx, cy = int(np.ceil(r.radius)) + 1, int(max(0, np.floor(r.cx + 0.5))), int(max(0, np.floor(r.cy + 0.5)))
            l, t, right, b = max(0, cx - rad), max(0, cy - rad), cx + rad, cy + rad
        boxes.append((max(0, l - pad), max(0, t - pad), right + pad, b + pad))
    if not boxes or w <= 0 or h <= 0:
        return None
    x0, y0, x1, y1 = min(b[0] for b in boxes), min(b[1] for b in boxes), min(w, max(b[2] for b in boxes)), min(h, max(b[3] for b in boxes))
    return (x0, y0, x1, y1) if x0 < x1 and y0 < y1 else None


def stamp(regions: list[Region], roi: tuple[int, int, int, int], feather: float) -> np.ndarray:
    """The greatest coverage of any region, within roi."""
    x0, y0, x1, y1 = roi
    cov = np.zeros((y1 - y0, x1 - x0), np.float32)
    for r in regions:
        if r.coverage is not None:
            l, t, right, b = r.coverage.bounds
            l0, t0, r0, b0 = max(l, x0), max(t, y0), min(right, x1), min(b, y1)
            if l0 < r0 and t0 < b0:
                part = cov[t0 - y0 : b0 - y0, l0 - x0 : r0 - x0]
                np.maximum(part, r.coverage.data[t0 - t : b0 - t, l0 - l : r0 - l] / np.float32(255), out=part)
            continue
        rad = int(np.ceil(max(r.radius, 1.0))) + 1
        l0, t0 = max(x0, int(max(r.cx, 0)) - rad), max(y0, int(max(r.cy, 0)) - rad)
        r0, b0 = min(x1, int(max(r.cx, 0)) + rad), min(y1, int(max(r.cy, 0)) + rad)
        if l0 < r0 and t0 < b0:
            y, x = np.mgrid[t0:b0, l0:r0]
            part = cov[t0 - y0 : b0 - y0, l0 - x0 : r0 - x0]
            np.maximum(part, soft_mask(np.hypot(x - r.cx, y - r.cy), max(r.radius, 1.0), feather), out=part)
    return cov


def redact(px: np.ndarray, regions: list[Region], style: str = "gaussian", amount: float = 12.0, colour: tuple[int, int, int, int] = (0, 0, 0, 255), feather: float = 0.35, min_conf: float = 0.05) -> np.ndarray:
    """A picture with its regions blurred, pixelated or filled."""
    regions = [r for r in regions if r.conf > 0 and r.conf >= min_conf]
    h, w = px.shape[:2]
    roi = union_roi(regions, w, h)
    if roi is None:
        return px
    x0, y0, x1, y1 = roi
    cov = stamp(regions, roi, feather)[..., None]
    c = min(3, px.shape[-1])
    if style == "gaussian":
        sigma = max(amount, 0.5)
        r = min(max(int(np.ceil(sigma * 3)), 1), 32)
        l, t = max(0, x0 - r), max(0, y0 - r)
        new = blur(px[t : y1 + r, l : x1 + r, :c], sigma)[y0 - t : y1 - t, x0 - l : x1 - l]
    elif style == "pixelate":
        b = max(int(amount), 2)
        l, t, r, low = x0 // b * b, y0 // b * b, min(w, -(-x1 // b) * b), min(h, -(-y1 // b) * b)
        part = px[t:low, l:r, :c].astype(np.float32)
        ys, xs = np.arange(0, low - t, b), np.arange(0, r - l, b)
        sums = np.add.reduceat(np.add.reduceat(part, ys, 0), xs, 1)
        n = np.outer(np.diff(np.append(ys, low - t)), np.diff(np.append(xs, r - l)))[..., None]
        new = (sums / n).repeat(b, 0).repeat(b, 1)[y0 - t : y1 - t, x0 - l : x1 - l]
    elif style == "solid":
        new = np.array(colour[:c], np.float32)
        cov = cov * np.float32(colour[3] / 255)
    else:
        raise MediaError(f"unknown style {style}")
    out = px.copy()
    part = out[y0:y1, x0:x1, :c]
    part[:] = np.where(cov > 0, to_byte(part * (1 - cov) + new * cov), part)
    return out
