"""The operations of graphs: descriptor, parameters, cost and executor of each.

An operation's id is ``family.name``.  A document may put a vendor's prefix in front
(``vendor.family.name``), and may name any vendor for the adapter; :func:`plain` drops both.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Callable
from typing import Any

from ..errors import NotExecutable, ParamError, UnknownOperation
from ..mediatime import HZ_1M, MediaTime

FAMILIES = frozenset("transform color compose timeline audio redaction subtitle adapter gpu encode".split())


def plain(name: str) -> str:
    parts = name.strip().split(".")
    if len(parts) == 3 and parts[1] in FAMILIES and parts[0] not in FAMILIES:
        parts = parts[1:]
    return "adapter.tracks" if len(parts) == 2 and parts[0] == "adapter" else ".".join(parts)


@dataclasses.dataclass(frozen=True)
class Contract:
    video: bool = False
    audio: bool = False
    masks: bool = False

    def satisfies(self, need: Contract) -> bool:
        return (self.video or not need.video) and (self.audio or not need.audio) and (self.masks or not need.masks)


@dataclasses.dataclass(frozen=True)
class Cost:
    cpu: float = 1.0
    memory: float = 1.0
    io: float = 0.2
    gpu: float = 0.0


Params = dict[str, Any]


@dataclasses.dataclass(frozen=True)
class Descriptor:
    id: str
    backend: str  # native: expressions and plain kernels; kernel; adapter; device
    parse: Callable[[Params], Params]
    run: Callable[..., Any] | None = None
    nary: bool = False
    needs: Contract = Contract(video=True)
    cost: Cost = Cost()
    deterministic: bool = True
    version: str = "1.0.0"


class Registry:
    def __init__(self, found: dict[str, Descriptor] | None = None):
        self._by = dict(found or {})

    def register(self, d: Descriptor) -> Registry:
        self._by[d.id] = d
        return self

    def get(self, name: str) -> Descriptor:
        d = self._by.get(plain(name)) or self._by.get(name)
        if d is None:
            raise UnknownOperation(name)
        return d

    def ids(self) -> list[str]:
        return sorted(self._by)

    def executable(self, name: str) -> Descriptor:
        d = self.get(name)
        if d.run is None:
            raise NotExecutable(name)
        return d


# parameters: each parser gives typed values, times as MediaTime


def number(p: Params, key: str) -> float | None:
    v = p.get(key)
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None


def natural(p: Params, key: str) -> int | None:
    v = p.get(key)
    return v if isinstance(v, int) and not isinstance(v, bool) and 0 <= v < 1 << 32 else None


def time(p: Params, key: str) -> MediaTime | None:
    return MediaTime.from_json(p.get(key))


def need(value, op: str, what: str):
    if value is None:
        raise ParamError(f"{op}: {what} required")
    return value


def above(value: float, op: str, what: str):
    if not (math.isfinite(value) and value > 0):
        raise ParamError(f"{op}: {what} must be above 0, not {value}")
    return value


def nothing(p: Params) -> Params:
    return {}


def trim(p: Params) -> Params:
    start, d = time(p, "start") or MediaTime(0, HZ_1M), need(time(p, "duration"), "trim", "duration")
    above(d.ticks, "trim", "duration")
    return {"start": start, "duration": d}


def scale(p: Params) -> Params:
    return {k: need(natural(p, k), "scale", k) for k in "wh"}


def crop(p: Params) -> Params:
    return {"x": natural(p, "x") or 0, "y": natural(p, "y") or 0, "w": need(natural(p, "w"), "crop", "w"), "h": need(natural(p, "h"), "crop", "h")}


ANGLES = {"cw90": 90.0, "90": 90.0, "cw180": 180.0, "180": 180.0, "half": 180.0, "cw270": 270.0, "270": 270.0, "ccw90": 270.0}


def rotate(p: Params) -> Params:
    mode, degrees = p.get("mode", "cw90"), number(p, "degrees")
    if mode == "degrees":
        return {"degrees": need(degrees, "rotate", "degrees")}
    return {"degrees": need(ANGLES.get(mode), "rotate", "a known mode")}


def fade(p: Params) -> Params:
    return {"duration": time(p, "duration") or MediaTime.from_secs(0.5)}


def speed(p: Params) -> Params:
    return {"factor": above(need(number(p, "factor"), "speed", "factor"), "speed", "factor")}


def freeze(p: Params) -> Params:
    hold = need(time(p, "hold"), "freeze", "hold")
    above(hold.ticks, "freeze", "hold")
    return {"at": time(p, "at") or MediaTime(0, hold.timescale), "hold": hold}


def loop(p: Params) -> Params:
    d, n = time(p, "duration"), natural(p, "times")
    n = natural(p, "n") if n is None else n
    if d is None and n is None:
        raise ParamError("loop: duration or times required")
    if d is not None:
        above(d.ticks, "loop", "duration")
    if n is not None:
        above(n, "loop", "times")
    return {"duration": d, "times": n}


def slide(side: str) -> Callable[[Params], Params]:
    return lambda p: {"duration": need(time(p, "duration"), "slide", "duration"), "side": p["side"] if isinstance(p.get("side"), str) else side}


def painting(p: Params) -> Params:
    return {"saturation": number(p, "saturation"), "black": number(p, "black")}


def layers(p: Params) -> Params:
    return {"w": natural(p, "w"), "h": natural(p, "h"), "layers": p.get("layers") or [], "background": p.get("background")}


def gain(p: Params) -> Params:
    f = number(p, "factor")
    return {"factor": 1.0 if f is None else f}


def mix(p: Params) -> Params:
    return {"tracks": p.get("tracks") or []}


def concat(p: Params) -> Params:
    return {"clips": p.get("clips") or p.get("ranges") or []}


def redaction(p: Params) -> Params:
    if p and p.get("masks") is None:
        raise ParamError("redaction: masks required")
    return dict(p)


def burn(p: Params) -> Params:
    return {"cues": p.get("cues") or []}


def adapter(p: Params) -> Params:
    name = p.get("adapter")
    return {"name": name if isinstance(name, str) else "tracks", "params": dict(p)}


def device(p: Params) -> Params:
    return {"backend": p.get("backend") if isinstance(p.get("backend"), str) else None, "codec": p.get("codec")}


def encode(p: Params) -> Params:
    crf = natural(p, "crf")
    return {"path": p.get("path"), "crf": None if crf is None else min(crf, 51), "codec": p.get("codec"), "fps": number(p, "fps"), "preserve_audio": p.get("preserve_audio") if isinstance(p.get("preserve_audio"), bool) else None}
