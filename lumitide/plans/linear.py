"""Linear plans: a source, a list of operations and an output; optimised, split and applied."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Sequence
from typing import Any

from ..clips import Clip
from ..errors import EngineError, ParamError
from ..kernels import pictures as K
from ..mediatime import MediaTime
from . import run

VERSION = 1
Op = dict[str, Any]
GREY = frozenset(("black_and_white", "bw", "grayscale", "grey"))
#: names of custom operations, by what they do
CUSTOM = {"pass": "identity noop pass", "grey": " ".join(GREY), "invert": "invert invert_colors negate", "painting": "painting paint", "multiply": "multiply_color multiply", "blur": "head_blur tracked_blur privacy_blur face_blur", "redact": "region_redaction redaction redaction.region"}
ALIASES = {name: what for what, names in CUSTOM.items() for name in names.split()}
FIELDS: dict[str, tuple[str, ...]] = {"identity": (), "trim": ("start", "duration"), "crop": ("x", "y", "w", "h"), "scale": ("w", "h"), "h_flip": (), "v_flip": (), "transpose_cw": (), "even_dims": (), "fade_in": ("duration",), "fade_out": ("duration", "total"), "custom": ("name",)}


@dataclasses.dataclass(frozen=True)
class Plan:
    source: str
    ops: tuple[Op, ...] = ()
    output: dict | None = None
    version: int = VERSION

    @classmethod
    def from_json(cls, text: str | dict) -> Plan:
        try:
            d = json.loads(text) if isinstance(text, str) else text
            src = d["source"]
            if src.get("type") != "file":
                raise EngineError(f"unknown source {src.get('type')}")
            plan = cls(src["path"], tuple(d.get("ops") or ()), d.get("output"), d["version"])
        except (KeyError, TypeError, AttributeError, json.JSONDecodeError) as e:
            raise EngineError(f"not a plan: {e!r}") from e
        plan.validate()
        return plan

    def to_json(self) -> dict:
        out = {"version": self.version, "source": {"type": "file", "path": self.source}, "ops": list(self.ops)}
        return out | ({"output": self.output} if self.output else {})

    def validate(self) -> None:
        if not isinstance(self.version, int) or not 1 <= self.version <= VERSION:
            raise EngineError(f"unsupported plan version {self.version}")
        if not self.source.strip():
            raise EngineError("the plan's source is empty")
        for op in self.ops:
            fields = FIELDS.get(op.get("op", ""))
            if fields is None:
                raise EngineError(f"unknown operation {op.get('op')}")
            for f in fields:
                if f not in op:
                    raise ParamError(f"{op['op']} needs {f}")


@dataclasses.dataclass(frozen=True)
class Stats:
    before: int
    after: int
    identities_removed: int
    flips_cancelled: int
    crops_merged: int
    scales_merged: int

    @property
    def eliminated(self) -> int:
        return max(0, self.before - self.after)


def optimize(plan: Plan) -> tuple[Plan, Stats]:
    """One pass of each rule: identities go, equal flips cancel, nested crops and scales merge.

    Merging scales gives other pixels than scaling twice; it is kept, as plans rely on it.
    """
    ops = [op for op in plan.ops if op["op"] != "identity"]
    gone = len(plan.ops) - len(ops)
    flips = crops = scales = 0
    out: list[Op] = []
    for op in ops:
        if out and op["op"] in ("h_flip", "v_flip") and out[-1]["op"] == op["op"]:
            out.pop()
            flips += 1
        else:
            out.append(op)
    ops, out = out, []
    for op in ops:
        last = out[-1] if out else {}
        if op["op"] == last.get("op") == "crop" and op["x"] + op["w"] <= last["w"] and op["y"] + op["h"] <= last["h"]:
            out[-1] = {"op": "crop", "x": last["x"] + op["x"], "y": last["y"] + op["y"], "w": op["w"], "h": op["h"]}
            crops += 1
        else:
            out.append(op)
    ops, out = out, []
    for op in ops:
        if out and op["op"] == out[-1]["op"] == "scale":
            out[-1] = op
            scales += 1
        else:
            out.append(op)
    return dataclasses.replace(plan, ops=tuple(out)), Stats(len(plan.ops), len(out), gone, flips, crops, scales)


def _alias(op: Op) -> str | None:
    name = str(op.get("name", "")).strip().lower()
    return ALIASES.get(name) or ALIASES.get(name.split(".", 1)[-1])


def native(op: Op) -> bool:
    """Whether an operation belongs to the plain prefix."""
    return _alias(op) == "grey" if op["op"] == "custom" else op["op"] != "identity"


@dataclasses.dataclass(frozen=True)
class Split:
    plan: Plan
    prefix: tuple[Op, ...]
    remainder: tuple[Op, ...]

    @property
    def fully_native(self) -> bool:
        return not self.remainder


def extract(plan: Plan) -> Split:
    """The longest plain prefix of the optimised plan, and the rest."""
    best, _ = optimize(plan)
    n = next((k for k, op in enumerate(best.ops) if not native(op)), len(best.ops))
    return Split(best, best.ops[:n], best.ops[n:])


def require_native(plan: Plan) -> Split:
    s = extract(plan)
    if s.remainder:
        raise EngineError(f"{len(s.remainder)} operations are beyond the plain prefix")
    if not s.prefix:
        raise EngineError("no operation is left after optimisation")
    return s


def filter_text(ops: Sequence[Op]) -> str:
    """The usual filter notation of a plain prefix; for explanations only."""
    parts = []
    for op in ops:
        k = op["op"]
        parts.append({
            "trim": lambda: f"trim=start={op['start']}:duration={op['duration']},setpts=PTS-STARTPTS", "crop": lambda: f"crop={op['w']}:{op['h']}:{op['x']}:{op['y']}", "scale": lambda: f"scale={op['w']}:{op['h']}", "h_flip": lambda: "hflip", "v_flip": lambda: "vflip",
            "transpose_cw": lambda: "transpose=1", "even_dims": lambda: "crop=trunc(iw/2)*2:trunc(ih/2)*2", "fade_in": lambda: f"fade=t=in:st=0:d={op['duration']}", "fade_out": lambda: f"fade=t=out:st={max(0.0, op['total'] - op['duration'])}:d={op['duration']}", "custom": lambda: "hue=s=0", "identity": lambda: "null",
        }[k]())
    return ",".join(parts)


def audio_filter_text(ops: Sequence[Op]) -> str:
    return ",".join(f"atrim=start={op['start']}:duration={op['duration']},asetpts=PTS-STARTPTS" for op in ops if op["op"] == "trim")


def validate_remainder(ops: Sequence[Op]) -> None:
    for op in ops:
        if op["op"] == "custom" and _alias(op) is None:
            raise ParamError(f"unknown custom operation {op.get('name')}")


def _custom(ctx: run.Context, clip: Clip, op: Op) -> Clip:
    what, p = _alias(op), op.get("params") or {}
    if what is None:
        raise ParamError(f"unknown custom operation {op.get('name')}")
    if what == "pass":
        return clip
    if what in ("grey", "invert", "painting"):
        return clip.kernel({"grey": K.BlackAndWhite, "invert": K.Invert, "painting": K.Painting}[what]())
    if what == "multiply":
        return clip.kernel(K.multiply(float(p.get("factor", 1.0))))
    if what == "redact":
        if not p:
            raise ParamError("a redaction needs parameters with masks")
        return run.redact(ctx, [clip], p)
    return _blur(clip, p)


def _blur(clip: Clip, p: dict) -> Clip:
    tracks = p.get("tracks")
    if isinstance(tracks, dict):
        tracks = tracks.get("tracks")
    samples = [s for t in tracks or [] for s in t.get("samples", [])]
    if not samples:
        raise ParamError("a blur needs tracks with samples")
    if len(tracks) > 1:
        masks = [dict(s, subject=t.get("subject") or t.get("id"), t=s["t"]) for t in tracks for s in t.get("samples", [])]
        raise_to = p.get("intensity") or max(2 * sum(float(m.get("radius", 1)) for m in masks) / len(masks) / 3, 0.5)
        return clip.replace(hints=clip.hints | {"blur": (masks, raise_to)})
    radius = float(p.get("radius", samples[0].get("radius", 1.0))) * float(p.get("radius_scale", 1.0))
    return clip.kernel(K.HeadBlur(tuple((float(s["t"]), float(s["cx"]), float(s["cy"])) for s in samples), radius, p.get("intensity"), float(p.get("feather", 0.35))))


def apply(ctx: run.Context, clip: Clip, ops: Sequence[Op]) -> Clip:
    for op in ops:
        k = op["op"]
        if k == "trim":
            clip = run.trim(ctx, [clip], {"start": MediaTime.from_secs(op["start"]), "duration": MediaTime.from_secs(op["duration"])})
        elif k == "custom":
            clip = _custom(ctx, clip, op)
            if "blur" in clip.hints:
                masks, sigma = clip.hints["blur"]
                clip = run.redact(ctx, [clip.replace(hints={x: v for x, v in clip.hints.items() if x != "blur"})], {"masks": masks, "sigma": sigma})
        elif k != "identity":
            made = {"crop": lambda: K.Crop(op["x"], op["y"], op["w"], op["h"]), "scale": lambda: K.Resize(op["w"], op["h"], "bicubic"), "h_flip": K.HFlip, "v_flip": K.VFlip, "transpose_cw": lambda: K.Rotate(90), "even_dims": K.EvenSize, "fade_in": lambda: K.Fade(op["duration"]), "fade_out": lambda: K.Fade(op["duration"], False)}[k]()
            clip = clip.kernel(made)
    return clip


def execute(ctx: run.Context, plan: Plan, clip: Clip | None = None) -> Clip:
    """The optimised plan's clip; clip: used in place of the plan's source."""
    best, _ = optimize(plan)
    split = extract(plan)
    validate_remainder(split.remainder)
    return apply(ctx, clip or run.open_asset(ctx, plan.source, None), best.ops)


def explain(plan: Plan) -> str:
    best, st = optimize(plan)
    s = extract(plan)
    return "\n".join([f"ops {st.before} -> {st.after}: {st.identities_removed} identities, {st.flips_cancelled} flips, {st.crops_merged} crops, {st.scales_merged} scales", f"prefix: {filter_text(s.prefix) or '-'}", f"remainder: {', '.join(o.get('name', o['op']) for o in s.remainder) or '-'}"])
