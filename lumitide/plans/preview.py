"""One frame of a graph, cheaply: what it doesn't need is cut off before anything is planned."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame

from ..clips import Clip
from ..errors import EngineError, UnknownId
from ..kernels.pictures import Resize
from ..mediatime import MediaTime
from .graph import Graph, Node
from .registry import plain
from .run import Context, materialize

BOXES = {"draft": (320, 180), "proxy": (640, 360), "full": None}
PASSED = frozenset(("encode.h264", "encode.hw", "gpu.passthrough", "audio.drop", "audio.preserve", "audio.gain"))


def proxy_size(w: int, h: int, max_w: int, max_h: int) -> tuple[int, int]:
    scale = min(max(max_w, 2) / max(w, 1), max(max_h, 2) / max(h, 1), 1.0)
    fit = lambda s: max(2, max(2, int(max(s, 1) * scale + 0.5)) & ~1)
    return fit(w), fit(h)


def output_size(w: int, h: int, quality: str) -> tuple[int, int]:
    box = BOXES[quality]
    return (w, h) if box is None else proxy_size(w, h, *box)


@dataclasses.dataclass(frozen=True)
class Preview:
    output: str
    keep: tuple[str, ...]
    skip: tuple[str, ...]
    bypass: tuple[str, ...]
    graph: Graph


def _op(n: Node) -> str:
    return plain(n.operation) if n.kind == "op" else ""


def _not_yet(n: Node, k: int, t: MediaTime) -> bool:
    """Whether an input doesn't matter at a time: a layer that starts later, a mix's sounds."""
    if _op(n) == "audio.mix":
        return k > 0
    layers = n.params.get("layers") if _op(n) == "compose.layers" else None
    if not isinstance(layers, list) or k >= len(layers) or not isinstance(layers[k], dict):
        return False
    start = MediaTime.from_json(layers[k].get("start"), 1000)
    return start is not None and start.rebase(t.timescale).ticks > t.ticks


def plan(graph: Graph, t: MediaTime, quality: str = "proxy") -> Preview:
    by = {n.id: n for n in graph.nodes}
    out = graph.outputs[0].node if graph.outputs else next((n.id for n in reversed(graph.nodes) if n.kind == "output"), None)
    if out is None:
        raise EngineError("the graph has no output")
    kept: dict[str, list[int]] = {}
    passed: dict[str, str] = {}
    todo = [out]
    while todo:
        name = todo.pop()
        if name in kept or name in passed:
            continue
        if name not in by:
            raise UnknownId(name)
        n = by[name]
        if _op(n) in PASSED and n.inputs:
            passed[name] = n.inputs[0]
            todo.append(n.inputs[0])
            continue
        need = [k for k in range(len(n.inputs)) if not _not_yet(n, k, t)] or list(range(min(1, len(n.inputs))))
        kept[name] = need
        todo += [n.inputs[k] for k in need]

    def real(name: str) -> str:
        while name in passed:
            name = passed[name]
        return name

    nodes = []
    for n in graph.nodes:
        if n.id not in kept:
            continue
        params = n.params
        if _op(n) == "compose.layers" and isinstance(params.get("layers"), list):
            params = params | {"layers": [params["layers"][k] for k in kept[n.id] if k < len(params["layers"])]}
        if n.kind == "redaction" and quality == "draft" and isinstance(params.get("masks"), dict):
            bare = [{k: v for k, v in s.items() if k != "asset"} for s in params["masks"].get("samples", [])]
            params = params | {"masks": params["masks"] | {"samples": bare}}
        nodes.append(dataclasses.replace(n, params=params, inputs=tuple(real(n.inputs[k]) for k in kept[n.id])))
    used = {n.asset for n in nodes if n.kind == "source"}
    outputs = tuple(dataclasses.replace(o, node=real(o.node)) for o in graph.outputs if o.node in kept or o.node in passed)
    small = Graph(tuple(a for a in graph.assets if a.id in used), tuple(nodes), outputs)
    ids = [n.id for n in graph.nodes]
    return Preview(out, tuple(x for x in ids if x in kept), tuple(x for x in ids if x not in kept and x not in passed), tuple(x for x in ids if x in passed), small)


def frame(ctx: Context, graph: Graph, t: MediaTime, quality: str = "proxy") -> tuple[Clip, DataFrame]:
    """The preview's clip and its frame at t, of the quality's size."""
    clip = next(iter(materialize(ctx, plan(graph, t, quality).graph).values()))
    w, h = output_size(clip.w, clip.h, quality)
    if (w, h) != (clip.w, clip.h):
        clip = clip.kernel(Resize(w, h))
    return clip, clip.frame_at(t.micros)
