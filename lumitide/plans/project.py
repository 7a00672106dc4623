"""Timeline documents: tracks of clips, gaps and nested sequences, compiled to a graph."""

from __future__ import annotations

import dataclasses
import json
from typing import Any

from ..errors import EngineError, UnknownId
from ..mediatime import HZ_1M, ZERO_MS, MediaTime
from .graph import Asset, Graph, Node, Output

VERSION = 1


def _time(x: Any) -> MediaTime:
    t = MediaTime.from_json(x, 1000)
    if t is None:
        raise EngineError(f"not a time: {x!r}")
    return t


@dataclasses.dataclass
class Layer:
    node: str
    start: MediaTime
    track: int


@dataclasses.dataclass
class Caption:
    uri: str
    start: MediaTime
    source: MediaTime
    duration: MediaTime


@dataclasses.dataclass(frozen=True)
class Compiled:
    graph: Graph
    warnings: tuple[str, ...]


def load(text: str | dict) -> dict:
    """A document at the current version; version 0 is brought up to 1."""
    try:
        d = json.loads(text) if isinstance(text, str) else dict(text)
        d["version"] = d["version"] or VERSION
        if d["version"] > VERSION:
            raise EngineError(f"unsupported project version {d['version']}")
    except (KeyError, TypeError, json.JSONDecodeError) as e:
        raise EngineError(f"not a project: {e!r}") from e
    return d


def active(project: dict) -> dict:
    sequences = project.get("sequences") or []
    if not sequences:
        raise EngineError("the project has no sequences")
    want = project.get("active_sequence")
    return sequences[0] if want is None else _find(sequences, want)


def _find(sequences: list[dict], name: str) -> dict:
    for s in sequences:
        if s["id"] == name:
            return s
    raise UnknownId(f"sequence {name}")


def record_duration(clip: dict) -> MediaTime:
    """How long a clip is on the timeline, after retiming."""
    src, r = _time(clip["source"]["duration"]), clip.get("retiming") or {"mode": "identity"}
    mode = r.get("mode", "identity")
    if mode == "identity":
        return src
    if mode == "speed":
        factor = float(r["factor"])
        played = src.over(factor)
        # a source that is counted in whole seconds may be played in parts of one
        return played if played.ticks * factor == src.ticks else src.rebase(max(src.timescale, HZ_1M)).over(factor)
    if mode == "freeze":
        return src.plus(_time(r["hold"]))
    if mode == "loop":
        if r.get("duration") is not None and _time(r["duration"]).ticks > 0:
            return _time(r["duration"])
        if (r.get("times") or 0) > 0:
            return src.times(int(r["times"]))
    raise EngineError(f"clip {clip['id']}: no duration under {mode}")


def span(sequence: dict) -> MediaTime:
    """The longest picture track; a nested sequence counts by its stated duration only."""
    best = ZERO_MS
    for t in sequence.get("tracks") or []:
        if t["kind"] == "video":
            total = ZERO_MS
            for i in t.get("items") or []:
                d = record_duration(i) if i["kind"] == "clip" else _time(i["duration"]) if i.get("duration") is not None else ZERO_MS
                total = total.plus(d)
            best = best.longest(total)
    return best


class _Compiler:
    def __init__(self, project: dict):
        self.sequences = project.get("sequences") or []
        self.media = {m["id"]: m for m in project.get("media") or []}
        self.open: set[str] = set()
        self.assets: dict[str, Asset] = {}
        self.nodes: list[Node] = []
        self.layers: list[Layer] = []
        self.sounds: list[Layer] = []
        self.captions: list[Caption] = []
        self.warnings: list[str] = []

    def node(self, prefix: str, operation: str | None, params: dict, *inputs: str, **more) -> str:
        name = f"n_{prefix}_{len(self.nodes)}"
        self.nodes.append(Node(name, more.pop("kind", "op"), inputs, operation=operation, params=params, **more))
        return name

    def medium(self, clip: dict) -> dict:
        if clip["media"] not in self.media:
            raise UnknownId(f"media {clip['media']}")
        return self.media[clip["media"]]

    def sequence(self, seq: dict) -> None:
        if seq["id"] in self.open:
            raise EngineError(f"nested sequence cycle at {seq['id']}")
        self.open.add(seq["id"])
        for k, track in enumerate(seq.get("tracks") or []):
            if track.get("muted"):
                self.warnings.append(f"{track['kind']} track {track['id']} is muted")
            else:
                self.track(track, k)
        self.open.discard(seq["id"])

    def track(self, track: dict, index: int) -> None:
        at = ZERO_MS
        for item in track.get("items") or []:
            if item["kind"] == "gap":
                at = at.plus(_time(item["duration"]))
            elif item["kind"] == "nested":
                child = _find(self.sequences, item["sequence"])
                length = span(child) if item.get("duration") is None else _time(item["duration"])
                marks = [(x, len(x)) for x in (self.layers, self.sounds, self.captions)]
                self.sequence(child)
                for listed, n in marks:
                    for x in listed[n:]:
                        x.start = at.plus(x.start)
                at = at.plus(length)
            elif track["kind"] == "subtitle":
                length = record_duration(item)
                self.captions.append(Caption(self.medium(item)["uri"], at, _time(item["source"]["start"]), length))
                at = at.plus(length)
            else:
                length = record_duration(item)
                node, overlap = self.clip(item)
                at = at.minus(overlap)
                at = at if at.ticks >= 0 else MediaTime(0, at.timescale)
                (self.sounds if track["kind"] == "audio" else self.layers).append(Layer(node, at, index))
                at = at.plus(length)

    def clip(self, clip: dict) -> tuple[str, MediaTime]:
        m = self.medium(clip)
        key = f"m_{m['id']}"
        # a medium of sound alone may be shown, too, so its role isn't passed on
        self.assets.setdefault(key, Asset(key, m["uri"], m.get("duration"), None if m.get("role") == "audio" else m.get("role")))
        node = self.node("src", None, {}, kind="source", asset=key)
        src = clip["source"]
        node = self.node("trim", "transform.trim", {k: _time(src[k]).to_json() for k in ("start", "duration")}, node)
        r = clip.get("retiming") or {}
        if r.get("mode") == "speed":
            node = self.node("speed", "transform.speed", {"factor": r["factor"]}, node)
        elif r.get("mode") == "freeze":
            node = self.node("freeze", "transform.freeze", {k: _time(r[k]).to_json() for k in ("at", "hold")}, node)
        elif r.get("mode") == "loop":
            p: dict[str, Any] = {"duration": _time(r["duration"]).to_json()} if r.get("duration") is not None else {}
            node = self.node("loop", "transform.loop", p | ({"times": r["times"]} if r.get("times") else {}), node)
        if clip.get("crop"):
            node = self.node("crop", "transform.crop", {k: clip["crop"][k] for k in "xywh"}, node)
            node = self.node("even", "transform.even_dims", {}, node)
            if clip.get("scale_to"):
                node = self.node("scale", "transform.scale", dict(zip("wh", clip["scale_to"])), node)
        return self.transition(clip, node, _time(src["duration"]).timescale)

    def transition(self, clip: dict, node: str, scale: int) -> tuple[str, MediaTime]:
        """The node with its transition, and how far it goes over what is before it.

        "Before" is the last picture layer of any track.
        """
        tr = clip.get("transition_in")
        if not tr:
            return node, MediaTime(0, scale)
        d = _time(tr["duration"])
        p = {"duration": d.to_json()}
        out, into, sides = {"fade": (None, "fade_in", ({}, {})), "dissolve": ("fade_out", "fade_in", ({}, {})), "wipe": ("slide_out", "slide_in", ({"side": "left"}, {"side": "right"}))}[tr["kind"]]
        if out and self.layers:
            self.layers[-1].node = self.node(out, f"transform.{out}", p | sides[0], self.layers[-1].node)
        node = self.node(into, f"transform.{into}", p | sides[1], node)
        if tr["kind"] == "wipe":
            self.warnings.append(f"clip {clip['id']}: a wipe becomes two opposing slides")
        return node, MediaTime(0, d.timescale) if tr["kind"] == "fade" else d


def semantic_params(refs: list[dict]) -> dict:
    """Adapter parameters: all references, and the ids of each kind."""
    out: dict[str, Any] = {"refs": [{"kind": r["kind"], "id": r["id"]} for r in refs]}
    for key, kind in (("subjects", "subject"), ("events", "event"), ("query", "query"), ("policy", "policy")):
        if ids := [r["id"] for r in refs if r["kind"] == kind]:
            out[key] = ids
    return out


def compile_project(project: dict | str) -> Compiled:
    """Pictures, then sound, captions, privacy and the output, in that order."""
    project = load(project)
    seq = active(project)
    c = _Compiler(project)
    if project.get("markers") or seq.get("markers"):
        c.warnings.append("markers are for editors and aren't compiled")
    c.sequence(seq)
    if not c.layers:
        raise EngineError("the active sequence has no picture clips")
    canvas = seq.get("canvas")
    if len(c.layers) == 1 and c.layers[0].start.ticks == 0 and not canvas:
        picture = c.layers[0].node
    else:
        params: dict[str, Any] = {"layers": [{"start": x.start.to_json(), "layer_index": x.track, "x": 0, "y": 0, "opacity": 1.0} for x in c.layers]}
        picture = c.node("comp", "compose.layers", params | (dict(zip("wh", canvas)) if canvas else {}), *[x.node for x in c.layers])
    if c.sounds:
        silent = c.node("adrop", "audio.drop", {}, picture)
        picture = c.node("mix", "audio.mix", {"tracks": [{}, *[{"start": s.start.to_json()} for s in c.sounds]]}, silent, *[s.node for s in c.sounds])
    if c.captions:
        cues = [{"uri": x.uri, "start": x.start.to_json(), "in": x.source.to_json(), "duration": x.duration.to_json()} for x in c.captions]
        picture = c.node("subs", "subtitle.burn", {"cues": cues}, picture)
    if refs := project.get("semantic"):
        picture = c.node("vision", "adapter.tracks", semantic_params(refs), picture)
        if any(r["kind"] in ("subject", "policy") for r in refs):
            picture = c.node("redact", None, {"masks": {"samples": []}, "style": {"kind": "gaussian", "sigma": 12.0}}, picture, kind="redaction")
    c.nodes.append(Node("n_out", "output", (picture,), name="main"))
    graph = Graph(tuple(c.assets[k] for k in sorted(c.assets)), tuple(c.nodes), (Output("main", "n_out"),))
    graph.validate()
    return Compiled(graph, tuple(c.warnings))
