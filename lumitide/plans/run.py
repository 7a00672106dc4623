"""Execution of compiled graphs: nodes in order become clips, and nothing runs until a sink does."""

from __future__ import annotations

import functools
import json
import math
from collections.abc import Callable, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructType

from .. import scratch
from ..clips import Clip
from ..errors import ContractError, MediaError, ParamError
from ..kernels import pictures as K
from ..kernels.masks import ASSET, decode
from ..mediatime import MediaTime
from ..operators import compose, frames, timing, vision
from ..operators.intervals import interval_join
from ..sources import documents
from . import registry as R
from .graph import CompiledGraph, Graph, compile_graph

SECOND = 1_000_000
Provider = Callable[[Clip, dict], DataFrame]


class Context:
    """What executors need besides clips: the session, seeds by asset id, adapters by name, and the folder of a mask package."""

    def __init__(self, spark: SparkSession, seeds: Mapping[str, Clip] | None = None, adapters: Mapping[str, Provider] | None = None, fps: float = 24.0, package: str | None = None):
        self.spark, self.seeds, self.adapters, self.fps, self.package = spark, dict(seeds or {}), dict(adapters or {}), fps, package


def _kernel(make: Callable[[dict], K.Kernel]) -> Callable:
    return lambda ctx, ups, p: ups[0].kernel(make(p))


def trim(ctx: Context, ups: list[Clip], p: dict) -> Clip:
    start, d = p["start"].micros, p["duration"].micros
    c = ups[0]
    if start < 0 or start + d > c.duration_us + 1:
        raise ParamError(f"trim {start}+{d} is beyond the clip's {c.duration_us}")
    out = c.timed(lambda v: timing.trim(v, start, d), d)
    if c.audio is not None:
        a, n = start * c.rate // SECOND, d * c.rate // SECOND
        out = out.replace(audio=c.audio.where((F.col("i") >= a) & (F.col("i") < a + n)).withColumn("i", F.col("i") - a))
    return out


def speed(ctx: Context, ups: list[Clip], p: dict) -> Clip:
    c, f = ups[0], p["factor"]
    out = c.timed(lambda v: timing.speed(v, f), round(c.duration_us / f), c.fps * f if c.fps else None)
    return out if c.audio is None else out.replace(audio=timing.speed_samples(c.audio, f))


def freeze(ctx: Context, ups: list[Clip], p: dict) -> Clip:
    c, at, hold = ups[0], p["at"].micros, p["hold"].micros
    if not 0 <= at < c.duration_us:
        raise ParamError(f"freeze at {at} is outside of the clip")
    return c.timed(lambda v: timing.freeze(v, at, hold), c.duration_us + hold)


def loop(ctx: Context, ups: list[Clip], p: dict) -> Clip:
    c = ups[0]
    if p["duration"] is not None:
        d = p["duration"].micros
        return c.timed(lambda v: timing.loop(v, until_us=d), d)
    return c.timed(lambda v: timing.loop(v, times=p["times"]), c.duration_us * p["times"])


def _time(x: Any) -> int:
    t = MediaTime.from_json(x)
    return t.micros if t else 0


def layers(ctx: Context, ups: list[Clip], p: dict) -> Clip:
    w, h = p["w"] or ups[0].w, p["h"] or ups[0].h
    specs = []
    for k, c in enumerate(ups):
        spec = p["layers"][k] if k < len(p["layers"]) and isinstance(p["layers"][k], dict) else {}
        index = R.natural(spec, "layer_index")
        opacity = R.number(spec, "opacity")
        specs.append({"clip": c, "dur_us": c.duration_us, "start_us": _time(spec.get("start")), "x": int(spec.get("x") or 0), "y": int(spec.get("y") or 0), "opacity": 1.0 if opacity is None else opacity, "layer_index": k if index is None else index})
    total = max(s["start_us"] + s["dur_us"] for s in specs)
    fps = max((c.fps for c in ups if c.fps), default=ctx.fps)
    b = p["background"]
    rgb = (0, 0, 0) if b is None else tuple(int(v) for v in ([b.get("r", 0), b.get("g", 0), b.get("b", 0)] if isinstance(b, dict) else b)[:3])

    def part(lo: int, hi: int) -> DataFrame:
        """The grid points from lo to hi, of what the layers show then; a point more at both ends, and frames of two."""
        step = SECOND / fps
        points = math.floor(lo / step) - 1, math.floor(hi / step) + 2
        near = [s | {"frames": s["clip"].around(math.floor((points[0] - 1) * step) - s["start_us"], math.ceil((points[1] + 1) * step) - s["start_us"]).pictures()} for s in specs]
        return compose.compose_frames(near, w, h, fps, total, rgb, points=points)

    whole = compose.compose_frames([s | {"frames": s["clip"].pictures()} for s in specs], w, h, fps, total, rgb)
    return Clip(whole, total, w, h, fps, ups[0].audio, ups[0].rate, ups[0].channels, part=part)


def concat(ctx: Context, ups: list[Clip], p: dict) -> Clip:
    if len(ups) < 2 or len({(c.w, c.h) for c in ups}) > 1:
        raise ContractError("a concatenation needs two clips or more, of one size")
    video = compose.concatenate([c.pictures() for c in ups], [c.duration_us for c in ups])
    audio = None
    if all(c.audio is not None for c in ups):
        if len({(c.rate, c.channels) for c in ups}) > 1:
            raise ContractError("sounds to be concatenated must have one format")
        audio = compose.concatenate_audio([c.audio for c in ups], [c.duration_us * c.rate // SECOND for c in ups])
    return Clip(video, sum(c.duration_us for c in ups), ups[0].w, ups[0].h, next((c.fps for c in ups if c.fps), None), audio, ups[0].rate, ups[0].channels)


def gain(ctx: Context, ups: list[Clip], p: dict) -> Clip:
    c = ups[0]
    return c if c.audio is None else c.replace(audio=c.audio.withColumn("v", F.col("v") * p["factor"]))


def mix(ctx: Context, ups: list[Clip], p: dict) -> Clip:
    tracks, end, form = [], 0, None
    for k, c in enumerate(ups):
        if c.audio is None:
            continue
        if form not in (None, (c.rate, c.channels)):
            raise ContractError("sounds to be mixed must have one format")
        form = (c.rate, c.channels)
        spec = p["tracks"][k] if k < len(p["tracks"]) and isinstance(p["tracks"][k], dict) else {}
        g, start = R.number(spec, "gain"), _time(spec.get("start"))
        tracks.append((c.audio, 1.0 if g is None else g, start))
        end = max(end, start + c.duration_us)
    if not tracks:
        raise ContractError("a mix needs at least one audio input")
    first = ups[0]
    return first.replace(audio=compose.mix(tracks, form[0]), rate=form[0], channels=form[1], duration_us=first.duration_us if first.video is not None else end)


MASK = "t struct<ticks: long, timescale: long>, subject string, cx double, cy double, radius double, conf double, lifecycle string, occluded boolean"


def mask_samples(ctx: Context, masks: dict, clip_id: str = "") -> DataFrame:
    """Mask samples of a timeline in a document."""
    rows = []
    for s in masks.get("samples") or []:
        t = MediaTime.from_json(s.get("t"))
        if t is None:
            raise ParamError("a mask sample has no time")
        side = [s.get(k) for k in ("left", "top", "right", "bottom")]
        cx, cy, r = s.get("cx"), s.get("cy"), s.get("radius")
        if cx is None and None not in side:
            cx, cy, r = (side[0] + side[2]) / 2, (side[1] + side[3]) / 2, math.hypot(side[2] - side[0], side[3] - side[1]) / 2
        if cx is None or cy is None:
            raise ParamError("a mask sample has no place")
        rows.append((s.get("subject"), t.micros, float(cx), float(cy), max(1.0, float(r or 1.0)), float(s.get("conf", 1.0)), s.get("lifecycle", "active"), bool(s.get("occluded", False)), mask_asset(s.get("asset"))))
    return _local(ctx.spark, rows, StructType.fromDDL(f"subject string, t_us long, cx double, cy double, radius double, conf double, lifecycle string, occluded boolean, asset {ASSET}"))


def _local(spark: SparkSession, rows: list[tuple], schema: StructType) -> DataFrame:
    """Rows of a document as a local relation, which, unlike one of Python objects, no Python workers unpack."""

    def named(values: tuple, fields: StructType) -> dict:
        return {f.name: v if v is None else named(v, f.dataType) if isinstance(f.dataType, StructType) else v if isinstance(v, str) or not isinstance(f.dataType, StringType) else json.dumps(v) for f, v in zip(fields, values)}

    return spark.createDataFrame(pa.Table.from_pylist([named(r, schema) for r in rows], to_arrow_schema(schema)), schema)


def mask_asset(ref: dict | None) -> tuple | None:
    """A mask asset of a document as a row; its pixels are checked here, so that a malformed one is no surprise later."""
    a = (ref or {}).get("asset")
    if a is None:
        return None
    num = lambda k: None if a.get(k) is None else int(a[k])
    data = a.get("data")
    ref_ = a.get("mask_ref")
    row = (a.get("kind"), num("width"), num("height"), num("left"), num("top"), None if data is None else bytes(data), None if a.get("runs") is None else [[int(n), int(v)] for n, v in a["runs"]], None if a.get("points") is None else [[float(x), float(y)] for x, y in a["points"]], a.get("package_id"), None if ref_ is None else str(ref_))
    try:
        decode(dict(zip(("kind", "w", "h", "left", "top", "data", "runs", "points"), row)))
    except MediaError as e:
        raise ParamError(f"mask asset: {e}") from None
    return row


def redaction_style(p: dict) -> tuple[str, float, tuple[int, int, int, int]]:
    style = p.get("style")
    if isinstance(style, str):
        style = {"kind": style}
    style = style or {}
    kind = style.get("kind") or style.get("type") or style.get("style") or "gaussian"
    if kind not in ("gaussian", "pixelate", "solid"):
        raise ParamError(f"unknown redaction style {kind}")
    amount = style.get("sigma", p.get("sigma", 12.0)) if kind == "gaussian" else style.get("block_size", 8)
    c = style.get("color") or {}
    colour = (c.get("r", 0), c.get("g", 0), c.get("b", 0), c.get("a", 255)) if isinstance(c, dict) else tuple(c)
    return kind, float(amount), (*colour, 255)[:4]


def redact(ctx: Context, ups: list[Clip], p: dict) -> Clip:
    """Regions of the node's own masks, or of those that came with the clip; always linear between samples."""
    c = ups[0]
    masks = p.get("masks") or {}
    masks = {"samples": masks} if isinstance(masks, list) else masks
    if masks.get("samples"):
        samples = mask_samples(ctx, masks)
    elif c.masks is not None:
        samples = c.masks
    else:
        raise ParamError("a redaction needs masks")
    if vision.prune(samples).isEmpty():
        raise ContractError("a redaction's masks have no sample that contributes")
    kind, amount, colour = redaction_style(p)
    # masks have no clip id: they hold for every clip.  Times come from the frames before their kernels, which so run once
    grid = timing.to_grid(c.video, c.fps or ctx.fps).drop("idx")
    made = frames.redacted(frames.apply(vision.with_regions(grid, samples, clips=False), c.chain), kind, amount, colour)
    return c.replace(video=made, chain=(), masks=None)


def burn(ctx: Context, ups: list[Clip], p: dict) -> Clip:
    """Cues within each part's window, moved to the timeline, as text at the bottom: one relation, however many cues there are."""
    c, cues = ups[0], None
    for part, spec in enumerate(p["cues"]):
        lo, dur, start = _time(spec.get("in")), _time(spec.get("duration")), _time(spec.get("start"))
        one = window_cues(documents.cues(documents.texts(ctx.spark, spec["uri"])), lo, dur, start).select(F.lit(part).alias("part"), "start_us", "nth", "end_us", "text")
        cues = one if cues is None else cues.unionByName(one)
    if cues is None:
        return c
    grid = timing.to_grid(c.video, c.fps or ctx.fps).drop("idx")
    on = interval_join(grid.select(F.col("t_us").alias("at_us")).distinct(), cues, "at_us", "start_us", "end_us")
    lists = on.groupBy(F.col("at_us").alias("t_us")).agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "start_us", "nth", "text"))), lambda x: x["text"]).alias("cues"))
    joined = grid.join(scratch.small(lists), "t_us", "left").select(*grid.columns, "cues")
    return c.replace(video=frames.captioned(frames.apply(joined, c.chain)), chain=())


def window_cues(cues: DataFrame, in_us: int, dur_us: int, start_us: int) -> DataFrame:
    """Cues that overlap [in, in + dur), moved by start - in; they aren't cut at its ends."""
    at = lambda x: F.round(F.col(x) * SECOND).cast("bigint")
    hit = cues.where((at("end") > in_us) & (at("start") < in_us + dur_us))
    return hit.withColumns({"start_us": at("start") + (start_us - in_us), "end_us": at("end") + (start_us - in_us)})


def adapt(ctx: Context, ups: list[Clip], p: dict) -> Clip:
    """Masks of the package that is named, else from the named adapter, else from tracks or masks in the parameters; pictures pass."""
    c, params = ups[0], p["params"]
    if params.get("package_id") and ctx.package is not None:
        return c.replace(masks=package_masks(ctx, params["package_id"]))
    provider = ctx.adapters.get(p["name"])
    if provider is not None:
        return c.replace(masks=provider(c, params))
    if params.get("masks"):
        m = params["masks"]
        return c.replace(masks=mask_samples(ctx, {"samples": m} if isinstance(m, list) else m))
    doc = params.get("tracks") or params.get("document")
    if doc is not None:
        text = doc if isinstance(doc, str) else json.dumps(doc)
        rows = ctx.spark.createDataFrame([("params", text)], "doc string, text string")
        found = vision.mask_samples(documents.tracks(rows))
        return c.replace(masks=found.select("subject", "t_us", "cx", "cy", "radius", "conf", "lifecycle", "occluded"))
    return c


def package_masks(ctx: Context, package_id: str) -> DataFrame:
    """Mask samples of the context's package, which must have this id, with the pixels of its blobs."""
    found, tracks = documents.package_tracks(ctx.spark, ctx.package)
    if found != package_id:
        raise MediaError(f"the mask package is {found}, not {package_id}")
    samples = vision.mask_samples(documents.tracks(tracks))
    blobs = documents.mask_packages(ctx.spark, ctx.package)
    pixels = F.struct("kind", "w", "h", F.col("x").alias("left"), F.col("y").alias("top"), "data", F.lit(None).cast("array<array<bigint>>").alias("runs"), F.lit(None).cast("array<array<double>>").alias("points"), "package_id", "mask_ref").cast(ASSET)
    assets = blobs.select("package_id", "mask_ref", "path", pixels.alias("asset"))
    refs = samples.select("subject", "t_us", "cx", "cy", "radius", "conf", "lifecycle", "occluded", F.lit(found).alias("package_id"), F.col("mask.observation").alias("mask_ref"), F.col("mask.uri").alias("path"))
    return vision.resolve(refs, assets).drop("package_id", "mask_ref", "path")


def hinted(ctx: Context, ups: list[Clip], p: dict) -> Clip:
    return ups[0].replace(hints=ups[0].hints | {k: v for k, v in p.items() if v is not None})


def encode(ctx: Context, ups: list[Clip], p: dict) -> Clip:
    c = hinted(ctx, ups, p)
    return c.replace(audio=None) if p["preserve_audio"] is False else c


def _secs(t: MediaTime) -> float:
    return max(t.secs, 1e-9)


def builtins() -> R.Registry:
    """All operations, with their executors."""
    found = R.Registry()
    add = lambda *a, **k: found.register(R.Descriptor(*a, **k))
    heavy = R.Cost(2.0, 2.0, 0.5)
    sound = R.Contract(audio=True)
    add("transform.trim", "native", R.trim, trim)
    add("transform.crop", "native", R.crop, _kernel(lambda p: K.Crop(**p)), cost=heavy)
    add("transform.scale", "native", R.scale, _kernel(lambda p: K.Resize(p["w"], p["h"], "bicubic")), cost=heavy)
    add("transform.hflip", "native", R.nothing, _kernel(lambda p: K.HFlip()))
    add("transform.vflip", "native", R.nothing, _kernel(lambda p: K.VFlip()))
    add("transform.even_dims", "native", R.nothing, _kernel(lambda p: K.EvenSize()))
    add("transform.rotate", "kernel", R.rotate, _kernel(lambda p: K.Rotate(p["degrees"])))
    add("transform.fade_in", "kernel", R.fade, _kernel(lambda p: K.Fade(_secs(p["duration"]))))
    add("transform.fade_out", "kernel", R.fade, _kernel(lambda p: K.Fade(_secs(p["duration"]), False)))
    add("transform.slide_in", "kernel", R.slide("right"), _kernel(lambda p: K.Slide(_secs(p["duration"]), p["side"], True)))
    add("transform.slide_out", "kernel", R.slide("left"), _kernel(lambda p: K.Slide(_secs(p["duration"]), p["side"], False)))
    add("transform.speed", "kernel", R.speed, speed)
    add("transform.freeze", "kernel", R.freeze, freeze)
    add("transform.loop", "kernel", R.loop, loop)
    add("color.black_and_white", "kernel", R.nothing, _kernel(lambda p: K.BlackAndWhite()))
    add("color.invert", "kernel", R.nothing, _kernel(lambda p: K.Invert()))
    add("color.painting", "kernel", R.painting, _kernel(lambda p: K.Painting(**{k: v for k, v in p.items() if v is not None})), cost=R.Cost(4.0, 2.0, 0.5))
    add("compose.layers", "kernel", R.layers, layers, nary=True, cost=R.Cost(3.0, 4.0, 0.5))
    add("timeline.concat", "kernel", R.concat, concat, nary=True, cost=heavy)
    add("audio.gain", "kernel", R.gain, gain, needs=sound)
    add("audio.drop", "kernel", R.nothing, lambda ctx, ups, p: ups[0].replace(audio=None), needs=R.Contract())
    add("audio.preserve", "kernel", R.nothing, lambda ctx, ups, p: ups[0].replace(hints=ups[0].hints | {"preserve_audio": True}), needs=R.Contract())
    add("audio.mix", "kernel", R.mix, mix, nary=True, needs=R.Contract())
    add("redaction.region", "kernel", R.redaction, redact, cost=R.Cost(5.0, 3.0, 0.5))
    add("subtitle.burn", "kernel", R.burn, burn)
    add("adapter.tracks", "adapter", R.adapter, adapt)
    add("gpu.passthrough", "device", R.device, hinted, cost=R.Cost(1.0, 1.0, 2.0, 4.0))
    add("encode.hw", "device", R.device, hinted, cost=R.Cost(1.0, 1.0, 2.0, 4.0), deterministic=False)
    add("encode.h264", "native", R.encode, encode, cost=R.Cost(8.0, 2.0, 5.0), deterministic=False)
    return found


@functools.cache
def default_registry() -> R.Registry:
    return builtins()


def open_asset(ctx: Context, uri: str, role: str | None) -> Clip:
    """A clip of a Parquet folder of frames or of samples."""
    if role == "audio":
        return Clip(None, 0, audio=documents.read_samples(ctx.spark, uri))
    df = documents.read_frames(ctx.spark, uri)
    facts = df.select(F.max("dur_us").alias("d"), F.max("w").alias("w"), F.max("h").alias("h"), F.min(F.col("e_us") - F.col("t_us")).alias("step")).first()
    if facts["d"] is None:
        raise MediaError(f"{uri} has no frames")
    return Clip(df, facts["d"], facts["w"], facts["h"], round(SECOND / facts["step"], 3) if facts["step"] else None)


def materialize(ctx: Context, graph: Graph | CompiledGraph, registry: R.Registry | None = None, keep: Callable[[int, Clip], Clip] | None = None) -> dict[str, Clip]:
    """A clip for each output of the graph, each its own; pictures and sound aren't computed yet.

    A seed goes before its asset's file.  keep: what later nodes see of the node with an index.
    """
    registry = registry or default_registry()
    c = graph if isinstance(graph, CompiledGraph) else compile_graph(graph, registry)
    assets = {a.id: a for a in c.assets}
    made: list[Clip] = []
    for n in c.nodes:
        ups = [made[i] for i in n.inputs]
        if n.node.kind == "source":
            a = assets[n.node.asset]
            made.append(ctx.seeds[a.id] if a.id in ctx.seeds else open_asset(ctx, a.uri, a.role))
        elif n.node.kind == "output":
            made.append(ups[0])
        elif n.node.kind == "redaction":
            made.append(redact(ctx, ups, n.params))
        else:
            made.append(registry.executable(n.node.operation).run(ctx, ups, n.params))
        if keep is not None:
            made[-1] = keep(n.index, made[-1])
    return {name: made[k] for name, k, _ in c.outputs}
