"""Redaction, captions, retimed sound and graphs over whole tables, and the small facts of media."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..clips import Clip
from ..functions import geometry as G
from ..functions import mediatime as T
from ..functions import sound as S
from ..kernels import pictures as K
from ..mediatime import MediaTime
from ..operators import frames as FR
from ..operators import measures, timing, vision
from ..plans import jobs, linear, preview
from ..plans.graph import Graph
from ..plans.project import compile_project
from ..plans.run import Context, materialize
from ..scratch import folder
from ..sources import documents, write
from . import query
from .sight import _bytes, _extent, _frames
from .views import EV, PCM, PX, RGB, colours, events, joined, masks, pictures, samples, table


def _graph(*nodes: tuple) -> dict:
    """A graph document from (id, operation or a whole body, params, inputs); the last node is the output's."""
    op = lambda b, p: b if isinstance(b, dict) else {"kind": "op", "operation": b, "params": p}
    made = [{"id": n, "body": op(b, p), "inputs": list(i)} for n, b, p, i in nodes]
    sources = [{"id": a, "body": {"kind": "source", "asset": a}, "inputs": []} for a in sorted({x for *_, i in nodes for x in i} - {n for n, *_ in nodes})]
    out = {"id": "out", "body": {"kind": "output", "name": "main"}, "inputs": [nodes[-1][0]]}
    return {"version": 1, "assets": [{"id": s["id"], "uri": "seed"} for s in sources], "outputs": [{"name": "main", "node": "out"}], "nodes": [*sources, *made, out]}


def _run(spark: SparkSession, doc: dict, **clips: Clip) -> Clip:
    return materialize(Context(spark, clips), Graph.from_json(doc))["main"]


def _all(spark: SparkSession, sf_dir: str) -> Clip:
    """All pictures as one clip, a second each."""
    end = _extent(spark, sf_dir)
    return Clip(_frames(spark, sf_dir).withColumns({"clip_id": F.lit("all"), "dur_us": F.lit(end).cast("bigint")}), end, 8, 8, 1.0)


# redaction


def _redacted(spark: SparkSession, sf_dir: str, assets: list, style: dict, place: dict | None = None) -> DataFrame:
    """Pictures with one subject hidden: by the first asset, and from the middle of the table on by the last one."""
    clip = _all(spark, sf_dir)
    half = clip.duration_us // 2_000_000
    sample = lambda t, a: {"t": {"ticks": t, "timescale": 1}, "subject": "a", **(place or {"cx": 4.0, "cy": 4.0, "radius": 2.0}), **({"asset": {"asset": a}} if a else {})}
    doc = _graph(("hide", {"kind": "redaction", "redaction": {"masks": {"samples": [sample(0, assets[0]), sample(half, assets[-1])]}, "style": style}}, None, ["src"]))
    return _bytes(_run(spark, doc, src=clip).pictures())


_HALF = "hf AS (SELECT (max(vec_id) + 1) // 2 AS half FROM embeddings)"


def _hidden(cover: str, new: str, views: str = "") -> str:
    """Pixels blended by a coverage of 0 to 1 at pixel i of the frame at vec_id; ``new`` is what hides them."""
    return f"WITH {PX}, {_HALF}{views} SELECT vec_id, array_to_string(list_transform(range(64), lambda i: CASE WHEN {cover} > 0 THEN CAST(floor(px[i + 1] * (1e0 - {cover}) + ({new}) * {cover} + 0.5e0) AS INTEGER) ELSE px[i + 1] END), ',') AS px FROM fr, hf"


_P1, _P2 = [(1, 1), (6.5, 2), (4, 7)], [(0, 0), (3, 0), (3, 3), (8, 4), (7.5, 7.5), (2, 6)]


def _inside(points: list) -> str:
    """Whether the middle of pixel i is in a polygon, by the even-odd rule."""
    edges = zip(points, points[1:] + points[:1])
    x, y = "(i % 8 + 0.5e0)", "(i // 8 + 0.5e0)"
    return "(" + " + ".join(f"CASE WHEN ({float(a[1])} > {y}) <> ({float(b[1])} > {y}) AND {x} < {float(a[0])} + ({y} - {float(a[1])}) * {float(b[0]) - float(a[0])} / {float(b[1]) - float(a[1])} THEN 1 ELSE 0 END" for a, b in edges if a[1] != b[1]) + ") % 2"


@query(_hidden(f"(CASE WHEN vec_id < half THEN {_inside(_P1)} ELSE {_inside(_P2)} END)", "200"))
def redact_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two polygons cover, filled; the second holds from its time on."""
    return _redacted(spark, sf_dir, [{"kind": "polygon", "points": _P1}, {"kind": "polygon", "points": _P2}], {"kind": "solid", "color": {"r": 200, "g": 0, "b": 0, "a": 255}})


_RUNS = [(10, 0), (5, 255), (20, 0), (9, 128), (20, 0)]
_AT = "(CASE WHEN i BETWEEN 10 AND 14 THEN 1e0 WHEN i BETWEEN 35 AND 43 THEN 128e0 / 255e0 ELSE 0e0 END)"


@query(_hidden(_AT, "10"))
def redact_rle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _redacted(spark, sf_dir, [{"kind": "rle", "width": 8, "height": 8, "runs": _RUNS}], {"kind": "solid", "color": {"r": 10, "g": 0, "b": 0, "a": 255}})


_MEAN = "list_avg(list_transform(list_filter(range(64), lambda j: j // 24 = i // 24 AND (j % 8) // 3 = (i % 8) // 3), lambda j: px[j + 1]))"


@query(_hidden("(CASE WHEN i % 8 BETWEEN 2 AND 5 AND i // 8 BETWEEN 1 AND 5 THEN 1e0 ELSE 0e0 END)", _MEAN))
def redact_pixelate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cropped silhouette in blocks of three; the other sample has none, so the first holds."""
    return _redacted(spark, sf_dir, [{"kind": "cropped", "left": 2, "top": 1, "width": 4, "height": 5, "data": [255] * 20}, None], {"kind": "pixelate", "block_size": 3})


_R = "sqrt((i % 8 - 3.5e0) * (i % 8 - 3.5e0) + (i // 8 - 3e0) * (i // 8 - 3e0))"
_SOFT = f"(CASE WHEN {_R} <= 3e0 - 1.05e0 THEN 1e0 WHEN {_R} >= 3e0 THEN 0e0 ELSE 1e0 - (({_R} - 1.95e0) / 1.05e0) * (({_R} - 1.95e0) / 1.05e0) * (3e0 - 2e0 * (({_R} - 1.95e0) / 1.05e0)) END * 200e0 / 255e0)"


@query(_hidden(_SOFT, "90"))
def redact_solid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feathered disc of a half transparent colour."""
    return _redacted(spark, sf_dir, [None], {"kind": "solid", "color": {"r": 90, "g": 0, "b": 0, "a": 200}}, {"cx": 3.5, "cy": 3.0, "radius": 3.0})


# retimed sound


@query(f"WITH {PCM} SELECT clip_id, unnest(range(CAST(ceil(i / 1.5e0) AS BIGINT), CAST(ceil((i + 1) / 1.5e0) AS BIGINT))) AS i, ch, round(v, 6) AS v FROM pcm")
def speed_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All clips half as fast again, through a graph."""
    clip = Clip(None, 1_000_000, audio=samples(spark, sf_dir).drop("label"), rate=32)
    made = _run(spark, _graph(("fast", "transform.speed", {"factor": 1.5}, ["src"])), src=clip)
    return made.audio.select("clip_id", "i", "ch", F.round("v", 6).alias("v"))


@query(f"WITH {PCM} SELECT clip_id, 31 - i AS i, ch, round(v, 6) AS v FROM pcm")
def mirror_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.mirror_samples(samples(spark, sf_dir), 32).select("clip_id", "i", "ch", F.round("v", 6).alias("v"))


# kernels


@query(f"WITH {PX} SELECT vec_id, array_to_string(list_transform(range(24), lambda i: px[(i // 6 + 1) * 8 + i % 6 + 2]), ',') AS px FROM fr")
def even_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bytes(FR.apply(_frames(spark, sf_dir), [K.Crop(1, 1, 7, 5), K.EvenSize()]))


def _cubic(n: int, axis: str) -> str:
    """Place and four weights of each of n samples from 8."""
    return f"{axis} AS (SELECT d AS {axis}_, CAST(floor(s) AS INTEGER) AS {axis}i, -0.5e0 * u * u * u + u * u - 0.5e0 * u AS {axis}0, 1.5e0 * u * u * u - 2.5e0 * u * u + 1e0 AS {axis}1, -1.5e0 * u * u * u + 2e0 * u * u + 0.5e0 * u AS {axis}2, 0.5e0 * u * u * u - 0.5e0 * u * u AS {axis}3 FROM (SELECT d, s, s - floor(s) AS u FROM (SELECT d, least(greatest((d + 0.5e0) * 8e0 / {n}e0 - 0.5e0, 0e0), 7e0) AS s FROM range({n}) AS r(d))))"


def _taps() -> str:
    at = lambda a, k: f"least(greatest({a}i + {k - 1}, 0), 7)"
    return " + ".join(f"y{j} * (" + " + ".join(f"x{k} * px[{at('y', j)} * 8 + {at('x', k)} + 1]" for k in range(4)) + ")" for j in range(4))


@query(f"WITH {PX}, {_cubic(16, 'x')}, {_cubic(4, 'y')}, v AS (SELECT vec_id, y_ * 16 + x_ AS i, CAST(least(greatest(floor({_taps()} + 0.5e0), 0), 255) AS INTEGER) AS v FROM fr, x, y) SELECT vec_id, array_to_string(list(v ORDER BY i), ',') AS px FROM v GROUP BY vec_id")
def resize_bicubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As a graph's scale does it; at these sizes all weights are binary fractions, so that SQL's doubles round alike."""
    made = _run(spark, _graph(("big", "transform.scale", {"w": 16, "h": 4}, ["src"])), src=_all(spark, sf_dir))
    return _bytes(made.pictures())


def _weights(sigma: float, r: int) -> str:
    """Gaussian weights as a list of 4-byte floats, like those that a picture is blurred with."""
    x = np.arange(-r, r + 1, dtype=np.float32)
    k = np.exp(-(x * x) / np.float32(2 * sigma * sigma)).astype(np.float32)
    return "[" + ", ".join(f"CAST({v!r} AS FLOAT)" for v in (k / k.sum(dtype=np.float32)).tolist()) + "]"


def _blurred(source: str, place: str) -> str:
    taps = f"list_reduce(list_transform(range(7), lambda k: w[k + 1] * CAST({source}[{place} + 1] AS FLOAT)), lambda a, b: a + b)"
    return f"list_transform(range(64), lambda i: CAST(floor({taps} + CAST(0.5 AS FLOAT)) AS INTEGER))"


@query(f"""WITH {PX}, g AS (SELECT {_weights(0.8, 3)} AS w), a AS (SELECT vec_id, w, {_blurred("px", "(i // 8) * 8 + least(greatest(i % 8 + k - 3, 0), 7)")} AS px FROM fr, g)
SELECT vec_id, array_to_string({_blurred("px", "least(greatest(i // 8 + k - 3, 0), 7) * 8 + i % 8")}, ',') AS px FROM a""")
def gaussian_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Across, then down, rounded between; the whole picture is the region."""
    return _redacted(spark, sf_dir, [{"kind": "dense", "width": 8, "height": 8, "data": [255] * 64}], {"kind": "gaussian", "sigma": 0.8})


@query(f"WITH {RGB} SELECT vec_id, array_to_string(px, ',') AS px FROM rgb")
def drop_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb = colours(spark, sf_dir)
    one = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.concat(F.slice("px", i * 3 + 1, 3), F.array((i * 4).cast("int")))))
    rows = rgb.select(F.lit("all").alias("clip_id"), "vec_id", F.lit(0).cast("bigint").alias("t_us"), F.lit(1).cast("bigint").alias("e_us"), F.lit(1).cast("bigint").alias("dur_us"), one.alias("px"))
    return _bytes(FR.apply(FR.from_arrays(rows, "px", 8, 8, 4), [K.DropAlpha()]))


@query(f"""WITH {PX}, s AS (SELECT vec_id, px, list_transform(range(64), lambda i: px[i + 1] - 16) AS c, list_transform(range(64), lambda i: px[(i // 16) * 4 + (i % 8) // 2 + 1 + 16] - 128) AS d, list_transform(range(64), lambda i: px[(i // 16) * 4 + (i % 8) // 2 + 1 + 32] - 128) AS e FROM fr)
SELECT vec_id, array_to_string(flatten(list_transform(range(64), lambda i: [least(greatest((298 * c[i + 1] + 409 * e[i + 1] + 128) >> 8, 0), 255), least(greatest((298 * c[i + 1] - 100 * d[i + 1] - 208 * e[i + 1] + 128) >> 8, 0), 255), least(greatest((298 * c[i + 1] + 516 * d[i + 1] + 128) >> 8, 0), 255)])), ',') AS px FROM s""".replace(">> 8", "// 256").replace("least(greatest((298", "least(greatest(CAST(floor((298").replace("// 256, 0)", "/ 256e0) AS INTEGER), 0)"))
def surface_to_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes of luma and of two halved chromas, limited range."""
    p = pictures(spark, sf_dir)
    plane = lambda lo, n: F.slice("px", lo, n).alias(f"p{lo}_{n}")
    parts = p.select("vec_id", plane(1, 64), plane(17, 16), plane(33, 16))
    planes = ("p1_64", "p17_16", "p33_16")
    s = FR.packed(parts, planes, [f"{c}_" for c in planes]).select("vec_id", F.lit("yuv420p").alias("format"), F.lit(8).alias("w"), F.lit(8).alias("h"), F.array("p1_64_", "p17_16_", "p33_16_").alias("planes"), F.lit("bt601").alias("colour_space"), F.lit("limited").alias("colour_range"))
    return FR.to_arrays(FR.surfaces_to_rgb(s)).select("vec_id", joined("px"))


# graphs of several clips


@query(f"WITH {PX}, n AS (SELECT max(vec_id) + 1 AS n FROM embeddings) SELECT vec_id + part * n AS at, array_to_string(list_transform(px, lambda v: CASE part WHEN 0 THEN v ELSE 255 - v END), ',') AS px FROM fr, n, range(0, 2) AS r(part)")
def graph_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pictures, then all of them inverted, as one clip."""
    made = _run(spark, _graph(("inv", "color.invert", {}, ["src"]), ("both", "timeline.concat", {}, ["src", "inv"])), src=_all(spark, sf_dir))
    return FR.to_arrays(made.pictures()).select((F.col("t_us") / 1_000_000).cast("bigint").alias("at"), joined("px"))


@query(f"WITH {RGB}, c AS (SELECT vec_id, list_transform(range(192), lambda i: CASE WHEN (i // 3) % 8 >= 2 AND i // 24 >= 1 THEN floor(px[((i // 24 - 1) * 8 + (i // 3) % 8 - 2) * 3 + i % 3 + 1] * 0.5e0 + (255 - px[i + 1]) * 0.5e0 + 0.5e0) ELSE 255 - px[i + 1] END) AS px FROM rgb) SELECT vec_id AS idx, array_to_string(list_transform(px, lambda v: CAST(v AS INTEGER)), ',') AS px FROM c")
def graph_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each picture, half transparent and moved, over its inverse."""
    end = _extent(spark, sf_dir)
    rgb = colours(spark, sf_dir).select(F.lit("all").alias("clip_id"), (F.col("vec_id") * 1_000_000).alias("t_us"), ((F.col("vec_id") + 1) * 1_000_000).alias("e_us"), F.lit(end).cast("bigint").alias("dur_us"), "px")
    clip = Clip(FR.from_arrays(rgb, "px", 8, 8, 3), end, 8, 8, 1.0)
    doc = _graph(("inv", "color.invert", {}, ["src"]), ("lay", "compose.layers", {"layers": [{"layer_index": 0}, {"layer_index": 1, "x": 2, "y": 1, "opacity": 0.5}]}, ["inv", "src"]))
    return FR.to_arrays(_run(spark, doc, src=clip).pictures()).select("idx", joined("px"))


@query(f"WITH {PCM}, p AS (SELECT i + clip_id * 64 AS i, ch, v FROM pcm) SELECT i, ch, round(greatest(least(sum(v), 1e0), -1e0), 6) AS v FROM (SELECT i, ch, v * 2e0 AS v FROM p UNION ALL SELECT i + 2, ch, v * 0.5e0 FROM p) GROUP BY ALL")
def graph_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All clips after each other, louder, mixed with a later and softer copy."""
    pcm = samples(spark, sf_dir).select(F.lit("all").alias("clip_id"), (F.col("i") + F.col("clip_id") * 64).alias("i"), "ch", "v")
    clip = Clip(None, _extent(spark, sf_dir) * 7, audio=pcm, rate=10)
    doc = _graph(("loud", "audio.gain", {"factor": 2.0}, ["src"]), ("mix", "audio.mix", {"tracks": [{"gain": 1.0}, {"gain": 0.5, "start": {"ticks": 200, "timescale": 1000}}]}, ["loud", "src"]))
    return _run(spark, doc, src=clip).audio.select("i", "ch", F.round("v", 6).alias("v"))


# captions

#: Cues of a caption file, which is read whole.
CUES = 2000


@query("""WITH c AS (SELECT conv_id, turn, CAST(floor(conv_id * 20 + turn * 3.25e0) AS BIGINT) AS s, conv_id * 20000 + turn * 3250 AS s_ms, regexp_replace(text, '[^a-zA-Z0-9]+', '', 'g') AS text FROM conversations),
g AS (SELECT unnest(range((SELECT max(conv_id) + 1 FROM conversations) * 20)) AS sec) SELECT sec, count(text) > 0 AS lit FROM g LEFT JOIN c ON sec * 1000 >= s_ms AND sec * 1000 < s_ms + 2500 AND text <> '' GROUP BY sec""")
def subtitle_burn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as caption files, burnt onto black pictures: when is there any text?"""
    text = F.regexp_replace("text", "[^a-zA-Z0-9]+", "")
    stamp = lambda ms: F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)
    ms = F.col("conv_id").cast("bigint") * 20_000 + F.col("turn").cast("bigint") * 3250
    cue = F.concat(F.lit("1\n"), stamp(ms), F.lit(" --> "), stamp(ms + 2500), F.lit("\n"), text, F.lit("\n"))
    at = f"{folder(spark)}/cues"
    table(spark, sf_dir, "conversations").where(text != "").select(cue.alias("value")).write.option("maxRecordsPerFile", CUES).text(at)
    end = (table(spark, sf_dir, "conversations").agg(F.max("conv_id")).first()[0] + 1) * 20_000_000
    black = spark.range(end // 1_000_000).select(F.lit("all").alias("clip_id"), (F.col("id") * 1_000_000).alias("t_us"), ((F.col("id") + 1) * 1_000_000).alias("e_us"), F.lit(end).cast("bigint").alias("dur_us"), F.lit(16).alias("w"), F.lit(40).alias("h"), F.lit(1).alias("channels"), F.unhex(F.repeat(F.lit("00"), 640)).alias("data"))
    made = _run(spark, _graph(("burn", "subtitle.burn", {"cues": [{"uri": f"{at}/*.txt", "in": 0, "duration": {"ticks": end, "timescale": 1_000_000}, "start": 0}]}, ["src"])), src=Clip(black, end, 16, 40, 1.0))
    return made.pictures().select((F.col("t_us") / 1_000_000).cast("bigint").alias("sec"), (F.regexp_replace(F.hex("data"), "0", "") != "").alias("lit"))


@query("SELECT conv_id, turn, greatest(2.5e0 - turn % 4, 0e0) AS secs FROM conversations")
def cue_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("turn") * 3.0
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", S.cue_duration(at + F.col("turn") % 4, at + 2.5).alias("secs"))


# facts


@query(f"WITH {EV} SELECT event_type, count(*) AS n FROM ev WHERE event_type IN ('view', 'click') OR k % 5 = 4 GROUP BY event_type".replace("event_type IN ('view', 'click') OR k % 5 = 4", "k % 5 IN (0, 1, 4)"))
def occlusion_contributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.get(F.array(*map(F.lit, ("visible", "partial", "occluded", "lost", "unknown"))), F.col("k") % 5)
    return events(spark, sf_dir).where(G.occlusion_contributes(state)).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size * 1000000 WHEN 1 THEN p_size * 1000000 + 500000 WHEN 2 THEN p_size END AS ticks, CASE p_partkey % 3 WHEN 2 THEN 30 ELSE 1000000 END AS timescale FROM part")
def time_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, k = F.col("p_size"), F.col("p_partkey") % 3
    text = F.when(k == 0, size.cast("string")).when(k == 1, F.concat(size.cast("string"), F.lit(".5"))).otherwise(F.to_json(F.struct(size.alias("ticks"), F.lit(30).alias("timescale"))))
    t = T.from_json(text)
    return table(spark, sf_dir, "part").select("p_partkey", t["ticks"].cast("bigint").alias("ticks"), t["timescale"].cast("int").alias("timescale"))


@query("SELECT p_partkey, CAST(floor(p_retailprice * 48) AS BIGINT) AS samples, CASE WHEN p_size % 7 = 0 THEN 0 ELSE greatest(1, CAST(round(p_size / 40e0 * (p_size % 7)) AS BIGINT)) END AS frames FROM part")
def counts_for_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", S.frames_for(F.col("p_retailprice"), F.lit(48.0)).alias("samples"), T.frame_count(size / 40.0, size % 7).alias("frames"))


@query(f"WITH {EV}, p AS (SELECT user_id, min(value) AS l, min(k) AS t, max(value) AS r, max(k) AS b FROM ev GROUP BY user_id) SELECT user_id, l, CAST(t AS DOUBLE) AS t, r, CAST(b AS DOUBLE) AS b FROM p")
def polygon_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = events(spark, sf_dir).groupBy("user_id").agg(F.collect_list(F.struct(F.col("value").alias("x"), F.col("k").cast("double").alias("y"))).alias("points"))
    box = G.polygon_box(F.col("points"))
    return points.select("user_id", *[box[c].alias(c) for c in "ltrb"])


@query(f"WITH {EV}, s AS (SELECT user_id, t_us, row_number() OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS nth, event_id FROM ev) SELECT user_id, event_id FROM s WHERE nth <= 5")
def first_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five packets of each stream: the limit is the feature."""
    return timing.first_packets(events(spark, sf_dir), 5, "t_us", ["user_id"], ["event_id"]).select("user_id", "event_id")


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN p_size * 1000 END AS sample_rate, CASE WHEN p_partkey % 4 > 0 THEN p_size % 3 END AS channels, p_partkey % 4 > 0 AS has_audio FROM part")
def probe_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe documents with a sound stream in three of four."""
    s = F.col("p_size")
    video = F.struct(F.lit("video").alias("codec_type"), (s * 16).alias("width"), F.lit(None).cast("string").alias("sample_rate"), F.lit(None).cast("int").alias("channels"))
    sound = F.struct(F.lit("audio").alias("codec_type"), F.lit(None).cast("int").alias("width"), (s * 1000).cast("string").alias("sample_rate"), (s % 3).alias("channels"))
    streams = F.when(F.col("p_partkey") % 4 > 0, F.array(video, sound)).otherwise(F.array(video))
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("doc"), F.to_json(F.struct(streams.alias("streams"))).alias("text"))
    got = documents.probes(docs)
    return got.select(F.col("doc").cast("bigint").alias("p_partkey"), "sample_rate", F.col("channels").cast("int").alias("channels"), "has_audio")


@query(f"WITH {EV} SELECT CAST(user_id AS VARCHAR) AS subject, count(*) AS n, count(*) FILTER (WHERE k % 5 IN (2, 3)) AS hidden, min(greatest(k % 3, 1)) AS least FROM ev GROUP BY user_id")
def masks_of_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask samples of track samples: occluded ones are told apart, radii are 1 at least."""
    state = F.get(F.array(*map(F.lit, ("visible", "partial", "occluded", "lost", "unknown"))), F.col("k") % 5)
    tracks = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("track"), F.lit(None).cast("string").alias("subject"), "t_us", F.col("value").alias("cx"), F.col("value").alias("cy"), (F.col("k") % 3).cast("double").alias("radius"), F.lit(1.0).alias("conf"), state.alias("occlusion"), F.lit(None).cast("string").alias("lifecycle"))
    got = vision.mask_samples(tracks)
    return got.groupBy("subject").agg(F.count("*").alias("n"), F.count(F.when(F.col("occluded"), 1)).alias("hidden"), F.min("radius").cast("bigint").alias("least"))


@query(f"WITH {EV} SELECT user_id, round(greatest(avg(k % 7 + 1e0) * 2e0 / 3e0, 0.5e0), 6) AS sigma FROM ev GROUP BY user_id")
def blur_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strength of a blur from the mean radius of a subject's regions."""
    m = masks(spark, sf_dir).groupBy(F.col("subject").cast("bigint").alias("user_id")).agg(F.avg("radius").alias("mean"))
    return m.select("user_id", F.round(G.blur_sigma(F.col("mean")), 6).alias("sigma"))


# documents that are compiled and run


def _item(name: str, length: int, **more) -> dict:
    at = lambda s: {"ticks": s, "timescale": 1}
    return {"kind": "clip", "id": name, "media": "src", "source": {"start": at(0), "duration": at(length)}, **more}


@query(f"""WITH {PX}, {_HALF}, g AS (SELECT unnest(range(half + 2 + 2 * half)) AS idx, half FROM hf), p AS (SELECT idx, CASE WHEN idx < half THEN idx WHEN idx >= half + 2 THEN (idx - half - 2) // 2 END AS k FROM g)
SELECT idx, array_to_string(flatten(list_transform(range(64), lambda i: list_transform(range(3), lambda c: coalesce(px[i + 1], 0)))), ',') AS px FROM p LEFT JOIN fr ON k = vec_id""")
def timeline_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A timeline document: half of the pictures at double speed, a gap of a second, and the same at their own speed."""
    clip = _all(spark, sf_dir)
    half = clip.duration_us // 2_000_000
    items = [_item("fast", half, retiming={"mode": "speed", "factor": 2.0}), {"kind": "gap", "duration": {"ticks": 1, "timescale": 1}}, _item("slow", half)]
    doc = {"version": 1, "id": "p", "name": "p", "media": [{"id": "src", "uri": "seed"}], "sequences": [{"id": "main", "name": "main", "tracks": [{"id": "v", "kind": "video", "items": items}]}]}
    graph = compile_project(doc).graph
    made = materialize(Context(spark, {a.id: clip for a in graph.assets}), graph)
    return FR.to_arrays(next(iter(made.values())).pictures()).select("idx", joined("px"))


@query(f"WITH {PX}, {_HALF} SELECT vec_id, array_to_string(list_transform(px, lambda v: 255 - v), ',') AS px FROM fr, hf WHERE vec_id = half")
def preview_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one frame of a preview in the middle; a layer that begins later is left out of its graph."""
    clip = _all(spark, sf_dir)
    half = clip.duration_us // 2_000_000
    doc = _graph(("inv", "color.invert", {}, ["src"]), ("lay", "compose.layers", {"layers": [{"layer_index": 0}, {"layer_index": 1, "start": {"ticks": half + 1, "timescale": 1}}]}, ["inv", "src"]), ("enc", "encode.h264", {}, ["lay"]))
    _, frame = preview.frame(Context(spark, {"src": clip}), Graph.from_json(doc), MediaTime(half, 1), "draft")
    grey = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get("px", i * 3))
    return FR.to_arrays(frame).select((F.col("t_us") / 1_000_000).cast("bigint").alias("vec_id"), joined(grey))


@query(f"WITH {PX} SELECT vec_id, array_to_string(list_transform(px, lambda v: least(255, (255 - v) * 333 // 256)), ',') AS px FROM fr")
def plan_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear plan of named effects, by their other names."""
    doc = {"version": 1, "source": {"type": "file", "path": "seed"}, "ops": [{"op": "custom", "name": "negate"}, {"op": "custom", "name": "multiply", "params": {"factor": 1.3}}, {"op": "even_dims"}]}
    return _bytes(linear.execute(Context(spark), linear.Plan.from_json(doc), _all(spark, sf_dir)).pictures())


@query(f"WITH {PX} SELECT vec_id AS idx, array_to_string(list_transform(range(64), lambda i: 255 - px[(7 - i // 8) * 8 + i % 8 + 1]), ',') AS px FROM fr")
def job_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job that is submitted, run and read back; what its first stage hands on is kept, too."""
    at = folder(spark)
    store = jobs.Store(spark, f"{at}/jobs")
    doc = _graph(("inv", "color.invert", {}, ["src"]), ("dev", "gpu.passthrough", {}, ["inv"]), ("flip", "transform.vflip", {}, ["dev"]))
    ctx = Context(spark, {"src": _all(spark, sf_dir)})
    done = jobs.run(ctx, store, store.submit(Graph.from_json(doc)), f"{at}/out")
    return FR.to_arrays(jobs.outputs(ctx, done)["main"]).select("idx", joined("px"))


@query(f"WITH {PX} SELECT label AS clip_id, vec_id AS idx, array_to_string(list_transform(range(48), lambda i: px[(i // 8) * 8 + i % 8 + 1]), ',') AS px FROM fr")
def frames_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clip for each label, cropped to an odd height, written on its grid with an even one, and read again."""
    at = f"{folder(spark)}/frames"
    clip = FR.apply(_frames(spark, sf_dir), [K.Crop(0, 0, 8, 7)])
    write.frames(clip, at, 1.0)
    return FR.to_arrays(documents.read_frames(spark, at)).select(F.col("clip_id").cast("int").alias("clip_id"), "idx", joined("px"))


@query(f"WITH {PCM} SELECT clip_id, i, ch, round(v, 6) AS v FROM pcm")
def samples_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{folder(spark)}/samples"
    write.samples(samples(spark, sf_dir), at, 2)
    return documents.read_samples(spark, at).select(F.col("clip_id").cast("bigint").alias("clip_id"), "i", "ch", F.round("v", 6).alias("v"))


@query(f"WITH {PCM}, p AS (SELECT clip_id, least(i * 8 // 32, 7) AS b, max(abs(v)) AS peak FROM pcm GROUP BY ALL) SELECT clip_id, 8 AS buckets, round(max(peak), 6) AS highest FROM p GROUP BY clip_id")
def waveform_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waveforms as JSON, read again."""
    docs = write.waveform_json(measures.waveform(samples(spark, sf_dir), F.lit(32), 8))
    peaks = F.from_json("json", "buckets int, peaks array<struct<min: double, max: double>>")
    return docs.withColumn("j", peaks).select("clip_id", "j.buckets", F.round(F.array_max(F.transform("j.peaks", lambda x: x["max"])), 6).alias("highest"))


_COS, _SIN = (f"{f(math.radians(30.0))!r}" for f in (math.cos, math.sin))
_SX, _SY = f"CAST(floor({_COS} * (i % 8 + 0.5e0 - 4e0) + {_SIN} * (i // 8 + 0.5e0 - 4e0) + 4e0) AS INTEGER)", f"CAST(floor(-{_SIN} * (i % 8 + 0.5e0 - 4e0) + {_COS} * (i // 8 + 0.5e0 - 4e0) + 4e0) AS INTEGER)"


@query(f"WITH {PX} SELECT vec_id, array_to_string(list_transform(range(64), lambda i: CASE WHEN {_SX} BETWEEN 0 AND 7 AND {_SY} BETWEEN 0 AND 7 THEN px[{_SY} * 8 + {_SX} + 1] ELSE 0 END), ',') AS px FROM fr")
def rotate_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By 30 degrees: the canvas stays, and what comes from outside is black."""
    made = _run(spark, _graph(("turn", "transform.rotate", {"mode": "degrees", "degrees": 30.0}, ["src"])), src=_all(spark, sf_dir))
    return _bytes(made.pictures())
