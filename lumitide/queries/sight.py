"""Pixels, quality, tracks, masks and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..clips import Clip
from ..functions import geometry as G
from ..functions import parsing
from ..functions import pixels as P
from ..kernels import pictures as K
from ..operators import frames as FR
from ..operators import measures, timing, vision
from ..plans import linear
from ..plans.graph import Graph
from ..plans.run import Context, materialize
from ..sources import documents
from . import query
from .views import EV, FRAMES, HOUR, MASKS, PX, RGB, SPAN, USER_HOURS, colours, events, frames, hours, joined, masks, pictures, table, user_hours


def _px(spark: SparkSession, sf_dir: str, f) -> DataFrame:
    return pictures(spark, sf_dir).select("vec_id", joined(f(F.col("px"))))


def _sql(n: int, place: str, source: str = "fr", views: str = PX) -> str:
    """The pixels at a place for each i of n."""
    return f"WITH {views} SELECT vec_id, array_to_string(list_transform(range({n}), lambda i: px[CAST({place} AS INTEGER) + 1]), ',') AS px FROM {source}"


def _each(f: str, source: str = "fr", views: str = PX) -> str:
    return f"WITH {views} SELECT vec_id, array_to_string(list_transform(px, lambda v: CAST({f} AS INTEGER)), ',') AS px FROM {source}"


@query(_sql(20, "(i // 5 + 1) * 8 + i % 5 + 2"))
def crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _px(spark, sf_dir, lambda px: P.crop(px, 8, 8, 2, 1, 5, 4))


@query(_sql(64, "(i // 8) * 8 + 7 - i % 8"))
def hflip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _px(spark, sf_dir, lambda px: P.hflip(px, 8, 8))


@query(_sql(64, "(7 - i // 8) * 8 + i % 8"))
def vflip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _px(spark, sf_dir, lambda px: P.vflip(px, 8, 8))


@query(_sql(64, "(7 - i % 8) * 8 + i // 8"))
def rotate90(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _px(spark, sf_dir, lambda px: P.rotate(px, 8, 8, 90))


@query(_sql(64, "63 - i"))
def rotate180(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _px(spark, sf_dir, lambda px: P.rotate(px, 8, 8, 180))


@query(_sql(64, "(i % 8) * 8 + 7 - i // 8"))
def rotate270(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _px(spark, sf_dir, lambda px: P.rotate(px, 8, 8, 270))


@query(_sql(15, "((i // 5) * 8 // 3) * 8 + (i % 5) * 8 // 5"))
def resize_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _px(spark, sf_dir, lambda px: P.resize_nearest(px, 8, 8, 5, 3))


_AX = "list_transform(range({n}), lambda d: least(greatest((d + 0.5e0) * 8e0 / {n}e0 - 0.5e0, 0e0), 7e0))"


@query(f"""WITH {PX}, a AS (SELECT {_AX.format(n=12)} AS sx, {_AX.format(n=6)} AS sy), b AS (SELECT vec_id, px, i, sx[i % 12 + 1] AS x, sy[i // 12 + 1] AS y FROM fr, a, range(0, 72) AS r(i)),
c AS (SELECT *, CAST(floor(x) AS INTEGER) AS x0, least(CAST(floor(x) AS INTEGER) + 1, 7) AS x1, CAST(floor(y) AS INTEGER) AS y0, least(CAST(floor(y) AS INTEGER) + 1, 7) AS y1, CAST(round((1e0 - (x - floor(x))) * 256e0) AS INTEGER) AS wx, CAST(round((1e0 - (y - floor(y))) * 256e0) AS INTEGER) AS wy FROM b),
d AS (SELECT vec_id, i, ((px[y0 * 8 + x0 + 1] * wx + px[y0 * 8 + x1 + 1] * (256 - wx)) * wy + (px[y1 * 8 + x0 + 1] * wx + px[y1 * 8 + x1 + 1] * (256 - wx)) * (256 - wy)) // 65536 AS v FROM c)
SELECT vec_id, array_to_string(list(v ORDER BY i), ',') AS px FROM d GROUP BY vec_id""")
def resize_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _px(spark, sf_dir, lambda px: P.resize_bilinear(px, 8, 8, 12, 6))


@query(f"WITH {PX} SELECT vec_id, array_to_string(list_transform(range(100), lambda i: CASE WHEN i % 10 BETWEEN 1 AND 8 AND i // 10 BETWEEN 1 AND 8 THEN px[(i // 10 - 1) * 8 + i % 10] ELSE 9 END), ',') AS px FROM fr")
def margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _px(spark, sf_dir, lambda px: P.margin(px, 8, 8, 1, 9))


@query(f"WITH {PX}, o AS (SELECT *, CAST(least(greatest(round(1e0 + 0.37e0 * (vec_id % 17)), 0), 4) AS INTEGER) AS x0, CAST(least(greatest(round(3e0 - 0.25e0 * (vec_id % 17)), 0), 4) AS INTEGER) AS y0 FROM fr) SELECT vec_id, array_to_string(list_transform(range(16), lambda i: px[(i // 4 + y0) * 8 + i % 4 + x0 + 1]), ',') AS px FROM o")
def scroll(spark: SparkSession, sf_dir: str) -> DataFrame:
    secs = (F.col("vec_id") % 17).cast("double")
    return _px(spark, sf_dir, lambda px: P.window(px, 8, 8, P.scroll_origin(1.0, 0.37, secs, 4), P.scroll_origin(3.0, -0.25, secs, 4), 4, 4))


def _slid(ox: str, oy: str, on: str) -> str:
    return f"WITH {PX}, o AS (SELECT *, 1e0 - {on} AS off FROM fr), m AS (SELECT vec_id, px, {ox} AS ox, {oy} AS oy FROM o) SELECT vec_id, array_to_string(list_transform(range(64), lambda i: CASE WHEN i % 8 - ox BETWEEN 0 AND 7 AND i // 8 - oy BETWEEN 0 AND 7 THEN px[(i // 8 - oy) * 8 + i % 8 - ox + 1] ELSE 0 END), ',') AS px FROM m"


@query(_slid("CAST(trunc(-off * 8) AS INTEGER)", "0", "least(greatest((vec_id % 10) / 7e0, 0e0), 1e0)"))
def slide_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    secs = (F.col("vec_id") % 10).cast("double")
    return _px(spark, sf_dir, lambda px: P.shift(px, 8, 8, *P.slide_offset(secs, F.lit(10.0), 7.0, "left", True, 8, 8)))


@query(_slid("0", "CAST(trunc(off * 8) AS INTEGER)", "(CASE WHEN vec_id % 10 < 3 THEN 1e0 ELSE 1e0 - least(greatest((vec_id % 10 - 3) / 7e0, 0e0), 1e0) END)"))
def slide_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    secs = (F.col("vec_id") % 10).cast("double")
    return _px(spark, sf_dir, lambda px: P.shift(px, 8, 8, *P.slide_offset(secs, F.lit(10.0), 7.0, "bottom", False, 8, 8)))


@query(_each("255 - v"))
def invert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _px(spark, sf_dir, P.invert)


@query(_each("least(255, v * 333 // 256)"))
def multiply_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _px(spark, sf_dir, lambda px: P.multiply(px, 1.3))


@query(_each("floor(pow(v / 255e0, 2.2e0) * 255e0 + 0.5e0)"))
def gamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _px(spark, sf_dir, lambda px: P.gamma(px, 2.2))


@query(_each("least(255, greatest(0, round((v - 128e0) * 1.5e0 + 128e0 + 10e0)))"))
def lum_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _px(spark, sf_dir, lambda px: P.lum_contrast(px, 10.0, 1.5))


@query(f"WITH {RGB} SELECT vec_id, array_to_string(flatten(list_transform(range(64), lambda i: list_transform(range(3), lambda c: (77 * px[i * 3 + 1] + 150 * px[i * 3 + 2] + 29 * px[i * 3 + 3]) // 256))), ',') AS px FROM rgb")
def black_and_white(spark: SparkSession, sf_dir: str) -> DataFrame:
    return colours(spark, sf_dir).select("vec_id", joined(P.black_and_white(F.col("px"), 8, 8)))


def _faded(amount: str) -> str:
    return f"WITH {PX}, o AS (SELECT *, CAST(round(least(greatest({amount}, 0e0), 1e0) * 256) AS INTEGER) AS a FROM fr) SELECT vec_id, array_to_string(list_transform(px, lambda v: (v * (256 - a) + a * 40) // 256), ',') AS px FROM o"


@query(_faded("CASE WHEN vec_id % 50 >= 30 THEN 0e0 ELSE 1e0 - (vec_id % 50) / 30e0 END"))
def fade_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    secs = (F.col("vec_id") % 50).cast("double")
    return _px(spark, sf_dir, lambda px: P.fade(px, P.fade_in_amount(secs, 30.0), 40))


@query(_faded("CASE WHEN vec_id % 50 <= 20 THEN 0e0 ELSE (vec_id % 50 - 20) / 30e0 END"))
def fade_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    secs = (F.col("vec_id") % 50).cast("double")
    return _px(spark, sf_dir, lambda px: P.fade(px, P.fade_out_amount(secs, F.lit(50.0), 30.0), 40))


@query("SELECT vec_id, round(0.8e0 * (1e0 - CASE WHEN vec_id % 50 >= 30 THEN 0e0 ELSE 1e0 - (vec_id % 50) / 30e0 END), 6) AS opacity FROM embeddings")
def crossfade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cross fade scales opacity, not pixels."""
    secs = (F.col("vec_id") % 50).cast("double")
    opacity = F.lit(0.8) * (F.lit(1.0) - P.fade_in_amount(secs, 30.0))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(opacity, 6).alias("opacity"))


_KEY = "list_transform(range(64), lambda i: CASE WHEN abs(px[i * 3 + 1] - 130) <= {t} AND abs(px[i * 3 + 2] - 125) <= {t} AND abs(px[i * 3 + 3] - 130) <= {u} THEN 0 ELSE 1 END)"


@query(f"WITH {RGB} SELECT vec_id, array_to_string({_KEY.format(t=60, u=60)}, ',') AS px FROM rgb")
def mask_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    return colours(spark, sf_dir).select("vec_id", joined(P.mask_color(F.col("px"), (130, 125, 130), 60, 8, 8)))


def _two(f: str) -> str:
    a, b = "list_transform(px, lambda v: CASE WHEN v > 120 THEN 1 ELSE 0 END)", "list_transform(px, lambda v: CASE WHEN v % 3 = 0 THEN 1 ELSE 0 END)"
    return f"WITH {PX}, m AS (SELECT vec_id, {a} AS a, CASE WHEN vec_id % 7 > 0 THEN {b} END AS b FROM fr) SELECT vec_id, array_to_string(CASE WHEN b IS NULL THEN {'a' if f == 'least' else 'list_transform(a, lambda v: 1)'} ELSE list_transform(range(64), lambda i: {f}(a[i + 1], b[i + 1])) END, ',') AS px FROM m"


def _both(px):
    return F.transform(px, lambda v: F.when(v > 120, 1).otherwise(0)), F.when(F.col("vec_id") % 7 > 0, F.transform(px, lambda v: F.when(v % 3 == 0, 1).otherwise(0)))


@query(_two("least"))
def masks_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _px(spark, sf_dir, lambda px: P.masks_and(*_both(px)))


@query(_two("greatest"))
def masks_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _px(spark, sf_dir, lambda px: P.masks_or(*_both(px)))


_RGBA = PX + ", rgba AS (SELECT vec_id, flatten(list_transform(px, lambda v: [v, 255 - v, v // 2, (v * 2) % 256])) AS px FROM fr)"


def _rgba(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = F.flatten(F.transform("px", lambda v: F.array(v, F.lit(255) - v, F.floor(v / 2).cast("int"), (v * 2) % 256)))
    return pictures(spark, sf_dir).select("vec_id", px.alias("px"))


@query(f"WITH {_RGBA} SELECT vec_id, array_to_string(list_transform(range(256), lambda i: CASE WHEN i % 4 = 3 THEN px[i + 1] ELSE (px[i + 1] * px[i - i % 4 + 4] + 127) // 255 END), ',') AS px FROM rgba")
def premultiply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rgba(spark, sf_dir).select("vec_id", joined(P.premultiply(F.col("px"), 8, 8)))


@query(f"WITH {_RGBA} SELECT vec_id, array_to_string(list_transform(range(256), lambda i: CASE WHEN i % 4 = 3 THEN px[i + 1] WHEN px[i - i % 4 + 4] = 0 THEN 0 ELSE least(255, CAST(round(px[i + 1] * 255e0 / px[i - i % 4 + 4]) AS INTEGER)) END), ',') AS px FROM rgba")
def unpremultiply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rgba(spark, sf_dir).select("vec_id", joined(P.unpremultiply(F.col("px"), 8, 8)))


@query(f"""WITH {PX}, p AS (SELECT vec_id, i, (i // 8) // 3 AS bx, (i % 8) // 3 AS b2, px[i + 1] AS v FROM fr, range(0, 64) AS r(i)), m AS (SELECT vec_id, i, CAST(round(avg(v) OVER (PARTITION BY vec_id, bx, b2)) AS INTEGER) AS v FROM p)
SELECT vec_id, array_to_string(list(v ORDER BY i), ',') AS px FROM m GROUP BY vec_id""")
def pixelate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _px(spark, sf_dir, lambda px: P.pixelate(px, 8, 8, 3))


@query(f"WITH {PX} SELECT vec_id, array_to_string(list_transform(range(64), lambda i: CAST(round((255 - px[i + 1]) * 0.3e0 + px[i + 1] * (1e0 - 0.3e0)) AS INTEGER)), ',') AS px FROM fr")
def blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _px(spark, sf_dir, lambda px: P.blend(px, P.invert(px), F.lit(0.3)))


@query(f"WITH {PX} SELECT vec_id, CAST(list_sum(list_transform(range(64), lambda i: px[i + 1] % 5)) AS BIGINT) AS total, array_to_string(flatten(list_transform(range(64), lambda i: list_transform(range(px[i + 1] % 5), lambda j: px[i + 1]))), ',') AS px FROM fr")
def rle_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = F.transform("px", lambda v: F.struct((v % 5).alias("count"), v.alias("value")))
    return pictures(spark, sf_dir).select("vec_id", P.rle_total(runs).alias("total"), joined(P.rle_decode(runs)))


_B = "CASE WHEN vec_id % 10 = 0 THEN px ELSE list_transform(px, lambda v: least(255, v * 333 // 256)) END"


def _pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pictures(spark, sf_dir).withColumn("b", F.when(F.col("vec_id") % 10 == 0, F.col("px")).otherwise(P.multiply(F.col("px"), 1.3)))


@query(f"WITH {PX}, p AS (SELECT vec_id, px, {_B} AS b FROM fr), m AS (SELECT vec_id, list_sum(list_transform(range(64), lambda i: (px[i + 1] - b[i + 1]) * (px[i + 1] - b[i + 1]))) / 64e0 AS mse FROM p) SELECT vec_id, CASE WHEN mse = 0 THEN 'inf'::DOUBLE ELSE round(10e0 * log10(65025e0 / CASE WHEN mse > 0 THEN mse END), 6) END AS psnr FROM m")
def psnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = measures.psnr(F.col("px"), F.col("b"))
    return _pair(spark, sf_dir).select("vec_id", F.when(v == float("inf"), v).otherwise(F.round(F.when(v < float("inf"), v), 6)).alias("psnr"))


@query(f"""WITH {PX}, p AS (SELECT vec_id, px, {_B} AS b FROM fr), q AS (SELECT vec_id, CAST(unnest(px) AS DOUBLE) AS x, CAST(unnest(b) AS DOUBLE) AS y FROM p),
s AS (SELECT vec_id, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS c FROM q GROUP BY vec_id) SELECT vec_id, round((2 * mx * my + 6.5025e0) * (2 * c + 58.5225e0) / ((mx * mx + my * my + 6.5025e0) * (vx + vy + 58.5225e0)), 6) AS ssim FROM s""")
def ssim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pair(spark, sf_dir).select("vec_id", F.round(measures.ssim(F.col("px"), F.col("b")), 6).alias("ssim"))


# pictures as bytes


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clip for each label, a frame of a second for each vector, in order of vec_id; clips last as long as the table."""
    p, end = pictures(spark, sf_dir), _extent(spark, sf_dir)
    rows = p.select(F.col("label").cast("string").alias("clip_id"), "vec_id", (F.col("vec_id") * 1_000_000).alias("t_us"), ((F.col("vec_id") + 1) * 1_000_000).alias("e_us"), F.lit(end).cast("bigint").alias("dur_us"), "px")
    return FR.from_arrays(rows, "px", 8, 8)


def _bytes(df: DataFrame) -> DataFrame:
    return FR.to_arrays(df).select("vec_id", joined("px"))


@query(_sql(9, "(1 + (i // 3) * 6 // 3) * 8 + 1 + (i % 3) * 6 // 3").replace("px[", "255 - px["))
def kernel_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crop, nearest resize and inversion of whole pictures in one pass."""
    return _bytes(FR.apply(_frames(spark, sf_dir), [K.Crop(1, 1, 6, 6), K.Resize(3, 3, "nearest"), K.Invert()]))


@query(f"WITH {PX}, p AS (SELECT label, px AS patch FROM fr WHERE vec_id = 3) SELECT vec_id, array_to_string(list_transform(range(64), lambda i: CASE WHEN patch IS NOT NULL AND i % 8 BETWEEN 2 AND 4 AND i // 8 BETWEEN 1 AND 3 THEN patch[i + 1] ELSE px[i + 1] END), ',') AS px FROM fr LEFT JOIN p ON fr.label = p.label")
def freeze_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bytes(FR.freeze_region(_frames(spark, sf_dir), 3_000_000, 2, 1, 3, 3))


_G = lambda dy, dx: f"g[i + {8 * dy + dx + 1}]"
_GX = f"({_G(-1, 1)} - {_G(-1, -1)} + 2 * ({_G(0, 1)} - {_G(0, -1)}) + {_G(1, 1)} - {_G(1, -1)})"
_GY = f"({_G(1, -1)} - {_G(-1, -1)} + 2 * ({_G(1, 0)} - {_G(-1, 0)}) + {_G(1, 1)} - {_G(-1, 1)})"
_F = lambda x: f"CAST({x} AS FLOAT)"


@query(f"""WITH {RGB}, s AS (SELECT vec_id, list_transform(range(192), lambda i: greatest(0, least(255, 11 * px[i + 1] - list_sum(list_transform(range(9), lambda k: px[(least(greatest(i // 24 + k // 3 - 1, 0), 7) * 8 + least(greatest((i // 3) % 8 + k % 3 - 1, 0), 7)) * 3 + i % 3 + 1]))))) AS s FROM rgb),
g AS (SELECT vec_id, s, list_transform(range(64), lambda i: (77 * s[i * 3 + 1] + 150 * s[i * 3 + 2] + 29 * s[i * 3 + 3]) // 256) AS g FROM s),
e AS (SELECT vec_id, s, list_transform(range(64), lambda i: CASE WHEN i % 8 BETWEEN 1 AND 6 AND i // 8 BETWEEN 1 AND 6 THEN {_F(f'sqrt({_GX} * {_GX} + {_GY} * {_GY})')} ELSE {_F(0)} END) AS e FROM g)
SELECT vec_id, array_to_string(list_transform(range(192), lambda i: CAST(greatest(0, least(255, floor({_F(1.4)} * {_F('s[i + 1]')} - ({_F(0.006)} * {_F(255)}) * (e[i // 3 + 1] / greatest(list_max(e), {_F(1e-6)})) + {_F(0.5)}))) AS INTEGER)), ',') AS px FROM e""")
def painting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb = colours(spark, sf_dir).select(F.col("label").cast("string").alias("clip_id"), "vec_id", F.lit(0).cast("bigint").alias("t_us"), F.lit(1).cast("bigint").alias("e_us"), F.lit(1).cast("bigint").alias("dur_us"), "px")
    return _bytes(FR.apply(FR.from_arrays(rgb, "px", 8, 8, 3), [K.Painting()]))


def _extent(spark: SparkSession, sf_dir: str) -> int:
    """Microseconds up to the end of the last frame."""
    last = table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0]
    return 1_000_000 if last is None else (last + 1) * 1_000_000


@query(f"WITH {PX} SELECT CAST(vec_id * 2 + j AS BIGINT) AS idx, array_to_string(list_transform(range(64), lambda i: 255 - px[(i // 8) * 8 + 7 - i % 8 + 1]), ',') AS px FROM fr, range(0, 2) AS r(j)")
def graph_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph document without a trim, run over all pictures as one clip, sampled at two frames a second."""
    end = _extent(spark, sf_dir)
    whole = _frames(spark, sf_dir).withColumns({"clip_id": F.lit("all"), "dur_us": F.lit(end).cast("bigint")})
    op = lambda name, operation, source: {"id": name, "body": {"kind": "op", "operation": operation, "params": {}}, "inputs": [source]}
    doc = {
        "version": 1, "assets": [{"id": "a", "uri": "seed"}], "outputs": [{"name": "main", "node": "out"}],
        "nodes": [{"id": "src", "body": {"kind": "source", "asset": "a"}, "inputs": []}, op("flip", "transform.hflip", "src"), op("inv", "color.invert", "flip"), {"id": "out", "body": {"kind": "output", "name": "main"}, "inputs": ["inv"]}],
    }
    clip = materialize(Context(spark, {"a": Clip(whole, end, 8, 8, 1.0)}), Graph.from_json(doc))["main"]
    return FR.to_arrays(clip.sampled(2.0)).select("idx", joined("px"))


@query(f"WITH {PX} SELECT vec_id, array_to_string(list_transform(range(16), lambda i: px[(5 - i % 4) * 8 + i // 4 + 3]), ',') AS px FROM fr")
def plan_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear plan without a trim, over all pictures: two crops that merge, two flips that cancel, a quarter turn."""
    doc = {"version": 1, "source": {"type": "file", "path": "seed"}, "ops": [{"op": "identity"}, {"op": "crop", "x": 1, "y": 1, "w": 6, "h": 6}, {"op": "crop", "x": 1, "y": 1, "w": 4, "h": 4}, {"op": "h_flip"}, {"op": "h_flip"}, {"op": "transpose_cw"}]}
    end = _extent(spark, sf_dir)
    clip = Clip(_frames(spark, sf_dir).withColumn("dur_us", F.lit(end).cast("bigint")), end, 8, 8, 1.0)
    return _bytes(linear.execute(Context(spark), linear.Plan.from_json(doc), clip).pictures())


# tracks and masks


_HR = f"hr AS (SELECT h * {HOUR} AS at_us FROM range(0, 720) AS r(h))"
_LIVE = "lv AS (SELECT *, lead(t_us) OVER w AS tb, lead(cx) OVER w AS bx, lead(cy) OVER w AS b_y, lead(radius) OVER w AS br, lead(lifecycle) OVER w AS bl, row_number() OVER w AS nth FROM ms WHERE NOT occluded WINDOW w AS (PARTITION BY subject ORDER BY t_us, cx, cy))"
_LIN = f"""{MASKS}, {_LIVE}, {_HR}, rg AS (SELECT at_us, subject, CASE WHEN tb IS NULL OR at_us <= t_us THEN 0e0 ELSE (at_us - t_us) / CAST(greatest(tb - t_us, 1) AS DOUBLE) END AS u, * EXCLUDE (at_us, subject) FROM hr JOIN lv ON (at_us >= t_us OR nth = 1) AND (tb IS NULL OR at_us < tb)),
re AS (SELECT at_us, subject, CASE WHEN u = 0 THEN cx ELSE cx + (bx - cx) * u END AS cx, CASE WHEN u = 0 THEN cy ELSE cy + (b_y - cy) * u END AS cy, CASE WHEN u = 0 THEN radius ELSE radius + (br - radius) * u END AS radius, CASE WHEN u < 0.5 THEN lifecycle ELSE coalesce(bl, lifecycle) END AS lifecycle FROM rg)"""


@query(f"WITH {_LIN} SELECT at_us, subject, round(cx, 6) AS cx, round(cy, 6) AS cy, round(radius, 6) AS radius, lifecycle FROM re")
def mask_regions_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = vision.regions_at(masks(spark, sf_dir), hours(spark, sf_dir), width=8 * HOUR)
    return got.select("at_us", "subject", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "radius")], "lifecycle")


@query(f"WITH {MASKS}, {_LIVE}, {_HR} SELECT at_us, subject, cx, cy, radius FROM hr JOIN lv ON (at_us >= t_us OR nth = 1) AND (tb IS NULL OR at_us < tb)")
def mask_regions_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = vision.regions_at(masks(spark, sf_dir), hours(spark, sf_dir), interpolation="hold", missing="hold_last", width=8 * HOUR)
    return got.select("at_us", "subject", "cx", "cy", "radius")


@query(f"WITH {MASKS}, {_LIVE}, {_HR} SELECT at_us, subject, cx, radius FROM hr JOIN lv ON at_us >= t_us AND (tb IS NULL OR at_us < tb) UNION ALL SELECT at_us, subject, 0, 1000000 FROM hr JOIN lv ON nth = 1 AND at_us < t_us")
def mask_regions_opaque(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = vision.regions_at(masks(spark, sf_dir), hours(spark, sf_dir), interpolation="hold", missing="opaque", width=8 * HOUR)
    return got.select("at_us", "subject", "cx", "radius")


@query(f"WITH {_LIN}, bx AS (SELECT at_us, greatest(greatest(CAST(greatest(round(cx), 0) AS BIGINT) - (CAST(ceil(radius) AS BIGINT) + 1), 0) - 1, 0) AS x0, greatest(greatest(CAST(greatest(round(cy), 0) AS BIGINT) - (CAST(ceil(radius) AS BIGINT) + 1), 0) - 1, 0) AS y0, CAST(greatest(round(cx), 0) AS BIGINT) + CAST(ceil(radius) AS BIGINT) + 2 AS x1, CAST(greatest(round(cy), 0) AS BIGINT) + CAST(ceil(radius) AS BIGINT) + 2 AS y1 FROM re), g AS (SELECT at_us, min(x0) AS x0, min(y0) AS y0, least(max(x1), 64) AS x1, least(max(y1), 64) AS y1 FROM bx GROUP BY at_us) SELECT * FROM g WHERE x0 < x1 AND y0 < y1")
def union_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vision.union_roi(vision.regions_at(masks(spark, sf_dir), hours(spark, sf_dir), width=8 * HOUR), ["at_us"], 64, 64)


@query(f"WITH {MASKS} SELECT lifecycle, count(*) AS n, count(DISTINCT subject) AS subjects FROM ms WHERE NOT occluded GROUP BY lifecycle")
def prune_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vision.prune(masks(spark, sf_dir)).groupBy("lifecycle").agg(F.count("*").alias("n"), F.countDistinct("subject").alias("subjects"))


@query(f"WITH {MASKS}, m AS (SELECT subject, t_us FROM ms UNION ALL SELECT CASE WHEN t_us % 2 = 0 THEN subject ELSE '_anon' END, t_us FROM ms) SELECT subject, count(*) AS n, min(t_us) AS first_us FROM m GROUP BY subject")
def merge_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = masks(spark, sf_dir)
    other = m.withColumn("subject", F.when(F.col("t_us") % 2 == 0, F.col("subject")))
    return vision.assign_anonymous(vision.merge([m, other])).groupBy("subject").agg(F.count("*").alias("n"), F.min("t_us").alias("first_us"))


@query(f"""WITH {EV}, {USER_HOURS}, c AS (SELECT user_id, t_us, max(value) AS value FROM ev WHERE event_type <> 'error' GROUP BY ALL), f AS (SELECT user_id, arg_min(value, t_us) AS head FROM c GROUP BY user_id)
SELECT uh.clip_id, at_us, coalesce(c.value, head) AS coverage FROM uh ASOF LEFT JOIN c ON uh.clip_id = c.user_id AND at_us >= c.t_us LEFT JOIN f ON uh.clip_id = f.user_id""")
def coverage_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select(F.col("user_id").alias("clip_id"), "t_us", F.when(F.col("event_type") != "error", F.col("value")).alias("coverage"))
    return vision.coverage_at(user_hours(spark, sf_dir), e, ["clip_id"], "at_us", "t_us", "coverage").select("clip_id", "at_us", "coverage")


@query(f"WITH {EV} SELECT event_id, CASE WHEN k < 20 THEN 'own' ELSE 'found-' || event_id END AS asset FROM ev")
def attach_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    found = e.select("user_id", "t_us", "event_id", F.concat(F.lit("found-"), F.col("event_id").cast("string")).alias("asset"))
    samples = e.withColumn("asset", F.when(F.col("k") < 20, F.lit("own")))
    # two assets for some of the frames: the first counts
    twice = found.unionByName(found.where("event_id % 2 = 0").withColumn("asset", F.concat("asset", F.lit("-more"))))
    return vision.attach_frames(samples, twice.drop("event_id"), ["user_id", "t_us"]).select("event_id", "asset")


@query("WITH s AS (SELECT s_suppkey, s_nationkey, s_suppkey % 30 AS m FROM supplier) SELECT s_suppkey, coalesce('by-name-' || a.n_nationkey, 'by-path-' || b.n_nationkey) AS asset FROM s LEFT JOIN nation a ON a.n_nationkey = s_nationkey AND a.n_regionkey = m % 5 LEFT JOIN nation b ON b.n_nationkey = m")
def resolve_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("s_suppkey") % 30
    refs = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("package_id"), (m % 5).cast("string").alias("mask_ref"), m.cast("string").alias("path"))
    nation = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey").cast("string")
    named = nation.select(key.alias("package_id"), F.col("n_regionkey").cast("string").alias("mask_ref"), F.lit(None).cast("string").alias("path"), F.concat(F.lit("by-name-"), key).alias("asset"))
    placed = nation.select(F.lit(None).cast("string").alias("package_id"), F.lit(None).cast("string").alias("mask_ref"), key.alias("path"), F.concat(F.lit("by-path-"), key).alias("asset"))
    return vision.resolve(refs, named.unionByName(placed)).select("s_suppkey", "asset")


@query(f"WITH {EV} SELECT CAST(user_id AS VARCHAR) AS track, CAST(round(t_us / 1000e0) AS BIGINT) * 1000 AS t_us, round(CASE event_id % 3 WHEN 0 THEN value WHEN 1 THEN value + 5 ELSE value + 10 END, 6) AS cx, round(CASE event_id % 3 WHEN 0 THEN greatest(k, 1) ELSE greatest(sqrt(CASE event_id % 3 WHEN 1 THEN 200e0 ELSE 1300e0 END) * 0.5, 1) END, 6) AS radius, CASE WHEN event_type = 'error' THEN 'occluded' ELSE 'visible' END AS occlusion FROM ev")
def parse_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track documents, one for each user, with all three notations of a place."""
    e = events(spark, sf_dir)
    kind = F.col("event_id") % 3
    k, v = F.col("k").cast("double"), F.col("value")
    num = lambda c, x: F.when(c, x)
    sample = F.struct(
        (F.col("t_us") / 1e6).alias("t"), num(kind == 0, v).alias("cx"), num(kind == 0, k).alias("cy"), num(kind == 0, k).alias("radius"), num(kind == 1, v).alias("x"), num(kind == 1, k).alias("y"), num(kind == 1, F.lit(10.0)).alias("w"), num(kind == 1, F.lit(10.0)).alias("h"),
        num(kind == 2, v).alias("left"), num(kind == 2, k).alias("top"), num(kind == 2, v + 20.0).alias("right"), num(kind == 2, k + 30.0).alias("bottom"), F.when(F.col("event_type") == "error", "Occluded").alias("occlusion"),
    )
    docs = e.groupBy("user_id").agg(F.collect_list(sample).alias("samples"))
    track = F.array(F.struct(F.col("user_id").cast("string").alias("id"), "samples"))
    text = F.when(F.col("user_id") % 2 == 0, F.to_json(track)).otherwise(F.to_json(F.struct(track.alias("tracks"))))
    got = documents.tracks(docs.select(F.col("user_id").cast("string").alias("doc"), text.alias("text")))
    return got.select("track", "t_us", F.round("cx", 6).alias("cx"), F.round("radius", 6).alias("radius"), "occlusion")


@query("SELECT p_partkey, p_size * 16 AS w, round(30000e0 / (1000 + p_partkey % 3), 6) AS fps, p_size / 2e0 AS secs, p_partkey % 3 = 2 AND p_size * 30 >= 0 AS varies FROM part".replace("p_partkey % 3 = 2 AND p_size * 30 >= 0", "(p_partkey % 4 = 0)"))
def probe_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe documents of parts as media files; every fourth has two frame rates."""
    p, s = F.col("p_partkey"), F.col("p_size")
    avg = F.concat(F.lit("30000/"), (p % 3 + 1000).cast("string"))
    real = F.when(p % 4 == 0, "50/1").otherwise(avg)
    stream = F.struct(F.lit("video").alias("codec_type"), (s * 16).alias("width"), (s * 9).alias("height"), avg.alias("avg_frame_rate"), real.alias("r_frame_rate"), F.lit("1/1000").alias("time_base"), (s * 500).alias("duration_ts"))
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("doc"), F.to_json(F.struct(F.array(stream).alias("streams"))).alias("text"))
    got = documents.probes(docs)
    return got.select(F.col("doc").cast("bigint").alias("p_partkey"), F.col("w").cast("int").alias("w"), F.round("fps", 6).alias("fps"), "secs", "varies")


@query("SELECT p_partkey, greatest(CAST(greatest(round(greatest(p_size * 40, 1) * least(320e0 / (p_size * 40), 180e0 / (p_size * 30), 1e0)), 2) AS INTEGER) // 2 * 2, 2) AS w, greatest(CAST(greatest(round(p_size * 30 * least(320e0 / (p_size * 40), 180e0 / (p_size * 30), 1e0)), 2) AS INTEGER) // 2 * 2, 2) AS h FROM part")
def proxy_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = G.proxy_size(F.col("p_size") * 40, F.col("p_size") * 30, 320, 180)
    return table(spark, sf_dir, "part").select("p_partkey", size["w"].alias("w"), size["h"].alias("h"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN trunc((101 - p_size) / 2e0)::INTEGER ELSE 101 - p_size END + 3 AS x, CASE WHEN p_partkey % 9 < 3 THEN 0 WHEN p_partkey % 9 < 6 THEN trunc((20 - p_size) / 2e0)::INTEGER ELSE 20 - p_size END - 1 AS y FROM part")
def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.get(F.array(*map(F.lit, G.ANCHORS)), (F.col("p_partkey") % 9).cast("int"))
    x, y = G.anchor(name, 101, 20, F.col("p_size"), F.col("p_size"), 3, -1)
    return table(spark, sf_dir, "part").select("p_partkey", x.alias("x"), y.alias("y"))


@query(f"WITH {EV}, d AS (SELECT event_id, value AS r, k / 2e0 AS x, greatest(value - greatest(value * 0.35e0, 0.5e0), 0e0) AS i FROM ev) SELECT event_id, round(CASE WHEN x <= i THEN 1e0 WHEN x >= r THEN 0e0 ELSE 1e0 - ((x - i) / greatest(r - i, 1e-6)) * ((x - i) / greatest(r - i, 1e-6)) * (3e0 - (x - i) / greatest(r - i, 1e-6) * 2e0) END, 6) AS weight FROM d")
def soft_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", F.round(G.soft_mask(F.col("k") / 2, F.col("value")), 6).alias("weight"))


@query("SELECT c_custkey, sha256(c_name) AS digest FROM customer")
def package_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    sealed = F.concat(F.lit("SHA256:"), F.upper(F.sha2("c_name", 256)))
    return table(spark, sf_dir, "customer").select("c_custkey", parsing.normalised_hash(sealed).alias("digest"))


@query(f"WITH {FRAMES}, h AS (SELECT clip_id, count(*) AS n, sum(k) AS s FROM fr GROUP BY clip_id) SELECT clip_id, round(CAST(n AS DOUBLE) / (n + s), 6) AS hit_rate FROM h")
def cache_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = frames(spark, sf_dir).groupBy("clip_id").agg(F.count("*").alias("n"), F.sum("k").alias("s"))
    return g.select("clip_id", F.round(measures.hit_rate(F.col("n"), F.col("s")), 6).alias("hit_rate"))


@query(f"WITH {FRAMES} SELECT clip_id, event_id, floor(t_us / {SPAN}e0 * 240) AS key FROM fr".replace(f"floor(t_us / {SPAN}e0 * 240)", "CAST(round(t_us / 1000000e0 * 2.5e0) AS BIGINT)"))
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("clip_id", "event_id", F.round(F.col("t_us") / 1e6 * 2.5).cast("bigint").alias("key"))


@query(f"WITH {FRAMES} SELECT clip_id, event_id FROM fr WHERE t_us <= {100 * HOUR} AND e_us > {100 * HOUR}")
def frame_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.contains(frames(spark, sf_dir), 100 * HOUR / 1e6).select("clip_id", "event_id")
