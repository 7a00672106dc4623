"""Tracks and masks over time: what is where, at a time.

Samples: ``subject, t_us, cx, cy, radius, conf, lifecycle, occluded`` and any ``group`` columns in
front of subject (a clip's id, say).  Samples that don't contribute are left out first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ParamError
from ..functions.geometry import contributes
from ..scratch import small
from .intervals import asof_join, interval_join

ANONYMOUS = "_anon"
VALUES = ("cx", "cy", "radius", "conf", "lifecycle")
OPAQUE_RADIUS = 1.0e6


def prune(samples: DataFrame) -> DataFrame:
    return samples.where(contributes(F.col("occluded"), F.col("lifecycle"), F.col("conf")))


def assign_anonymous(samples: DataFrame, subject: str = ANONYMOUS) -> DataFrame:
    return samples.withColumn("subject", F.coalesce("subject", F.lit(subject)))


def merge(timelines: Sequence[DataFrame]) -> DataFrame:
    out = timelines[0]
    for t in timelines[1:]:
        out = out.unionByName(t)
    return out


def spans(samples: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Contributing samples with the next one's time and values, ``next_*``, and whether they're first or last."""
    w = Window.partitionBy(*group, "subject").orderBy("t_us", "cx", "cy")
    nxt = {f"next_{c}": F.lead(c).over(w) for c in ("t_us", *VALUES)}
    if "asset" in samples.columns:  # the last one there was, else the first there is
        before = w.rowsBetween(Window.unboundedPreceding, 0)
        nxt["asset"] = F.coalesce(F.last("asset", ignorenulls=True).over(before), F.first("asset", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    return prune(assign_anonymous(samples)).withColumns({**nxt, "nth": F.row_number().over(w)})


def _lerp(name: str, u: Column) -> Column:
    return F.col(name) + (F.col(f"next_{name}") - F.col(name)) * u


def regions_at(samples: DataFrame, grid: DataFrame, t: str = "at_us", group: Sequence[str] = (), interpolation: str = "linear", missing: str = "transparent", width: int = 1_000_000) -> DataFrame:
    """grid with every region at its time: ``subject, cx, cy, radius, conf, lifecycle``, and ``asset`` if the samples have it.

    linear: between samples, both ends held, lifecycle of the nearer; missing doesn't matter then.
    hold: the last sample; before the first none, the first (hold_last) or an all-covering one (opaque).
    A subject without contributing samples has no region.
    """
    if interpolation not in ("linear", "hold") or missing not in ("transparent", "hold_last", "opaque"):
        raise ParamError(f"unknown policy {interpolation}/{missing}")
    far = 1 << 60
    s = spans(samples, group)
    s = s.withColumns({"from_us": F.col("t_us"), "to_us": F.coalesce("next_t_us", F.lit(far))})
    if interpolation == "linear" or missing == "hold_last":
        s = s.withColumn("from_us", F.when(F.col("nth") == 1, F.lit(-far)).otherwise(F.col("from_us")))
    if interpolation == "hold" and missing == "opaque":
        head = s.where("nth = 1").withColumns({"to_us": F.col("t_us"), "from_us": F.lit(-far), "cx": F.lit(0.0), "cy": F.lit(0.0), "radius": F.lit(OPAQUE_RADIUS), "conf": F.lit(1.0), "lifecycle": F.lit("active"), **({"asset": F.lit(None).cast(s.schema["asset"].dataType)} if "asset" in s.columns else {})})
        s = s.unionByName(head)
    # ends without bound would touch endless buckets: bound them by the grid's own times
    edge = grid.agg(F.min(t).alias("lo_"), F.max(t).alias("hi_"))
    s = s.crossJoin(F.broadcast(edge)).withColumns({"from_us": F.greatest("from_us", "lo_"), "to_us": F.least(F.col("to_us"), F.col("hi_") + 1)}).drop("lo_", "hi_")
    hit = interval_join(grid, s, t, "from_us", "to_us", group, width)
    if interpolation == "linear":
        raw = (F.col(t) - F.col("t_us")) / F.greatest(F.col("next_t_us") - F.col("t_us"), F.lit(1))
        u = F.when(F.col("next_t_us").isNull() | (F.col(t) <= F.col("t_us")), 0.0).otherwise(raw)
        moved = {c: F.when(u == 0.0, F.col(c)).otherwise(_lerp(c, u)) for c in VALUES[:4]}
        hit = hit.withColumns({**moved, "lifecycle": F.when(u < 0.5, F.col("lifecycle")).otherwise(F.coalesce("next_lifecycle", "lifecycle"))})
    return hit.select(*grid.columns, "subject", *VALUES, *(["asset"] if "asset" in samples.columns else []))


def coverage_at(points: DataFrame, tracks: DataFrame, keys: Sequence[str], t: str, track_t: str, value: str) -> DataFrame:
    """points with the last non-null value at or before their time, else the first there is of their keys."""
    known = tracks.where(F.col(value).isNotNull())
    first = known.groupBy(*keys).agg(F.min_by(value, F.struct(track_t, value)).alias("first_"))
    got = asof_join(points, known, keys, t, track_t, [value]).join(first, list(keys), "left")
    return got.withColumn(value, F.coalesce(value, "first_")).drop("first_")


def attach_frames(samples: DataFrame, frames: DataFrame, keys: Sequence[str], asset: str = "asset", order: Sequence[str] = ()) -> DataFrame:
    """samples whose null asset is that of the first frame with exactly their keys."""
    w = Window.partitionBy(*keys).orderBy(*(order or [asset]))
    one = frames.withColumn("nth_", F.row_number().over(w)).where("nth_ = 1").select(*keys, F.col(asset).alias("found_"))
    return samples.join(one, list(keys), "left").withColumn(asset, F.coalesce(asset, "found_")).drop("found_")


def resolve(refs: DataFrame, assets: DataFrame) -> DataFrame:
    """refs ``package_id, mask_ref, path`` with ``asset``: by package and name, else by path."""
    by_name = assets.groupBy("package_id", "mask_ref").agg(F.min("asset").alias("named_"))
    by_path = assets.where("path is not null").groupBy("path").agg(F.min("asset").alias("at_path_"))
    got = refs.join(by_name, ["package_id", "mask_ref"], "left").join(by_path, "path", "left")
    return got.withColumn("asset", F.coalesce("named_", "at_path_")).drop("named_", "at_path_")


def prefer(first: DataFrame, second: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows by keys with the first provider's value, or the second's where the first has none."""
    a, b = first.select(*keys, F.col(value).alias("a_")), second.select(*keys, F.col(value).alias("b_"))
    return a.join(b, list(keys), "full").select(*keys, F.coalesce("a_", "b_").alias(value))


def union_roi(regions: DataFrame, keys: Sequence[str], w: int, h: int, pad: int = 1) -> DataFrame:
    """The padded box ``x0, y0, x1, y1`` around all regions of each key; empty boxes are left out."""
    rad = F.ceil("radius") + 1
    cx, cy = (F.greatest(F.round(c), F.lit(0.0)).cast("bigint") for c in ("cx", "cy"))
    zero = F.lit(0).cast("bigint")
    box = {"x0": F.greatest(F.greatest(cx - rad, zero) - pad, zero), "y0": F.greatest(F.greatest(cy - rad, zero) - pad, zero), "x1": cx + rad + pad, "y1": cy + rad + pad}
    got = regions.select(*keys, *[v.alias(k) for k, v in box.items()]).groupBy(*keys)
    out = got.agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.least(F.max("x1"), F.lit(w).cast("bigint")).alias("x1"), F.least(F.max("y1"), F.lit(h).cast("bigint")).alias("y1"))
    return out.where("x0 < x1 and y0 < y1")


def mask_samples(tracks: DataFrame) -> DataFrame:
    """Mask samples of track samples ``track, subject, t_us, cx, cy, radius, conf, occlusion, lifecycle``."""
    from ..functions.geometry import occlusion_contributes

    life = F.coalesce("lifecycle", F.lit("active"))
    hidden = ~occlusion_contributes(F.col("occlusion")) | (life == "occluded")
    return tracks.withColumns({"subject": F.coalesce("subject", "track"), "occluded": hidden, "lifecycle": F.when(hidden, "occluded").otherwise(life), "radius": F.greatest(F.col("radius"), F.lit(1.0))})


def with_regions(frames: DataFrame, samples: DataFrame, min_conf: float = 0.05, width: int = 1_000_000, clips: bool = True) -> DataFrame:
    """frames with ``regions``: those at their time, of samples that carry ``clip_id``; without clips, of samples that hold for all.

    Only the frames' keys and times are joined and grouped.  The lists meet the pictures by broadcast if they're
    small, which is measured; otherwise pictures are shuffled once.
    """
    group = ["clip_id"] if clips else []
    keys = frames.select(*group, F.col("t_us").alias("at_us")).distinct()
    found = regions_at(samples, keys, "at_us", group, width=width).where(F.col("conf") >= min_conf)
    parts = [F.col(c).cast("double").alias(c) for c in VALUES[:4]]
    if "asset" not in samples.columns:
        lists = found.groupBy(*group, "at_us").agg(F.array_sort(F.collect_list(F.struct(*parts))).alias("regions"))
    else:
        one = F.struct(*parts, F.col("subject"), F.col("asset"))
        lists = found.groupBy(*group, "at_us").agg(F.array_sort(F.collect_list(one), lambda x, y: F.when(_place(x) < _place(y), -1).when(_place(x) > _place(y), 1).otherwise(0)).alias("regions"))
    lists = small(lists.withColumnRenamed("at_us", "t_us"), _held(lists.schema["regions"].dataType.elementType.names))
    return frames.join(lists, [*group, "t_us"], "left").select(*frames.columns, "regions")


def _held(names: Sequence[str]) -> Column:
    """About the bytes in memory of a row's ``regions``."""

    def one(region: Column) -> Column:
        if "asset" not in names:
            return F.lit(64)
        many = lambda c: F.coalesce(F.size(region["asset"][c]), F.lit(0)) * 48
        return F.lit(192) + F.coalesce(F.length(region["asset"]["data"]), F.lit(0)) + F.greatest(many("runs"), F.lit(0)) + F.greatest(many("points"), F.lit(0))

    return F.aggregate("regions", F.lit(48).cast("bigint"), lambda n, region: n + one(region))


def _place(region: Column) -> Column:
    return F.struct(*[region[c] for c in VALUES[:4]], region["subject"])
