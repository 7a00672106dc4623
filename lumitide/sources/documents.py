"""Track, mask-package, probe and subtitle documents as relations.

Documents are read whole, as one text each, and taken apart by built-in functions, so a folder of
millions of them is one scan.  ``doc`` is the document's path.
"""

from __future__ import annotations

import posixpath
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import MediaError
from ..functions import parsing, subtitles
from ..functions.geometry import from_box, from_xywh

_NUM = "double"
SAMPLE = ", ".join([*(f"{c}: {_NUM}" for c in "t cx cy radius x y w h left top right bottom conf".split()), "occlusion: string, appearance: string, observation: string, lifecycle: string, mask: struct<observation: string, uri: string>"])
TRACKS = f"array<struct<id: string, subject: string, kind: string, samples: array<struct<{SAMPLE}>>>>"


def texts(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``doc, text`` of whole files."""
    return spark.read.text(path if isinstance(path, str) else list(path), wholetext=True).select(F.col("_metadata.file_path").alias("doc"), F.col("value").alias("text"))


def tracks(documents: DataFrame, strict: bool = True) -> DataFrame:
    """Samples of track documents: an object with ``tracks``, or a bare array of tracks.

    A sample's place is its centre and radius, or its x/y/w/h, or its four sides, whichever comes
    first in that order; conf is 1 by default and clamped.  An occlusion that isn't known raises, or
    with strict=False counts as unknown.
    """
    bare = F.startswith(F.ltrim("text"), F.lit("["))
    whole = F.when(bare, F.from_json("text", TRACKS)).otherwise(F.from_json("text", f"tracks {TRACKS}")["tracks"])
    rows = documents.select("doc", F.explode(whole).alias("k")).select("doc", "k.id", "k.subject", F.posexplode("k.samples").alias("nth", "s"))
    s = F.col("s")
    # of the decimal that was written: half a millisecond isn't a binary fraction of a second
    t_ms = (F.round(s["t"].cast("decimal(38,20)"), 3) * 1000).cast("bigint")
    box = from_box(s["left"], s["top"], s["right"], s["bottom"])
    xywh = from_xywh(s["x"], s["y"], s["w"], s["h"])
    at = F.when(s["cx"].isNotNull() & s["cy"].isNotNull(), F.struct(s["cx"].alias("cx"), s["cy"].alias("cy"), F.greatest(F.coalesce(s["radius"], F.lit(1.0)), F.lit(1.0)).alias("radius"))).when(s["w"].isNotNull() & s["h"].isNotNull(), xywh).otherwise(box)
    known = parsing.occlusion(s["occlusion"])
    bad = F.raise_error(F.concat(F.lit("unknown occlusion "), s["occlusion"])).cast("string") if strict else F.lit("unknown")
    state = F.when(s["occlusion"].isNull(), "visible").when(known.isNotNull(), known).otherwise(bad)
    out = rows.select(
        "doc", F.col("id").alias("track"), F.coalesce("subject", "id").alias("subject"), t_ms.alias("t_ms"), at.alias("at"),
        F.least(F.greatest(F.coalesce(s["conf"], F.lit(1.0)), F.lit(0.0)), F.lit(1.0)).alias("conf"), state.alias("occlusion"), F.coalesce(s["lifecycle"], F.lit("active")).alias("lifecycle"),
        s["appearance"].alias("appearance"), s["observation"].alias("observation"), s["mask"].alias("mask"),
    )
    return out.where("at.cx is not null").select("doc", "track", "subject", (F.col("t_ms") * 1000).alias("t_us"), "at.cx", "at.cy", "at.radius", "conf", "occlusion", "lifecycle", "appearance", "observation", "mask")


MANIFEST = "package_id string, version bigint, tracks string, package_hash string, masks array<struct<mask_ref: string, kind: string, width: bigint, height: bigint, x: bigint, y: bigint, path: string, sha256: string>>"


def confined(path: Column) -> Column:
    """Whether a relative path stays inside its folder."""
    return ~F.startswith(path, F.lit("/")) & ~F.regexp_like(path, F.lit(r"(^|/)\.\.(/|$)")) & ~F.contains(path, F.lit("\\")) & ~F.contains(path, F.lit(":")) & (F.length(path) > 0)


def mask_packages(spark: SparkSession, folders: str | Sequence[str], verify: bool = True) -> DataFrame:
    """``package_id, mask_ref, kind, w, h, x, y, path, data`` of mask packages: a manifest and blobs.

    A blob must lie in its folder, have w * h bytes and, if the manifest gives one, its SHA-256;
    references are unique in a package.  Otherwise the read raises.
    """
    folders = [folders] if isinstance(folders, str) else list(folders)
    manifests = texts(spark, [f"{f}/manifest.json" for f in folders]).select(F.regexp_replace("doc", "/manifest\\.json$", "").alias("folder"), F.from_json("text", MANIFEST).alias("m"))
    items = manifests.select("folder", "m.package_id", F.col("m.version").alias("version"), F.explode("m.masks").alias("k")).select("folder", "package_id", "version", "k.*")
    blobs = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders).select(F.col("path").alias("file"), F.col("content").alias("data"))
    # both sides carry a scheme in one form or another
    norm = lambda c: F.regexp_replace(c, "^file:/+", "/")
    items = items.withColumn("file", norm(F.concat_ws("/", "folder", "path")))
    got = items.join(blobs.withColumn("file", norm(F.col("file"))), "file", "left")
    got = got.withColumn("n_", F.count("*").over(Window.partitionBy("package_id", "mask_ref")))
    digest = parsing.normalised_hash(F.col("sha256"))
    checks = [(~confined(F.col("path")), "path leaves the package: "), (F.coalesce("version", F.lit(1)) > 1, "newer package: "), (F.col("n_") > 1, "repeated mask_ref: "), (F.col("data").isNull(), "blob is missing: "), (F.length("data") != F.col("width") * F.col("height"), "blob has another size: ")]
    if verify:
        checks.append((digest.isNotNull() & (digest != F.sha2("data", 256)), "blob has another hash: "))
    state = F.lit(True)
    for bad, why in reversed(checks):
        state = F.when(bad, F.raise_error(F.concat(F.lit(why), F.coalesce("path", F.lit("?")))).cast("boolean")).otherwise(state)
    kind = F.when((F.col("kind") == "cropped") | (F.coalesce("x", F.lit(0)) != 0) | (F.coalesce("y", F.lit(0)) != 0), "cropped").otherwise("dense")
    return got.where(state).select("package_id", "mask_ref", kind.alias("kind"), F.col("width").alias("w"), F.col("height").alias("h"), F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("y", F.lit(0)).alias("y"), "path", "data")


def package_tracks(spark: SparkSession, folder: str) -> tuple[str | None, DataFrame]:
    """A mask package's id, and its tracks as one track document."""
    manifest = texts(spark, f"{folder.rstrip('/')}/manifest.json").withColumn("m", F.from_json("text", MANIFEST))
    row = manifest.select("m.package_id").first()
    if row is None:
        raise MediaError(f"{folder} has no manifest")
    return row["package_id"], manifest.select("doc", F.concat(F.lit('{"tracks": '), F.coalesce("m.tracks", F.lit("[]")), F.lit("}")).alias("text"))


PROBE = "streams array<struct<codec_type: string, width: bigint, height: bigint, avg_frame_rate: string, r_frame_rate: string, time_base: string, duration: string, duration_ts: bigint, nb_frames: string, sample_rate: string, channels: bigint, pix_fmt: string, color_range: string, color_space: string>>, format struct<duration: string>"


def probes(documents: DataFrame) -> DataFrame:
    """Stream facts of probe documents: sizes, rates, durations and whether the frame rate varies."""
    p = documents.select("doc", F.from_json("text", PROBE).alias("p"))
    first = lambda kind: F.get(F.filter("p.streams", lambda s: s["codec_type"] == kind), 0)
    v, a = first("video"), first("audio")
    base = F.coalesce(parsing.time_base(v["time_base"]), F.struct(F.lit(1).cast("bigint").alias("num"), F.lit(90_000).cast("bigint").alias("den")))
    secs = F.coalesce(v["duration_ts"] * base["num"] / base["den"], v["duration"].try_cast("double"), F.col("p.format.duration").try_cast("double"))
    avg, real = parsing.frame_rate(v["avg_frame_rate"]), parsing.frame_rate(v["r_frame_rate"])
    return p.select(
        "doc", v["width"].alias("w"), v["height"].alias("h"), secs.alias("secs"), F.coalesce(avg, real, F.lit(24.0)).alias("fps"), base.alias("time_base"), parsing.varies(avg, real, v["nb_frames"].try_cast("bigint"), secs).alias("varies"),
        parsing.pixel_format(v["pix_fmt"]).alias("pixel_format"), parsing.colour_range(F.coalesce(v["color_range"], F.lit(""))).alias("colour_range"), parsing.colour_space(F.coalesce(v["color_space"], F.lit(""))).alias("colour_space"),
        a.isNotNull().alias("has_audio"), a["sample_rate"].try_cast("int").alias("sample_rate"), a["channels"].alias("channels"),
    )


def cues(documents: DataFrame, by_suffix: bool = False) -> DataFrame:
    """``doc, nth, start, end, text`` of subtitle documents; by_suffix: an unknown suffix raises."""
    text = F.col("text")
    parsed = subtitles.parse(text)
    if by_suffix:
        end = F.lower(F.regexp_extract("doc", r"\.([A-Za-z]+)$", 1))
        parsed = F.when(end == "srt", subtitles.parse_srt(text)).when(end == "vtt", subtitles.parse_vtt(text)).when(end.isin("ass", "ssa"), subtitles.parse_ass(text)).otherwise(F.raise_error(F.concat(F.lit("no subtitle suffix: "), "doc")).cast(subtitles.CUES))
    return documents.select("doc", F.posexplode(parsed).alias("nth", "c")).select("doc", "nth", "c.*")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames from Parquet; what makes a frame must be there."""
    df = spark.read.parquet(path)
    missing = {"clip_id", "t_us", "e_us", "dur_us", "w", "h", "channels", "data"} - set(df.columns)
    if missing:
        raise MediaError(f"{posixpath.basename(path)} lacks {', '.join(sorted(missing))}")
    return df


def read_images(spark: SparkSession, path: str | Sequence[str], duration_us: int) -> DataFrame:
    """Picture files (PNG, JPEG, BMP and GIF, decoded by Spark's image source) as stills, a clip for each file; files that don't decode are left out."""
    from ..kernels.pictures import SwapRedBlue
    from ..operators.frames import apply

    if duration_us <= 0:
        raise MediaError("a still's duration must be above 0")
    i = spark.read.format("image").option("dropInvalid", True).load(path if isinstance(path, str) else list(path)).select("image.*")
    us = lambda v: F.lit(v).cast("bigint")
    rows = i.select(F.col("origin").alias("clip_id"), us(0).alias("t_us"), us(duration_us).alias("e_us"), us(duration_us).alias("dur_us"), F.col("width").alias("w"), F.col("height").alias("h"), F.col("nChannels").alias("channels"), "data")
    return apply(rows, [SwapRedBlue()])


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    if {"i0", "pcm"} <= set(df.columns):
        return unpack(df)
    missing = {"clip_id", "i", "ch", "v"} - set(df.columns)
    if missing:
        raise MediaError(f"{posixpath.basename(path)} lacks {', '.join(sorted(missing))}")
    return df


def unpack(chunks: DataFrame) -> DataFrame:
    """Samples of chunks ``clip_id, i0, channels, pcm array<float>``, interleaved."""
    out = chunks.select("clip_id", "i0", "channels", F.posexplode("pcm").alias("k", "v"))
    return out.select("clip_id", (F.col("i0") + F.floor(F.col("k") / F.col("channels"))).alias("i"), (F.col("k") % F.col("channels")).cast("int").alias("ch"), F.col("v").cast("double").alias("v"))


def pack(samples: DataFrame, channels: int, chunk: int = 48_000) -> DataFrame:
    """Chunks of samples; absent samples are 0."""
    out = samples.withColumn("i0", F.floor(F.col("i") / chunk) * chunk)
    got = out.groupBy("clip_id", "i0").agg(F.map_from_entries(F.collect_list(F.struct(((F.col("i") - F.col("i0")) * channels + F.col("ch")).cast("int").alias("k"), F.col("v").cast("float").alias("v")))).alias("m_"), (F.max(F.col("i") - F.col("i0")) + 1).alias("n_"))
    pcm = F.transform(F.sequence(F.lit(0), (F.col("n_") * channels - 1).cast("int")), lambda k: F.coalesce(F.try_element_at("m_", k), F.lit(0.0).cast("float")))
    return got.select("clip_id", "i0", F.lit(channels).alias("channels"), pcm.alias("pcm"))
