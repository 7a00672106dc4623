"""Samples, mixes and cues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sound as S
from ..functions import subtitles
from ..operators import compose, measures, timing
from ..plans.run import window_cues
from ..sources import documents
from . import query
from .views import EV, PCM, events, samples, table

KEYS = ["clip_id", "i", "ch"]


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*KEYS, F.round("v", 6).alias("v"))


@query(f"WITH {PCM} SELECT clip_id, i, ch, round(v * 1.75e0, 6) AS v FROM pcm")
def gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(samples(spark, sf_dir).withColumn("v", S.gain(F.col("v"), 1.75)))


@query(f"WITH {PCM} SELECT clip_id, i, ch, round(v * CASE ch WHEN 0 THEN 0.25e0 ELSE 2e0 END, 6) AS v FROM pcm")
def stereo_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(samples(spark, sf_dir).withColumn("v", S.stereo_gain(F.col("v"), F.col("ch"), 0.25, 2.0)))


@query(f"WITH {PCM} SELECT clip_id, i, ch, round(v * least(greatest(i / 8e0, 0e0), 1e0), 6) AS v FROM pcm")
def audio_fade_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(samples(spark, sf_dir).withColumn("v", S.fade_in(F.col("v"), F.col("i").cast("double"), 8.0)))


@query(f"WITH {PCM} SELECT clip_id, i, ch, round(v * (1e0 - least(greatest((i - 20) / 12e0, 0e0), 1e0)), 6) AS v FROM pcm")
def audio_fade_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(samples(spark, sf_dir).withColumn("v", S.fade_out(F.col("v"), F.col("i").cast("double"), F.lit(32.0), 12.0)))


@query(f"WITH {PCM} SELECT clip_id, i + 250 * 8 // 1000 AS i, ch, round(v, 6) AS v FROM pcm")
def audio_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(timing.delay(samples(spark, sf_dir), 250_000, 8))


@query(f"WITH {PCM}, g AS (SELECT clip_id, CAST(i AS BIGINT) AS i, CAST(ch AS INTEGER) AS ch FROM (SELECT DISTINCT clip_id FROM pcm), range(0, 40) AS r(i), range(0, 2) AS c(ch)) SELECT g.clip_id, g.i, g.ch, coalesce(round(v, 6), 0) AS v FROM g LEFT JOIN pcm ON g.clip_id = pcm.clip_id AND g.i = pcm.i AND g.ch = pcm.ch")
def zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(timing.zero_filled(samples(spark, sf_dir), 40, 2))


@query("""WITH x AS (SELECT vec_id, embedding AS e, CAST(i AS BIGINT) AS i, i * 3 / 2e0 AS p FROM embeddings, range(0, 42) AS r(i))
SELECT vec_id AS clip_id, i, round(CAST(e[CAST(floor(p) AS INTEGER) + 1] AS DOUBLE) * (1e0 - (p - floor(p))) + CAST(e[least(CAST(floor(p) AS INTEGER) + 1, 63) + 1] AS DOUBLE) * (p - floor(p)), 6) AS v FROM x""")
def resample_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    pcm = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("clip_id"), S.resample(F.col("embedding").cast("array<double>"), 48_000, 32_000).alias("pcm"))
    return pcm.select("clip_id", F.posexplode("pcm").alias("i", "v")).select("clip_id", F.col("i").cast("bigint").alias("i"), F.round("v", 6).alias("v"))


@query(f"WITH {PCM}, m AS (SELECT label, i + clip_id % 16 AS i, ch, v * greatest(0.5e0 + (clip_id % 3) * 0.25e0, 0e0) AS v FROM pcm) SELECT label, i, ch, round(greatest(least(sum(v), 1e0), -1e0), 6) AS v FROM m GROUP BY ALL")
def audio_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = samples(spark, sf_dir).withColumns({"gain": F.lit(0.5) + (F.col("clip_id") % 3) * 0.25, "start_i": F.col("clip_id") % 16})
    out = compose.mix_groups(tracks, ["label"])
    return out.select("label", "i", "ch", F.round("v", 6).alias("v"))


@query(f"WITH {PCM}, p AS (SELECT i + clip_id * 64 AS i, ch, v FROM pcm) SELECT i, ch, round(greatest(least(sum(v), 1e0), -1e0), 6) AS v FROM (SELECT i, ch, v FROM p UNION ALL SELECT i + 2, ch, v * 0.5e0 FROM p) GROUP BY ALL")
def mix_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All clips, one after the other with pauses, mixed with a later and softer copy."""
    pcm = samples(spark, sf_dir).withColumn("i", F.col("i") + F.col("clip_id") * 64)
    return compose.mix([(pcm, 1.0, 0), (pcm, 0.5, 200_000)], 10).select("i", "ch", F.round("v", 6).alias("v"))


@query(f"WITH {PCM}, p AS (SELECT clip_id, i, max(abs(v)) AS peak FROM pcm GROUP BY ALL) SELECT clip_id, CAST(least(i * 10 // 32, 9) AS BIGINT) AS bucket, round(-max(peak), 6) AS lo, round(max(peak), 6) AS hi FROM p GROUP BY ALL")
def waveform(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = measures.waveform(samples(spark, sf_dir), F.lit(32), 10)
    return out.select("clip_id", "bucket", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query(f"WITH {PCM}, p AS (SELECT clip_id, max(abs(v)) AS peak FROM pcm GROUP BY ALL) SELECT pcm.clip_id, i, ch, round(v * CASE WHEN peak > 1e-9 THEN 0.9e0 / peak ELSE 1 END, 6) AS v FROM pcm JOIN p ON pcm.clip_id = p.clip_id")
def normalize_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(measures.normalize(samples(spark, sf_dir), 0.9))


@query(f"WITH {PCM} SELECT clip_id, i, ch, round(v, 6) AS v FROM pcm")
def pack_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples into interleaved chunks and back."""
    return _rounded(documents.unpack(documents.pack(samples(spark, sf_dir), 2, 10)))


@query(f"WITH {PCM} SELECT clip_id AS source, i + 32 * part AS i, ch, round(v * CASE part WHEN 0 THEN 1e0 ELSE -0.5e0 END, 6) AS v FROM pcm, range(0, 2) AS r(part)")
def concat_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every clip at its full length, followed by an inverted and softer copy."""
    pcm = samples(spark, sf_dir).withColumn("source", F.col("clip_id"))
    out = compose.concatenate_audio([pcm, pcm.withColumn("v", F.col("v") * -0.5)], [32, 32])
    return out.select("source", "i", "ch", F.round("v", 6).alias("v"))


@query(f"WITH {EV}, s AS (SELECT event_id, k + 1e0 AS v, k + 1e0 + (event_id % 5) * 0.03e0 AS a FROM ev) SELECT event_id, abs(v - a) <= 1e0 / 30e0 + 0.05e0 AS aligned FROM s")
def av_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("k") + 1.0
    return events(spark, sf_dir).select("event_id", S.drift_ok(v, v + (F.col("event_id") % 5) * F.lit(0.03), 30.0).alias("aligned"))


# cues


CUE = "cu AS (SELECT conv_id, CAST(turn AS INTEGER) AS turn, turn * 3.25e0 AS \"start\", turn * 3.25e0 + 2.5e0 AS \"end\", trim(regexp_replace(text, '[^a-zA-Z0-9 .,]+', ' ', 'g'), ' ') AS text FROM conversations)"
SHOWN = "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS nth, \"start\", \"end\", text FROM cu WHERE text <> ''"


def _docs(spark: SparkSession, sf_dir: str, head: str, join: str, block) -> DataFrame:
    """A document for each conversation."""
    text = F.trim(F.regexp_replace("text", "[^a-zA-Z0-9 .,]+", " "))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"))
    parts = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("all"))
    return parts.select("conv_id", F.concat(F.lit(head), F.array_join(F.transform("all", block), join)).alias("text"))


def _stamp(turn, extra: int, form: str):
    """A time of turn * 3.25 s plus some milliseconds."""
    ms = turn.cast("bigint") * 3250 + extra
    h, m, s = F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60
    return F.format_string(form, h, m, s, ms % 1000 if form.count("%") == 4 and "%03d" in form else F.floor(ms % 1000 / 10))


def _cues(docs: DataFrame, parsed) -> DataFrame:
    return docs.select("conv_id", F.posexplode(parsed).alias("nth", "c")).select("conv_id", "nth", "c.start", "c.end", "c.text")


@query(f"WITH {CUE} {SHOWN}")
def parse_srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = "%02d:%02d:%02d,%03d"
    docs = _docs(spark, sf_dir, "", "\r\n\r\n", lambda x: F.concat((x["turn"] + 1).cast("string"), F.lit("\r\n"), _stamp(x["turn"], 0, form), F.lit(" --> "), _stamp(x["turn"], 2500, form), F.lit("\r\n"), x["text"]))
    return _cues(docs, subtitles.parse_srt(F.col("text")))


@query(f"WITH {CUE} {SHOWN}")
def parse_vtt(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = "%02d:%02d:%02d.%03d"
    docs = _docs(spark, sf_dir, "WEBVTT\n\nNOTE made\n\n", "\n\n", lambda x: F.concat(_stamp(x["turn"], 0, form), F.lit(" --> "), _stamp(x["turn"], 2500, form), F.lit(" align:start\n<b>"), x["text"], F.lit("</b>")))
    return _cues(docs, subtitles.parse(F.col("text")))


@query(f"WITH {CUE} {SHOWN}")
def parse_ass(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = "%d:%02d:%02d.%02d"
    head = "[Script Info]\n; made\n[V4+ Styles]\nFormat: Name, Fontname\n[Events]\nFormat: Layer, Start, End, Style, Text\n"
    docs = _docs(spark, sf_dir, head, "\n", lambda x: F.concat(F.lit("Dialogue: 0,"), _stamp(x["turn"], 0, form), F.lit(","), _stamp(x["turn"], 2500, form), F.lit(",Default,{\\i1}"), x["text"]))
    return _cues(docs, subtitles.parse(F.col("text")))


@query(f"WITH {CUE}, w AS (SELECT conv_id, turn, CAST(round(\"start\" * 1000000) AS BIGINT) AS s, CAST(round(\"end\" * 1000000) AS BIGINT) AS e FROM cu) SELECT conv_id, turn, s + 500000 AS start_us, e + 500000 AS end_us FROM w WHERE e > 3000000 AND s < 9000000")
def cue_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("turn"), (F.col("turn") * 3.25).alias("start"), (F.col("turn") * 3.25 + 2.5).alias("end"))
    return window_cues(c, 3_000_000, 6_000_000, 3_500_000).select("conv_id", "turn", "start_us", "end_us")


@query("WITH s AS (SELECT page_id, regexp_replace(html, '<[^>]*(>|$)', '', 'g') AS t FROM pages) SELECT page_id, length(t) AS n, md5(t) AS digest FROM s")
def strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = subtitles.strip_tags(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(t).cast("bigint").alias("n"), F.md5(t).alias("digest"))
