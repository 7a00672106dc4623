"""Retiming, joins by time and exact time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mediatime as M
from ..operators import compose, intervals, measures, timing
from . import query
from .views import DAY, EV, FRAMES, HOUR, SPAN, USER_HOURS, events, frames, table, user_hours

OUT = ["clip_id", "event_id", "t_us", "e_us", "dur_us"]
D10 = 10 * DAY


@query(f"WITH {FRAMES} SELECT clip_id, event_id, greatest(t_us - {DAY}, 0) AS t_us, least(e_us, {DAY + D10}) - {DAY} AS e_us, {D10}::BIGINT AS dur_us FROM fr WHERE e_us > {DAY} AND t_us < {DAY + D10}")
def trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.trim(frames(spark, sf_dir), DAY, D10).select(*OUT)


@query(f"WITH {FRAMES}, s AS (SELECT clip_id, event_id, CAST(round(t_us / 2.5e0) AS BIGINT) AS t_us, CAST(round(e_us / 2.5e0) AS BIGINT) AS e_us, CAST(round(dur_us / 2.5e0) AS BIGINT) AS dur_us FROM fr) SELECT * FROM s WHERE t_us < e_us")
def speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.speed(frames(spark, sf_dir), 2.5).select(*OUT)


@query(f"WITH {FRAMES} SELECT clip_id, event_id, t_us + CASE WHEN t_us > {D10} THEN {DAY} ELSE 0 END AS t_us, e_us + CASE WHEN e_us > {D10} THEN {DAY} ELSE 0 END AS e_us, dur_us + {DAY} AS dur_us FROM fr")
def freeze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.freeze(frames(spark, sf_dir), D10, DAY).select(*OUT)


LOOP = int(2.5 * SPAN)


@query(f"WITH {FRAMES} SELECT clip_id, event_id, t_us + k2 * dur_us AS t_us, least(e_us + k2 * dur_us, {LOOP}) AS e_us, {LOOP}::BIGINT AS dur_us FROM fr, range(0, 3) AS r(k2) WHERE t_us + k2 * dur_us < {LOOP}")
def loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.loop(frames(spark, sf_dir), until_us=LOOP).select(*OUT)


@query(f"WITH {FRAMES} SELECT clip_id, event_id, t_us + k2 * dur_us AS t_us, e_us + k2 * dur_us AS e_us, dur_us * 2 AS dur_us FROM fr, range(0, 2) AS r(k2)")
def loop_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.loop(frames(spark, sf_dir), times=2).select(*OUT)


@query(f"WITH {FRAMES} SELECT clip_id, event_id, dur_us - e_us AS t_us, dur_us - t_us AS e_us, dur_us FROM fr")
def time_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.mirror(frames(spark, sf_dir)).select(*OUT)


@query(f"WITH {FRAMES} SELECT clip_id, event_id, t_us, e_us, dur_us * 2 AS dur_us FROM fr UNION ALL SELECT clip_id, event_id, 2 * dur_us - e_us, 2 * dur_us - t_us, dur_us * 2 FROM fr")
def time_symmetrize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.symmetrize(frames(spark, sf_dir)).select(*OUT)


FPS = 1e6 / HOUR


@query(f"WITH {FRAMES}, g AS (SELECT CAST(i AS BIGINT) AS idx, floor((i / 240e0) * (i / 240e0) * (3e0 - (i / 240e0) * 2e0) * {SPAN}) AS s FROM range(0, 240) AS r(i)) SELECT clip_id, event_id, idx, CAST(s AS BIGINT) AS source_us FROM fr JOIN g ON t_us <= s AND s < e_us")
def accel_decel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.accel_decel(frames(spark, sf_dir), D10, FPS).select("clip_id", "event_id", "idx", "source_us")


@query(f"""WITH {FRAMES}, cuts AS (SELECT fr.*, CAST(k2 AS BIGINT) AS k2, lit FROM fr, range(0, 18) AS r(k2), (VALUES (true), (false)) AS l(lit)),
c AS (SELECT clip_id, event_id, greatest(t_us, k2 * {2 * 20 * HOUR} + CASE WHEN lit THEN 0 ELSE {30 * HOUR} END) AS t_us, least(e_us, (k2 + CASE WHEN lit THEN 0 ELSE 1 END) * {40 * HOUR} + CASE WHEN lit THEN {30 * HOUR} ELSE 0 END) AS e_us, lit FROM cuts)
SELECT * FROM c WHERE t_us < e_us""")
def blink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.blink(frames(spark, sf_dir), 30 * HOUR, 10 * HOUR).select("clip_id", "event_id", "t_us", "e_us", "lit")


@query(f"WITH {FRAMES} SELECT clip_id, event_id, CAST(h AS BIGINT) AS idx, h * {HOUR} AS t_us FROM fr, range(0, 720) AS r(h) WHERE h * {HOUR} >= t_us AND h * {HOUR} < e_us")
def frame_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.to_grid(frames(spark, sf_dir), FPS).select("clip_id", "event_id", "idx", "t_us")


@query(f"""WITH {FRAMES}, g AS (SELECT CAST(i AS BIGINT) AS idx, j, least(greatest(i * {6 * HOUR} - {3 * HOUR} + CAST(round(j * {2 * 3 * HOUR / 4}e0) AS BIGINT), 0), {SPAN - 1}) AS s FROM range(0, 120) AS r(i), range(0, 5) AS q(j))
SELECT clip_id, idx, CAST(sum(k) // count(*) AS INTEGER) AS k FROM fr JOIN g ON t_us <= s AND s < e_us GROUP BY clip_id, idx""")
def supersample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = timing.supersample(frames(spark, sf_dir).withColumn("px", F.array("k")), 3 * HOUR, 5, 1e6 / (6 * HOUR))
    return out.select("clip_id", "idx", F.get("px", 0).alias("k"))


@query(f"""WITH {FRAMES}, keys AS (SELECT clip_id, t_us AS ta, value AS va, CASE event_id % 3 WHEN 0 THEN 'hold' WHEN 1 THEN 'linear' ELSE 'smooth' END AS easing FROM fr),
sp AS (SELECT *, lead(ta) OVER w AS tb, lead(va) OVER w AS vb FROM keys WINDOW w AS (PARTITION BY clip_id ORDER BY ta, va)), hd AS (SELECT clip_id, arg_min(va, ta) AS head FROM keys GROUP BY clip_id), {USER_HOURS},
j AS (SELECT uh.*, ta, va, tb, vb, easing, head, (at_us - ta) / CAST(greatest(tb - ta, 1) AS DOUBLE) AS u FROM uh ASOF LEFT JOIN sp ON uh.clip_id = sp.clip_id AND at_us >= ta LEFT JOIN hd ON uh.clip_id = hd.clip_id)
SELECT clip_id, at_us, round(CASE WHEN ta IS NULL THEN coalesce(head, 0) WHEN tb IS NULL THEN va ELSE va + (vb - va) * CASE easing WHEN 'hold' THEN 0e0 WHEN 'smooth' THEN u * u * (3e0 - u * 2e0) ELSE u END END, 6) AS value FROM j""")
def keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    easing = F.when(F.col("event_id") % 3 == 0, "hold").when(F.col("event_id") % 3 == 1, "linear").otherwise("smooth")
    keys = frames(spark, sf_dir).select("clip_id", "t_us", "value", easing.alias("easing"))
    return timing.keyframes(user_hours(spark, sf_dir), keys, "at_us").select("clip_id", "at_us", F.round("value", 6).alias("value"))


@query(f"WITH {EV}, p AS (SELECT DISTINCT user_id AS clip_id, t_us // {HOUR} * {HOUR} AS pts_us FROM ev) SELECT clip_id, pts_us, row_number() OVER w - 1 AS ordinal, lead(pts_us) OVER w - pts_us AS duration_us FROM p WINDOW w AS (PARTITION BY clip_id ORDER BY pts_us)")
def vfr_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.timing_index(_points(spark, sf_dir))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(F.col("user_id").alias("clip_id"), (F.floor(F.col("t_us") / HOUR) * HOUR).alias("pts_us"))


@query(f"""WITH {EV}, p AS (SELECT DISTINCT user_id AS clip_id, t_us // {HOUR} * {HOUR} AS pts_us FROM ev), ix AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY pts_us) - 1 AS ordinal FROM p), {USER_HOURS}
SELECT uh.clip_id, at_us, coalesce(ordinal, 0) AS ordinal FROM uh ASOF LEFT JOIN ix ON uh.clip_id = ix.clip_id AND at_us >= pts_us""")
def vfr_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.frame_index_at(user_hours(spark, sf_dir), timing.timing_index(_points(spark, sf_dir)), t="at_us").select("clip_id", "at_us", "ordinal")


_T = "(SELECT event_id, CAST((event_id - 3000) * 7919 AS HUGEINT) AS ticks, CAST(1000 + user_id AS HUGEINT) AS scale FROM events)"


def _rebased(ticks: str, scale: str, to: str) -> str:
    n = f"({ticks} * {to} + CASE WHEN {ticks} >= 0 THEN {scale} // 2 ELSE -({scale} // 2) END)"
    return f"CAST(({n} - (({n} % {scale}) + {scale}) % {scale}) // {scale} AS BIGINT)"


@query(f"""SELECT event_id, {_rebased('ticks', 'scale', '90000')} AS at_90k, {_rebased('ticks', 'scale', '24')} AS at_24, CAST(CASE WHEN ticks <= 0 THEN 0 ELSE ticks * 30 // scale END AS BIGINT) AS frame_30,
CAST(CASE WHEN ticks <= 0 THEN 0 ELSE floor(CAST(ticks AS DOUBLE) * 29.97e0 / CAST(scale AS DOUBLE)) END AS BIGINT) AS frame_ntsc, CAST(ticks * 1000000000 // scale AS BIGINT) AS nanos, CAST(ticks + {_rebased('12345', '1000', 'scale')} AS BIGINT) AS later, CAST(round(CAST(ticks AS DOUBLE) / 2e0) AS BIGINT) AS half FROM {_T}""")
def media_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", M.media_time((F.col("event_id") - 3000) * 7919, F.col("user_id") + 1000).alias("t"))
    t, far = F.col("t"), M.media_time(12345, 1000)
    return e.select(
        "event_id", M.rebase(t, 90_000)["ticks"].alias("at_90k"), M.rebase(t, 24)["ticks"].alias("at_24"), M.frame_index(t, 30.0).alias("frame_30"), M.frame_index(t, 29.97).alias("frame_ntsc"),
        M.as_nanos(t).alias("nanos"), M.add(t, far)["ticks"].alias("later"), M.over(t, 2.0)["ticks"].alias("half"),
    )


_LI = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus"
LINES = f"li AS (SELECT l_orderkey, l_partkey, CAST(l_quantity * 1000000 AS BIGINT) AS duration_us, CAST(sum(l_quantity * 1000000) OVER (PARTITION BY l_orderkey ORDER BY {_LI} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS end_us FROM lineitem)"


def _timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("duration_us", (F.col("l_quantity") * 1_000_000).cast("bigint"))
    return compose.running_ends(lines, _LI.split(", "), "duration_us", ["l_orderkey"]).select("l_orderkey", "l_partkey", "duration_us", "start_us", "end_us")


@query(f"WITH {LINES} SELECT l_orderkey, l_partkey, end_us - duration_us AS start_us, end_us, duration_us FROM li")
def concat_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timeline(spark, sf_dir)


@query(f"WITH {LINES}, p AS (SELECT o_orderkey, CAST(o_totalprice * 100 AS BIGINT) % 100 * 1000000 AS at_us FROM orders) SELECT o_orderkey, at_us, l_partkey, at_us - (end_us - duration_us) AS local_us FROM p JOIN li ON o_orderkey = l_orderkey AND at_us >= end_us - duration_us AND at_us < end_us")
def concat_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    points = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("l_orderkey"), (cents % 100 * 1_000_000).alias("at_us"))
    return compose.map_concat_time(points, _timeline(spark, sf_dir), "at_us", ["l_orderkey"]).select("o_orderkey", "at_us", "l_partkey", "local_us")


@query(f"WITH {FRAMES} SELECT 'concat' AS clip_id, event_id, t_us + part * {SPAN} AS t_us, e_us + part * {SPAN} AS e_us, {2 * SPAN}::BIGINT AS dur_us FROM fr, range(0, 2) AS r(part)")
def concat_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips at their own lengths, one after the other."""
    fr = frames(spark, sf_dir)
    return compose.concatenate([fr, fr], [SPAN, SPAN]).select(*OUT)


@query(f"""WITH {FRAMES}, {USER_HOURS}, ly AS (SELECT clip_id, t_us AS s, {9 * HOUR} + k * {HOUR} AS d, event_id % 4 AS li, event_id AS seq, 0.5e0 + 0.1e0 * (event_id % 6) AS o, CAST(k AS DOUBLE) AS v FROM fr),
st AS (SELECT uh.clip_id, at_us, list({{'v': v, 'o': o}} ORDER BY li, seq) AS st FROM uh JOIN ly ON uh.clip_id = ly.clip_id AND at_us >= s AND at_us < s + d GROUP BY uh.clip_id, at_us)
SELECT uh.clip_id, uh.at_us, CAST(CASE WHEN st IS NULL THEN 16 ELSE list_reduce(list_prepend({{'v': 16e0, 'o': 1e0}}, st), lambda a, x: {{'v': round(x.v * least(x.o, 1e0) + a.v * (1e0 - least(x.o, 1e0))), 'o': 1e0}}).v END AS INTEGER) AS value, CAST(coalesce(len(st), 0) AS INTEGER) AS n_layers
FROM uh LEFT JOIN st ON uh.clip_id = st.clip_id AND uh.at_us = st.at_us""")
def compose_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    fr = frames(spark, sf_dir)
    layers = fr.select("clip_id", F.col("t_us").alias("start_us"), (9 * HOUR + F.col("k") * HOUR).alias("dur_us"), (F.col("event_id") % 4).alias("layer_index"), F.col("event_id").alias("seq"), (F.lit(0.5) + F.lit(0.1) * (F.col("event_id") % 6)).alias("opacity"), F.col("k").cast("double").alias("value"))
    out = compose.compose_values(user_hours(spark, sf_dir), layers, "at_us", F.lit(16), ["clip_id", "at_us"], 8 * HOUR, ["clip_id"])
    return out.select("clip_id", "at_us", "value", "n_layers")


@query(f"WITH {EV} SELECT a.event_id, b.event_id AS other_id FROM ev a JOIN ev b ON a.user_id = b.user_id AND a.t_us >= b.t_us AND a.t_us < b.t_us + b.k * {HOUR}")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    spans = e.select("user_id", F.col("event_id").alias("other_id"), F.col("t_us").alias("s"), (F.col("t_us") + F.col("k") * HOUR).alias("e"))
    return intervals.interval_join(e.select("user_id", "event_id", "t_us"), spans, "t_us", "s", "e", ["user_id"], 8 * HOUR).select("event_id", "other_id")


@query(f"WITH {EV}, {USER_HOURS}, c AS (SELECT user_id, t_us, max(value) AS value FROM ev GROUP BY ALL) SELECT uh.clip_id, at_us, c.value FROM uh ASOF LEFT JOIN c ON uh.clip_id = c.user_id AND at_us >= c.t_us")
def asof_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = events(spark, sf_dir).select(F.col("user_id").alias("clip_id"), "t_us", "value")
    return intervals.asof_join(user_hours(spark, sf_dir), values, ["clip_id"], "at_us", "t_us", ["value"]).select("clip_id", "at_us", "value")


FLAGSHIP = f"""WITH {FRAMES}, a AS (SELECT clip_id, value, greatest(t_us - {DAY}, 0) AS t_us FROM fr WHERE e_us > {DAY} AND t_us < {DAY + D10}), b AS (SELECT clip_id, value, CAST(round(t_us / 2e0) AS BIGINT) AS t_us FROM a),
g AS (SELECT clip_id, least(floor(t_us * 20 / {5 * DAY}e0), 19)::BIGINT AS bucket, min(value) AS lo, max(value) AS hi FROM b GROUP BY ALL), u AS (SELECT clip_id, bucket FROM (SELECT DISTINCT clip_id FROM b), range(0, 20) AS r(bucket))
SELECT u.clip_id, u.bucket, coalesce(lo, 0) AS lo, coalesce(hi, 0) AS hi FROM u LEFT JOIN g ON u.clip_id = g.clip_id AND u.bucket = g.bucket"""


@query(FLAGSHIP)
def trim_speed_waveform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten days of each user's clip at double speed, as extremes of 20 buckets."""
    part = timing.speed(timing.trim(frames(spark, sf_dir), DAY, D10), 2.0)
    return measures.bucket_extremes(part, "value", 5 * DAY, 20, ["clip_id"])


@query("SELECT event_type, percentile_cont(0.95) WITHIN GROUP (ORDER BY value) AS percentile FROM events GROUP BY event_type".replace("percentile_cont(0.95) WITHIN GROUP (ORDER BY value)", "round(quantile_cont(value, 0.95), 6)"))
def percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = measures.percentile(table(spark, sf_dir, "events"), "value", 0.95, ["event_type"])
    return out.select("event_type", F.round("percentile", 6).alias("percentile"))


@query(f"""WITH w AS (SELECT event_type, date_trunc('hour', ts) AS start, min(value) AS lo, max(value) AS hi, count(*) AS n FROM events GROUP BY ALL), m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events)
SELECT event_type, epoch_us(start) - 1704067200000000 AS t_us, lo, hi, n FROM w, m WHERE start + INTERVAL 1 HOUR <= mark""")
def stream_waveform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live waveform, fed with the whole table as one stream and closed by its watermark."""
    from ..scratch import folder
    from ..streaming import live

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    at = folder(spark)
    run = live.waveform(rows).writeStream.format("parquet").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/out")
    run.awaitTermination()
    since = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', cast(start as timestamp_ntz))")
    return spark.read.parquet(f"{at}/out").select("event_type", since.alias("t_us"), "lo", "hi", "n")


