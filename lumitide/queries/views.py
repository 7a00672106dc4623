"""The driver's tables read as media relations, in Spark and in SQL.

Events are frames: a user's event is in force until the user's next one.  Embeddings are pictures of
8 x 8 pixels, or sounds of 64 samples.  Conversations are cues.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import in_force

DAY = 86_400_000_000
HOUR = 3_600_000_000
SPAN = 30 * DAY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, user_id, event_type, value, k, t_us``."""
    e = table(spark, sf_dir, "events")
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select("event_id", "user_id", "event_type", "value", k.alias("k"), t.alias("t_us"))


EV = "ev AS (SELECT event_id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, epoch_us(ts) - 1704067200000000 AS t_us FROM events)"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``clip_id, event_id, value, k, t_us, e_us, dur_us``: a clip of 30 days for each user."""
    e = events(spark, sf_dir).where((F.col("t_us") >= 0) & (F.col("t_us") < SPAN)).withColumnRenamed("user_id", "clip_id")
    out = in_force(e, ["clip_id"], "t_us", ["event_id"], F.lit(SPAN).cast("bigint"))
    return out.where("t_us < e_us").select("clip_id", "event_id", "value", "k", "t_us", "e_us", F.lit(SPAN).cast("bigint").alias("dur_us"))


FRAMES = f"""{EV}, fr0 AS (SELECT user_id AS clip_id, event_id, value, k, t_us, coalesce(lead(t_us) OVER (PARTITION BY user_id ORDER BY t_us, event_id), {SPAN}) AS e_us, {SPAN}::BIGINT AS dur_us FROM ev WHERE t_us >= 0 AND t_us < {SPAN}),
fr AS (SELECT * FROM fr0 WHERE t_us < e_us)"""


def hours(spark: SparkSession, sf_dir: str, step: int = 1) -> DataFrame:
    """``at_us``: the beginning of every hour of the 30 days."""
    return spark.range(0, 720, step).select((F.col("id") * HOUR).alias("at_us"))


def user_hours(spark: SparkSession, sf_dir: str, step: int = 6) -> DataFrame:
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("clip_id")).distinct()
    return users.withColumn("at_us", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SPAN - HOUR).cast("bigint"), F.lit(step * HOUR).cast("bigint"))))


USER_HOURS = f"uh AS (SELECT clip_id, h * {HOUR} AS at_us FROM (SELECT DISTINCT user_id AS clip_id FROM events), range(0, 720, 6) AS r(h))"


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, label, px``: 64 levels of 0 to 255."""
    e = table(spark, sf_dir, "embeddings")
    px = F.transform("embedding", lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x.cast("double") + 1.0) * 127.5).cast("int"))))
    return e.select("vec_id", "label", px.alias("px"))


PX = "fr AS (SELECT vec_id, label, list_transform(embedding, lambda x: least(255, greatest(0, CAST(floor((CAST(x AS DOUBLE) + 1e0) * 127.5e0) AS INTEGER)))) AS px FROM embeddings)"


def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As pictures, of RGB pixels (v, 255 - v, 3 v mod 256)."""
    rgb = F.flatten(F.transform("px", lambda v: F.array(v, F.lit(255) - v, (v * 3) % 256)))
    return pictures(spark, sf_dir).withColumn("px", rgb)


RGB = PX + ", rgb AS (SELECT vec_id, label, flatten(list_transform(px, lambda v: [v, 255 - v, (v * 3) % 256])) AS px FROM fr)"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``clip_id, i, ch, v``: 32 stereo samples of each embedding."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("clip_id"), "label", F.posexplode("embedding").alias("p", "x"))
    return e.select("clip_id", "label", F.floor(F.col("p") / 2).cast("bigint").alias("i"), (F.col("p") % 2).cast("int").alias("ch"), F.col("x").cast("double").alias("v"))


PCM = "pcm AS (SELECT vec_id AS clip_id, label, CAST((p - 1) // 2 AS BIGINT) AS i, CAST((p - 1) % 2 AS INTEGER) AS ch, CAST(embedding[p] AS DOUBLE) AS v FROM embeddings, range(1, 65) AS r(p))"


def joined(px: Column | str) -> Column:
    c = F.col(px) if isinstance(px, str) else px
    return F.array_join(c.cast("array<string>"), ",").alias("px")


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask samples: a user's events are places (value, k)."""
    e = events(spark, sf_dir)
    return e.select(F.col("user_id").cast("string").alias("subject"), "t_us", F.col("value").alias("cx"), F.col("k").cast("double").alias("cy"), (F.col("k") % 7 + 1.0).alias("radius"), F.lit(1.0).alias("conf"), F.when(F.col("k") > 90, "exiting").otherwise("active").alias("lifecycle"), (F.col("event_type") == "error").alias("occluded"))


MASKS = f"{EV}, ms AS (SELECT CAST(user_id AS VARCHAR) AS subject, t_us, value AS cx, CAST(k AS DOUBLE) AS cy, k % 7 + 1e0 AS radius, 1e0 AS conf, CASE WHEN k > 90 THEN 'exiting' ELSE 'active' END AS lifecycle, event_type = 'error' AS occluded FROM ev)"
