"""Live operators, fed from files."""

import time

from pyspark.sql import functions as F

from lumitide.streaming import live

SCHEMA = "user_id long, event_type string, ts timestamp, value double"


def feed(spark, path, rows, name):
    spark.createDataFrame(rows, "user_id long, event_type string, ts string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{path}/{name}")


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(path))


def run(df, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(f"q{time.time_ns()}").outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp{time.time_ns()}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(q.name).collect()


def test_late_rows_are_left_out(spark, tmp_path):
    src, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")

    def step():
        q = live.waveform(stream(spark, src)).writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        q.awaitTermination()

    feed(spark, src, [(1, "a", "2024-01-01 00:10:00", 1.0), (1, "a", "2024-01-01 00:50:00", 5.0)], "1")
    step()
    feed(spark, src, [(1, "a", "2024-01-01 03:00:00", 9.0)], "2")
    step()
    feed(spark, src, [(1, "a", "2024-01-01 00:20:00", 99.0)], "3")
    step()
    assert [(r.lo, r.hi, r.n) for r in spark.read.parquet(out).collect()] == [(1.0, 5.0, 2)]


def test_trim_and_held(spark, tmp_path):
    src = tmp_path / "in"
    feed(spark, src, [(1, "a", "2024-01-01 00:10:00", 1.0), (2, "a", "2024-01-01 00:10:00", 7.0)], "1")
    time.sleep(1.1)
    feed(spark, src, [(1, "a", "2024-01-01 00:30:00", 3.0), (1, "a", "2024-01-01 00:20:00", 2.0)], "2")
    assert len(run(live.trim(stream(spark, src), "2024-01-01 00:20:00", "2024-01-01 00:30:00"), tmp_path)) == 1
    out = sorted((r.user_id, r.value, r.held) for r in run(live.held(stream(spark, src)), tmp_path))
    assert [(k, v, None if h is None or h != h else h) for k, v, h in out] == [(1, 1.0, None), (1, 2.0, 1.0), (1, 3.0, 2.0), (2, 7.0, None)]
    assert len(run(live.deduplicated(stream(spark, src), ["user_id"], "1 hour"), tmp_path)) == 2
