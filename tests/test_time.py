"""Exact time, on the driver and as columns."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumitide.errors import ParamError
from lumitide.functions import mediatime as M
from lumitide.mediatime import MediaTime


def test_driver_rules():
    assert MediaTime(15, 30).frame_index(30) == 15 and MediaTime(15, 30).frame_index(60) == 30
    assert MediaTime.from_secs(1.5, 1000) == (1500, 1000)
    assert MediaTime(1000, 1000).rebase(90_000) == (90_000, 90_000)
    assert MediaTime(1000, 1000).plus(MediaTime(90_000, 90_000)) == (2000, 1000)
    assert MediaTime(2000, 1000).minus(MediaTime(1, 1)) == (1000, 1000)
    assert MediaTime(4000, 1000).over(2) == (2000, 1000) and MediaTime(4000, 1000).times(3) == (12_000, 1000)
    assert MediaTime(1, 1) != MediaTime(1000, 1000)
    assert MediaTime(-9, 4).rebase(1) == (-3, 1)  # one lower than rounding would give
    with pytest.raises(ParamError):
        MediaTime(4000, 1000).over(0)
    assert MediaTime.from_json({"ticks": 5, "timescale": 0}) is None and MediaTime.from_json("1") is None and MediaTime.from_json(0.5) == (500_000, 1_000_000)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 1 << 40), st.integers(1, 200_000), st.integers(1, 200_000))
def test_rebase_is_nearest(ticks, a, b):
    got = MediaTime(ticks, a).rebase(b).ticks
    assert abs(got * a - ticks * b) * 2 <= a + 1


CASES = [(0, 1), (15, 30), (-9, 4), (-1, 3), (90_000, 90_000), ((1 << 63) - 1, 1), (-(1 << 63), 7), (123_456_789, 4_294_967_295), (1, 2), (-1, 2)]


def test_columns_agree_with_driver(spark):
    df = spark.createDataFrame(CASES, "ticks long, scale long").select(M.media_time(F.col("ticks"), F.col("scale")).alias("t"))
    t, x = F.col("t"), M.media_time(7, 3)
    got = df.select("t", M.rebase(t, 90_000).alias("r"), M.add(t, x).alias("a"), M.subtract(t, x).alias("s"), M.longest(t, x).alias("l"), M.times(t, 3).alias("m"), M.frame_index(t, 24.0).alias("i"), M.frame_index(t, 29.97).alias("n")).collect()
    for r in got:
        d = MediaTime(*r["t"])
        y = MediaTime(7, 3)
        assert (tuple(r["r"]), tuple(r["a"]), tuple(r["s"]), tuple(r["l"]), tuple(r["m"])) == (d.rebase(90_000), d.plus(y), d.minus(y), d.longest(y), d.times(3)), d
        if abs(d.ticks) < 1 << 60:
            assert (r["i"], r["n"]) == (d.frame_index(24), d.frame_index(29.97)), d


def test_columns_with_bad_values(spark):
    r = spark.range(1).select(
        M.media_time(1, 0).alias("zero"), M.from_secs(F.lit(float("nan")), 1000).alias("nan"), M.from_secs(F.lit(float("inf")), 1000).alias("inf"), M.from_secs(F.lit(-1.5), 1).alias("away"), M.since(M.media_time(5, 1), M.media_time(1, 2)).alias("mixed"),
        M.from_json(F.lit("1.5")).alias("j1"), M.from_json(F.lit('{"ticks": 3, "timescale": 2}')).alias("j2"), M.from_json(F.lit("[]")).alias("j3"), M.frame_count(F.lit(0.1), F.lit(1.0)).alias("one"), M.frame_count(F.lit(-1.0), F.lit(1.0)).alias("none"),
        M.frame_range(M.media_time(0, 30), M.media_time(30, 30), 30.0).alias("range"), M.as_nanos(M.media_time(1, 3)).alias("nanos"), M.audio_index(M.media_time(1, 2), 48_000).alias("audio"),
    ).first()
    assert (r.zero, r.nan, r.inf, r.mixed, r.j3) == (None,) * 5
    assert r.away.ticks == -2 and tuple(r.j1) == (1_500_000, 1_000_000) and tuple(r.j2) == (3, 2) and (r.one, r.none) == (1, 0)
    assert tuple(r.range) == (0, 30) and r.nanos == 333_333_333 and r.audio == 24_000
