"""Retiming, joins, composition, vision and documents on small clips, with edges."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lumitide.errors import ParamError
from lumitide.functions import geometry, parsing, sound, subtitles
from lumitide.operators import compose, intervals, measures, timing, vision
from lumitide.sources import documents

S = 1_000_000


@pytest.fixture(scope="module")
def clip(spark):
    """Four frames of a second; the last is held for two."""
    rows = [("a", k, k * S, (k + 1 if k < 3 else 5) * S, 5 * S) for k in range(4)]
    return spark.createDataFrame(rows, "clip_id string, v long, t_us long, e_us long, dur_us long")


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*(cols or ("v", "t_us", "e_us"))).collect())


def at(df, secs):
    return [r.v for r in df.where((F.col("t_us") <= secs * S) & (F.lit(secs * S) < F.col("e_us"))).collect()]


def test_trim(clip):
    assert got(timing.trim(clip, S // 2, 2 * S)) == [(0, 0, S // 2), (1, S // 2, 3 * S // 2), (2, 3 * S // 2, 2 * S)]
    with pytest.raises(ParamError):
        timing.trim(clip, 0, 0)


def test_speed_and_grid(clip):
    fast = timing.speed(clip, 2)
    assert got(fast, "v", "dur_us")[0] == (0, 2_500_000)
    assert [r[0] for r in got(timing.to_grid(fast, 2), "idx", "v")] == [0, 1, 2, 3, 4]
    with pytest.raises(ParamError):
        timing.speed(clip, float("nan"))


def test_freeze(clip):
    out = timing.freeze(clip, S, 3 * S)
    assert at(out, 1) == at(out, 3.9) == [1] and at(out, 4.5) == [1] and at(out, 5) == [2] and at(out, 0.5) == [0]


def test_loop_mirror_symmetrize(clip):
    assert at(timing.loop(clip, times=2), 5.5) == [0]
    assert max(r.e_us for r in timing.loop(clip, until_us=7 * S).collect()) == 7 * S
    assert at(timing.mirror(clip), 0) == [3] and at(timing.mirror(clip), 4.5) == [0]
    assert at(timing.symmetrize(clip), 9.5) == [0]
    with pytest.raises(ParamError):
        timing.loop(clip)


def test_blink(clip):
    out = timing.blink(clip, S // 2, S // 2)
    assert sum(r.e_us - r.t_us for r in out.collect()) == 5 * S
    assert sum(r.e_us - r.t_us for r in out.where("lit").collect()) == 5 * S // 2


def test_grid_holds_the_last_frame_to_the_end(spark):
    df = spark.createDataFrame([("a", 0, 0, S, S)], "clip_id string, v long, t_us long, e_us long, dur_us long")
    assert [r.idx for r in timing.to_grid(df, 2.4).orderBy("idx").collect()] == [0, 1]
    assert timing.to_grid(df.where("false"), 10).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-50, 10**6), st.integers(0, 10**6)), max_size=12), st.lists(st.tuples(st.integers(0, 3), st.integers(-50, 2 * 10**6)), max_size=12), st.integers(1, 1000))
def test_interval_join_is_a_theta_join(spark, spans, points, width):
    s = spark.createDataFrame([(k, a, a + n, i) for i, (k, a, n) in enumerate(spans)], "k long, s long, e long, i long")
    p = spark.createDataFrame([(k, t, j) for j, (k, t) in enumerate(points)], "k long, t long, j long")
    found = sorted((r.i, r.j) for r in intervals.interval_join(p, s, "t", "s", "e", ["k"], width).collect())
    want = sorted((i, j) for i, (k, a, n) in enumerate(spans) for j, (q, t) in enumerate(points) if k == q and a <= t < a + n)
    assert found == want


def test_interval_join_left_keeps_points(spark):
    s = spark.createDataFrame([(0, 10, 20, "x")], "k long, s long, e long, v string")
    p = spark.createDataFrame([(0, 5), (0, 10), (0, 19), (0, 20)], "k long, t long")
    assert sorted((r.t, r.v) for r in intervals.interval_join(p, s, "t", "s", "e", ["k"], 4, "left").collect()) == [(5, None), (10, "x"), (19, "x"), (20, None)]


def test_asof_with_ties_and_nulls(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t long")
    right = spark.createDataFrame([("a", 2, 1.0), ("a", 2, 3.0), ("a", 6, 9.0)], "k string, at long, v double")
    assert sorted((r.k, r.t, r.v) for r in intervals.asof_join(left, right, ["k"], "t", "at", ["v"]).collect()) == [("a", 1, None), ("a", 5, 3.0), ("b", 9, None)]


def test_fold_is_ordered(spark):
    grid = spark.createDataFrame([(0,), (S,)], "t long")
    layers = spark.createDataFrame([(0, S, 1, 0, 1.0, 200.0), (0, S, 0, 1, 1.0, 10.0), (S, S, 0, 2, 0.5, 255.0)], "start_us long, dur_us long, layer_index int, seq int, opacity double, value double")
    out = {r.t: (r.value, r.n_layers) for r in compose.compose_values(grid, layers, "t", F.lit(0), ["t"]).collect()}
    assert out == {0: (200, 2), S: (128, 1)}


def test_mix_clamps_and_starts(spark):
    a = spark.createDataFrame([("a", i, 0, 0.75) for i in range(4)], "clip_id string, i long, ch int, v double")
    out = {r.i: r.v for r in compose.mix([(a, 1.0, 0), (a, 1.0, 2 * S), (a, -1.0, 0)], 1).collect()}
    assert out == {0: 0.75, 1: 0.75, 2: 1.0, 3: 1.0, 4: 0.75, 5: 0.75}


MASK = "subject string, t_us long, cx double, cy double, radius double, conf double, lifecycle string, occluded boolean"


def test_regions(spark):
    m = spark.createDataFrame([("a", 0, 0.0, 0.0, 5.0, 1.0, "active", False), ("a", 2 * S, 100.0, 0.0, 15.0, 0.5, "exiting", False), ("p", 0, 1.0, 1.0, 5.0, 1.0, "active", True), (None, 5 * S, 7.0, 7.0, 1.0, 1.0, None, None)], MASK)
    grid = spark.createDataFrame([(-S,), (S // 2,), (S,), (9 * S,)], "at_us long")
    out = {(r.subject, r.at_us): (r.cx, r.radius, r.conf, r.lifecycle) for r in vision.regions_at(m, grid).collect()}
    assert out[("a", S // 2)] == (25.0, 7.5, 0.875, "active") and out[("a", S)][3] == "exiting" and out[("a", -S)][0] == 0.0 and out[("a", 9 * S)][0] == 100.0
    assert out[("_anon", S)][0] == 7.0 and not any(k[0] == "p" for k in out)
    held = {(r.subject, r.at_us): r.cx for r in vision.regions_at(m, grid, interpolation="hold").collect()}
    assert held[("a", S)] == 0.0 and ("a", -S) not in held
    opaque = {(r.subject, r.at_us): r.radius for r in vision.regions_at(m, grid, interpolation="hold", missing="opaque").collect()}
    assert opaque[("a", -S)] == 1e6 and opaque[("_anon", S)] == 1e6
    with pytest.raises(ParamError):
        vision.regions_at(m, grid, interpolation="cubic")


def test_packages_and_hosts(spark):
    refs = spark.createDataFrame([("p", "m", None), ("q", "m", "x.bin"), ("q", "z", "y.bin")], "package_id string, mask_ref string, path string")
    assets = spark.createDataFrame([("p", "m", "a.bin", "A"), ("o", "o", "x.bin", "B")], "package_id string, mask_ref string, path string, asset string")
    assert {(r.package_id, r.mask_ref): r.asset for r in vision.resolve(refs, assets).collect()} == {("p", "m"): "A", ("q", "m"): "B", ("q", "z"): None}
    one, two = (spark.createDataFrame(v, "k long, v string") for v in ([(1, "a"), (2, None)], [(1, "b"), (2, "c"), (3, "d")]))
    assert sorted(tuple(r) for r in vision.prefer(one, two, ["k"], "v").collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_waveform_of_empty_and_silent(spark):
    s = spark.createDataFrame([("a", 0, 0, -0.5), ("a", 0, 1, 0.25)], "clip_id string, i long, ch int, v double")
    assert [(r.bucket, r.lo, r.hi) for r in measures.waveform(s, F.lit(4), 2).orderBy("bucket").collect()] == [(0, -0.5, 0.5), (1, 0.0, 0.0)]
    assert measures.waveform(s.where("false"), F.lit(4), 2).count() == 0
    assert [r.v for r in measures.normalize(s.withColumn("v", F.lit(0.0))).collect()] == [0.0, 0.0]


def test_quality_of_two_sizes(spark):
    r = spark.range(1).select(*[f(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2))).alias(n) for n, f in (("p", measures.psnr), ("s", measures.ssim))], measures.psnr(F.array(F.lit(3)), F.array(F.lit(3))).alias("same")).first()
    assert r.p is None and r.s is None and r.same == float("inf")


def test_resample(spark):
    r = spark.range(1).select(sound.resample(F.array(F.lit(0.0), F.lit(1.0)), 2, 4).alias("up"), sound.resample(F.array(*map(F.lit, (0.0, 1.0, 0.5, 0.5))), 48_000, 24_000, 2).alias("down"), sound.resample(F.expr("cast(array() as array<double>)"), 2, 4).alias("none")).first()
    assert (r.up, r.down, r.none) == ([0.0, 0.5, 1.0, 1.0], [0.0, 1.0], [])


SRT = "1\n00:00:01,000 --> 00:00:02,500\nHello\n\n2\n00:00:03.000 --> 00:00:04,000\nWorld\nagain\n\nbroken\n"
VTT = "﻿WEBVTT\n\nNOTE no cue\n\n00:01.000 --> 00:02.000 align:start\n<b>bold</b> and <i\n\nx\n00:00:03.000 --> 00:00:04.000\nplain"
ASS = "[Script Info]\n[Events]\nFormat: Start, End, Text\nDialogue: 0:00:01.50,0:00:02.00,{\\b1}one\\Ntwo, three\n; note\nDialogue: 0:00:03.00,0:00:04.00,{}\n"


def test_subtitles(spark):
    df = spark.createDataFrame([("a", SRT), ("b", SRT.replace("\n", "\r\n")), ("c", VTT), ("d", ASS), ("e", ""), ("f", None), ("g", "Dialogue: 0,0:00:01.00,0:00:02.00,S,N,0,0,0,,late, text")], "doc string, text string")
    out = {}
    for r in documents.cues(df).collect():
        out.setdefault(r.doc, []).append((r.start, r.end, r.text))
    assert out["a"] == out["b"] == [(1.0, 2.5, "Hello"), (3.0, 4.0, "World\nagain")]
    assert out["c"] == [(1.0, 2.0, "bold and"), (3.0, 4.0, "plain")]
    assert out["d"] == [(1.5, 2.0, "one\ntwo, three")] and out["g"] == [(1.0, 2.0, "late, text")]
    assert "e" not in out and "f" not in out


def test_subtitle_suffix(spark, tmp_path):
    (tmp_path / "a.srt").write_text(SRT)
    assert documents.cues(documents.texts(spark, str(tmp_path / "a.srt")), by_suffix=True).count() == 2
    (tmp_path / "a.txt").write_text(SRT)
    with pytest.raises(PySparkException):
        documents.cues(documents.texts(spark, str(tmp_path / "a.txt")), by_suffix=True).count()


def test_tracks(spark):
    bare = [{"id": "face", "samples": [{"t": 0, "cx": 10, "cy": 20, "radius": 12, "conf": 0.95}, {"t": 1, "x": 0, "y": 0, "w": 40, "h": 20, "conf": 7}, {"t": 2, "left": 0, "top": 0, "right": 30, "bottom": 40, "occlusion": "Occluded"}, {"t": 3}]}]
    df = spark.createDataFrame([("d", json.dumps({"tracks": bare})), ("b", json.dumps(bare)), ("n", None), ("x", "{")], "doc string, text string")
    out = documents.tracks(df)
    rows = [(r.t_us, r.cx, r.cy, r.radius, r.conf, r.occlusion) for r in out.where("doc = 'd'").orderBy("t_us").collect()]
    assert rows == [(0, 10.0, 20.0, 12.0, 0.95, "visible"), (S, 20.0, 10.0, pytest.approx(22.3606797749979), 1.0, "visible"), (2 * S, 15.0, 20.0, 25.0, 1.0, "occluded")]
    assert out.count() == 6
    hidden = vision.mask_samples(out).where("occluded").count()
    assert hidden == 2
    odd = spark.createDataFrame([("d", json.dumps([{"id": "a", "samples": [{"t": 0, "cx": 1, "cy": 1, "occlusion": "foggy"}]}]))], "doc string, text string")
    with pytest.raises(PySparkException):
        documents.tracks(odd).collect()
    assert documents.tracks(odd, strict=False).first().occlusion == "unknown"


def _package(tmp_path, name="p", **change):
    folder = tmp_path / name
    folder.mkdir()
    (folder / "m.bin").write_bytes(bytes(range(16)))
    item = {"mask_ref": "m", "kind": "dense", "width": 4, "height": 4, "path": "m.bin"} | change
    (folder / "manifest.json").write_text(json.dumps({"package_id": name, "masks": [item]}))
    return str(folder)


def test_mask_packages(spark, tmp_path):
    import hashlib

    good = _package(tmp_path, sha256="sha256:" + hashlib.sha256(bytes(range(16))).hexdigest().upper())
    r = documents.mask_packages(spark, good).first()
    assert (r.package_id, r.kind, r.w, r.h, bytes(r.data)) == ("p", "dense", 4, 4, bytes(range(16)))
    for k, bad in enumerate(({"path": "../p/m.bin"}, {"width": 5}, {"path": "none.bin"}, {"sha256": "0" * 64})):
        with pytest.raises(PySparkException):
            documents.mask_packages(spark, _package(tmp_path, f"bad{k}", **bad)).collect()
    assert documents.mask_packages(spark, _package(tmp_path, "cut", x=3)).first().kind == "cropped"


def test_small_parsers(spark):
    df = spark.createDataFrame([("30000/1001", "1/90000", "SMPTE170M"), ("0/0", "x", "odd"), ("25", "0/1", None)], "r string, b string, c string")
    rows = df.select(F.round(parsing.frame_rate(F.col("r")), 3).alias("r"), parsing.time_base(F.col("b")).alias("b"), parsing.colour_space(F.col("c")).alias("c")).collect()
    assert [(x.r, x.b and tuple(x.b), x.c) for x in rows] == [(29.97, (1, 90_000), "bt601"), (None, None, "unspecified"), (25.0, None, "unspecified")]
    assert spark.range(1).select(parsing.varies(F.lit(30.0), F.lit(30.0), F.lit(100), F.lit(10.0)).alias("v")).first().v is True


def test_pack_round_trip(spark):
    s = spark.createDataFrame([("a", 0, 0, 0.5), ("a", 25, 1, -0.25)], "clip_id string, i long, ch int, v double")
    back = documents.unpack(documents.pack(s, 2, 10)).where("v <> 0")
    assert sorted((r.i, r.ch, r.v) for r in back.collect()) == [(0, 0, 0.5), (25, 1, -0.25)]


def test_geometry(spark):
    r = spark.range(1).select(geometry.one_sided(F.lit(1920), F.lit(1080), width=640).alias("a"), geometry.from_box(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("b"), geometry.contributes(F.lit(None).cast("boolean"), F.lit(None).cast("string"), F.lit(None).cast("double")).alias("c"), subtitles.seconds(F.lit("1:02:03,5")).alias("d")).first()
    assert (r.a.w, r.a.h) == (640, 360) and r.b.radius == 1.0 and r.c and r.d == 3723.5
