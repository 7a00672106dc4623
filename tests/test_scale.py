"""Queries over tables that are larger or odder than the driver's small ones."""

import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from lumitide import queries as core
from lumitide import scratch
from lumitide.clips import Clip
from lumitide.kernels import masks
from lumitide.kernels.pictures import Invert
from lumitide.operators import compose, frames
from lumitide.plans import project, run
from lumitide.plans.run import Context, layers
from lumitide.queries import more
from lumitide.sources import documents, generate, write

from .compare import connect, difference


def embeddings(folder, ids):
    """Seeded vectors with these ids."""
    v = np.random.default_rng(3).normal(0, 0.3, (len(ids), 64)).astype(np.float32)
    rows = {"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(list(v), pa.list_(pa.float32())), "label": pa.array([i % 3 for i in ids], pa.int32())}
    pq.write_table(pa.table(rows), f"{folder}/embeddings.parquet")
    return str(folder)


def same(spark, name, folder):
    assert difference(core.queries()[name](spark, folder), connect(folder), core.oracle_sql()[name]) is None


def test_frames_after_ten_thousand_seconds_are_written(spark, tmp_path):
    same(spark, "frames_round_trip", embeddings(tmp_path, [0, 1, 9_999, 10_000, 12_345]))


def test_half_seconds_of_a_sped_up_clip_count_on_the_timeline(spark, tmp_path):
    same(spark, "timeline_run", embeddings(tmp_path, range(6)))
    fast = {"id": "a", "source": {"start": {"ticks": 0, "timescale": 1}, "duration": {"ticks": 3, "timescale": 1}}, "retiming": {"mode": "speed", "factor": 2.0}}
    assert project.record_duration(fast).secs == 1.5


def test_times_of_tracks_are_rounded_as_written(spark):
    text = '[{"id": "a", "samples": [{"t": 2128031.2375, "cx": 1, "cy": 1}, {"t": 2109219.9365, "cx": 1, "cy": 1}, {"t": 0.0004, "cx": 1, "cy": 1}]}]'
    got = documents.tracks(spark.createDataFrame([("d", text)], "doc string, text string"))
    assert sorted(r["t_us"] for r in got.collect()) == [0, 2109219937000, 2128031238000]


def test_compositions_of_many_short_frames_are_gone_through_once(spark):
    n = 30_000
    frames = spark.range(n).selectExpr("'c' AS clip_id", "id * 1000000 AS t_us", "(id + 1) * 1000000 AS e_us", f"{n}000000L AS dur_us", "1 AS w", "1 AS h", "1 AS channels", "unhex(lpad(hex(id % 256), 2, '0')) AS data")
    still = frames.limit(1).selectExpr("clip_id", "0L AS t_us", f"{n}000000L AS e_us", "dur_us", "w", "h", "channels", "unhex('FF') AS data")
    layers = [{"frames": frames, "dur_us": n * 1_000_000, "layer_index": 1, "opacity": 0.5}, {"frames": still, "dur_us": n * 1_000_000, "layer_index": 0}]
    begun = time.time()
    got = compose.compose_frames(layers, 1, 1, 1.0, n * 1_000_000).selectExpr("sum(idx) AS i", "sum(conv(substring(hex(data), 1, 2), 16, 10)) AS v").first()
    want = sum(int((k % 256) * 0.5 + 127.5 + 0.5) for k in range(n))
    assert (got["i"], got["v"]) == (n * (n - 1) // 2, want) and time.time() - begun < 40


def test_a_frame_of_a_composition_is_made_alone(spark):
    n = 12
    frames = spark.range(n).selectExpr("'c' AS clip_id", "id * 1000000 AS t_us", "(id + 1) * 1000000 AS e_us", f"{n}000000L AS dur_us", "1 AS w", "1 AS h", "1 AS channels", "unhex(lpad(hex(id * 20), 2, '0')) AS data")
    clip = Clip(frames, n * 1_000_000, 1, 1, 1.0)
    ctx, specs = Context(spark), {"layers": [{}, {"start": {"ticks": 4, "timescale": 1}, "opacity": 0.25}], "w": None, "h": None, "background": None}
    inner = layers(ctx, [clip, clip], specs)
    outer = layers(ctx, [inner.kernel(Invert()), clip], specs)
    for made in (inner, outer):
        for t in (0, 3_999_999, 9_500_000, 19_000_000):
            want = made.video.where(f"t_us <= {t} AND {t} < e_us").select("idx", "data").collect()
            assert made.frame_at(t).select("idx", "data").collect() == want and len(want) == (t < made.duration_us)
        assert made.part(5_000_000, 5_000_000).count() == 3


def test_a_part_of_a_text_is_drawn_alone():
    for text in ("Hello, wörld", "one\ntwo lines", "x"):
        for size in (8, 16):
            whole = generate.raster(text, size=size)
            for x0, y0, x1, y1 in ((0, 0, 1, 1), (3, 2, 6, 7), (0, 0, whole.shape[1], whole.shape[0]), (whole.shape[1] - 5, whole.shape[0] - 3, whole.shape[1], whole.shape[0])):
                assert (generate.raster(text, size=size, view=(x0, y0, x1, y1)) == whole[y0:y1, x0:x1]).all()


def test_caption_files_are_bounded(spark, monkeypatch):
    files = []
    monkeypatch.setattr(run.documents, "texts", lambda spark, path, texts=documents.texts: files.append(path) or texts(spark, path))
    monkeypatch.setattr(more, "CUES", 10)
    same(spark, "subtitle_burn", "/root/testdata/sf0.001")
    assert documents.texts(spark, files[0]).selectExpr("max(size(split(text, '-->')) - 1) AS n").first()["n"] == 10


def test_fields_of_a_caption_file_are_found_once(spark):
    n = 20_000
    text = "[Events]\nFormat: Start, End, Text\n" + "".join(f"Dialogue: 0:00:{k % 60:02d}.00,0:01:00.50,a{k},b\n" for k in range(n))
    docs = spark.createDataFrame([("d", text), ("e", "Dialogue: 0,0:00:01.00,0:00:02.00,S,,0,0,0,,x,y"), ("f", "[Events]\nFormat: Start\nDialogue: 1")], "doc string, text string")
    begun = time.time()
    got = {(r["doc"], r["nth"]): tuple(r)[2:] for r in documents.cues(docs).collect()}
    assert len(got) == n + 1 and got["d", 61] == (1.0, 60.5, "a61,b") and got["e", 0] == (1.0, 2.0, "x,y") and time.time() - begun < 30


def test_many_clips_of_samples_go_to_few_files(spark, tmp_path):
    at = tmp_path / "samples"
    write.samples(spark.range(500).selectExpr("lpad(id, 4, '0') AS clip_id", "0L AS i", "0 AS ch", "0.5D AS v"), str(at), 1)
    assert len(list(at.rglob("*.parquet"))) <= 8
    got = documents.read_samples(spark, str(at))
    assert got.count() == 500 and got.agg({"clip_id": "min"}).first()[0] == "0000"


def test_planes_are_packed_in_one_pass(spark, tmp_path):
    folder = embeddings(tmp_path, range(5))
    plan = core.queries()["surface_to_rgb"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 3
    same(spark, "surface_to_rgb", folder)


def test_python_holds_few_pictures_at_a_time():
    n = 3000
    b = pa.RecordBatch.from_arrays([pa.array([2] * n), pa.array([2] * n), pa.array([1] * n)], names=["w", "h", "channels"])
    assert max(j - i for i, j in frames._stacks(b)) <= 1024 and sum(j - i for i, j in frames._stacks(b)) == n
    assert [p.num_rows for p in frames._parts(b)] == [1024, 1024, 952]


def test_samples_of_a_document_need_no_python_workers(spark):
    places = [{"t": k, "cx": 1, "cy": 2, **more} for k, more in enumerate(({"subject": "a", "asset": {"asset": {"kind": "rle", "width": 2, "height": 1, "runs": [[1, 0], [1, 255]]}}}, {"subject": 5}, {}))]
    got = run.mask_samples(Context(spark), {"samples": places})
    assert "LocalTableScan" in got._jdf.queryExecution().executedPlan().toString()
    rows = got.orderBy("t_us").collect()
    assert [r["subject"] for r in rows] == ["a", "5", None] and [r["cx"] for r in rows] == [1.0] * 3
    assert rows[0]["asset"]["runs"] == [[1, 0], [1, 255]] and rows[1]["asset"] is None


def test_an_asset_that_rows_repeat_is_decoded_once(monkeypatch):
    made = []
    monkeypatch.setattr(masks, "decode", lambda asset, decode=masks.decode: made.append(asset) or decode(asset))
    asset = lambda k: {"kind": "polygon", "w": None, "h": None, "data": None, "runs": None, "points": [[0.0, 0.0], [k, 0.0], [0.0, k]]}
    once = masks.Decoder()
    assert all((once(asset(k % 3 + 4.0)).data == masks.polygon_box([(0, 0), (k % 3 + 4, 0), (0, k % 3 + 4)]).data).all() for k in range(30)) and len(made) == 3
    assert once(None) is None and (once({"kind": "dense", "w": 2, "h": 1, "left": None, "top": None, "data": b"ab"}).data == [[97, 98]]).all()
    monkeypatch.setattr(masks.Decoder, "KEPT", 1000)
    few = masks.Decoder()
    assert [few(asset(k + 4.0)).data.shape for k in range(9)] == [(k + 4, k + 4) for k in range(9)] and few.size <= 1000


def test_region_lists_that_repeat_are_broadcast_by_their_size_in_memory(spark, tmp_path, monkeypatch):
    folder = embeddings(tmp_path, range(50))
    plan = lambda: core.queries()["redact_polygon"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan()
    monkeypatch.setattr(scratch, "BROADCAST_MEMORY", 50 * 200)
    assert "SortMergeJoin" in plan() and "BroadcastHashJoin" not in plan()
    same(spark, "redact_polygon", folder)
