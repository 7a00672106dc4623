"""Redaction by assets, packages, retimed sound, captions, picture files, seals and stages of jobs."""

import json

import numpy as np
import pytest

from lumitide.clips import Clip
from lumitide.errors import ContractError, MediaError, ParamError
from lumitide.kernels import masks as M
from lumitide.operators import frames as FR
from lumitide.operators import timing, vision
from lumitide.plans import graph as G
from lumitide.plans import jobs, run
from lumitide.sources import documents, generate, write


def graph(*nodes, uri="seed"):
    made = [{"id": "s", "body": {"kind": "source", "asset": "a"}, "inputs": []}, *nodes]
    return {"version": 1, "assets": [{"id": "a", "uri": uri}], "outputs": [{"name": "main", "node": "out"}], "nodes": [*made, {"id": "out", "body": {"kind": "output", "name": "main"}, "inputs": [made[-1]["id"]]}]}


def op(name, operation, source, **params):
    return {"id": name, "body": {"kind": "op", "operation": operation, "params": params}, "inputs": [source]}


def hide(samples, **style):
    return {"id": "r", "body": {"kind": "redaction", "redaction": {"masks": {"samples": samples}, "style": {"kind": "solid", **style}}}, "inputs": ["s"]}


def made(spark, doc, clip, **context):
    return run.materialize(run.Context(spark, {"a": clip}, **context), G.Graph.from_json(doc))["main"]


def pictures(df):
    rows = df.orderBy("t_us").collect()
    return np.stack([np.frombuffer(r.data, np.uint8).reshape(r.h, r.w, r.channels) for r in rows])


@pytest.fixture(scope="module")
def white(spark):
    return Clip(generate.solid(spark, 16, 12, (250, 250, 250), 4_000_000), 4_000_000, 16, 12, 1.0)


def asset(kind, **facts):
    return {"asset": {"kind": kind, **facts}}


def test_assets_decode_alike():
    inside = np.zeros((12, 16), np.uint8)
    inside[2:6, 3:9] = 255
    runs = [(35, 0), (6, 255), (10, 0), (6, 255), (10, 0), (6, 255), (10, 0), (6, 255), (103, 0)]
    empty = dict.fromkeys(("kind", "w", "h", "left", "top", "data", "runs", "points"))
    kinds = [
        {**empty, "kind": "dense", "w": 16, "h": 12, "data": inside.tobytes()}, {**empty, "kind": "cropped", "w": 6, "h": 4, "left": 3, "top": 2, "data": b"\xff" * 24},
        {**empty, "kind": "rle", "w": 16, "h": 12, "runs": runs}, {**empty, "kind": "polygon", "points": [(3, 2), (9, 2), (9, 6), (3, 6)]},
    ]
    for a in kinds:
        c = M.decode(a)
        full = np.array([[c.sample(x, y) for x in range(16)] for y in range(12)])
        assert (full * 255 == inside).all(), a["kind"]
    assert M.decode(None) is None and M.decode({**empty, "kind": "external"}) is None
    for bad in ({**empty, "kind": "cloud"}, {**empty, "kind": "dense", "w": 2, "h": 2, "data": b"x"}, {**empty, "kind": "rle", "w": 2, "h": 2, "runs": [(3, 0)]}, {**empty, "kind": "polygon", "points": [(0, 0), (1, 1)]}, {**empty, "kind": "polygon", "points": [(0, 0), (1, float("nan")), (2, 2)]}):
        with pytest.raises(MediaError):
            M.decode(bad)


def test_what_a_polygon_covers_beyond_the_disc_is_hidden(spark, white):
    points = [[0, 0], [16, 0], [16, 6], [0, 6]]
    doc = graph(hide([{"t": 0, "subject": "p", "cx": 4, "cy": 3, "radius": 1, "asset": asset("polygon", points=points)}], color={"r": 1, "g": 2, "b": 3, "a": 255}))
    px = pictures(made(spark, doc, white).sampled(1.0))
    assert (px[:, :6] == [1, 2, 3]).all() and (px[:, 6:] == 250).all()


def test_coverage_holds_until_the_next_and_the_first_before(spark, white):
    box = lambda l: asset("cropped", left=l, top=0, width=2, height=2, data=[255] * 4)
    samples = [{"t": 0, "subject": "p", "cx": 1, "cy": 1}, {"t": 1, "subject": "p", "cx": 1, "cy": 1, "asset": box(4)}, {"t": 2, "subject": "p", "cx": 1, "cy": 1}, {"t": 3, "subject": "p", "cx": 1, "cy": 1, "asset": box(10)}]
    px = pictures(made(spark, graph(hide(samples)), white).sampled(1.0))
    assert [np.flatnonzero((p[0] == 0).all(-1)).tolist() for p in px] == [[4, 5], [4, 5], [4, 5], [10, 11]]


def test_redaction_runs_pictures_once_and_joins_no_ids(spark, white):
    doc = graph(op("i", "color.invert", "s"), {**hide([{"t": 0, "cx": 4, "cy": 4, "radius": 3}]), "inputs": ["i"]})
    plan = made(spark, doc, white).video._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_redaction_errors(spark, white):
    for samples, error in (([{"t": 0, "cx": 1, "cy": 1, "occluded": True}], ContractError), ([{"t": 0, "cx": 1, "cy": 1, "asset": asset("dense", width=3, height=3, data=[1])}], ParamError), ([{"t": 0, "cx": 1, "cy": 1, "conf": 0.0}], ContractError)):
        with pytest.raises(error):
            made(spark, graph(hide(samples)), white)


def test_many_subjects_and_clips(spark):
    """Fifty subjects in a grid on each of two clips: all are filled, and the background stays."""
    still = generate.solid(spark, 100, 50, (250, 250, 250), 1_000_000, "a").unionByName(generate.solid(spark, 100, 50, (200, 200, 200), 1_000_000, "b"))
    clip = Clip(still, 1_000_000, 100, 50, 1.0)
    samples = [{"t": 0, "subject": f"s{k}", "cx": 5 + 10 * (k % 10), "cy": 5 + 10 * (k // 10), "radius": 3} for k in range(50)]
    rows = made(spark, graph(hide(samples)), clip).sampled(1.0).collect()
    assert sorted(r.clip_id for r in rows) == ["a", "b"]
    for r in rows:
        px = np.frombuffer(r.data, np.uint8).reshape(50, 100, 3)
        assert all((px[5 + 10 * j, 5 + 10 * i] == 0).all() for i in range(10) for j in range(5)) and (px[0, 0] == (250 if r.clip_id == "a" else 200)).all()


def package(tmp_path, package_id="pk", **wrong):
    blob = np.zeros((12, 16), np.uint8)
    blob[4:8, 6:10] = 255
    (tmp_path / "blobs").mkdir(parents=True)
    (tmp_path / "blobs/m.bin").write_bytes(blob.tobytes())
    tracks = [{"id": "t", "subject": "p", "samples": [{"t": 0.0, "cx": 2, "cy": 2, "radius": 1, "mask": {"observation": "7", "uri": "blobs/m.bin"}}]}]
    masks = [{"mask_ref": "7", "kind": "dense", "width": 16, "height": 12, "path": "blobs/m.bin", **wrong}]
    (tmp_path / "manifest.json").write_text(json.dumps({"package_id": package_id, "tracks": tracks, "masks": masks}))
    return str(tmp_path)


def test_mask_packages(spark, white, tmp_path):
    doc = graph(op("v", "adapter.tracks", "s", package_id="pk"), op("r", "redaction.region", "v"))
    folder = package(tmp_path / "good")
    at = run.package_masks(run.Context(spark, package=folder), "pk").collect()
    assert [(r.subject, r.asset.kind, r.asset.w, bytes(r.asset.data).count(255)) for r in at] == [("p", "dense", 16, 16)]
    px = pictures(made(spark, doc, white.replace(video=generate.gradient(spark, 4, 16, 12, 1.0)), package=folder).sampled(1.0))
    plain = pictures(generate.gradient(spark, 4, 16, 12, 1.0))
    changed = (px != plain).any((0, 3))
    assert changed[4:8, 6:10].any() and not changed[:4].any() and not changed[8:].any() and not changed[:, :6].any()
    with pytest.raises(MediaError):
        made(spark, doc, white, package=package(tmp_path / "other", "other"))


def test_speed_takes_sound_along(spark):
    sound = spark.range(100).selectExpr("'c' AS clip_id", "id AS i", "0 AS ch", "cast(id as double) AS v")
    clip = Clip(None, 1_000_000, audio=sound, rate=100)
    for factor, n in ((2.0, 50), (0.5, 200), (3.0, 34)):
        out = made(spark, graph(op("f", "transform.speed", "s", factor=factor)), clip)
        rows = sorted((r.i, r.v) for r in out.audio.collect())
        assert rows == [(i, float(int(i * factor))) for i in range(n)] and out.duration_us == round(1_000_000 / factor)
    assert [r.v for r in timing.mirror_samples(sound, 100).orderBy("i").collect()] == [float(99 - k) for k in range(100)]
    with pytest.raises(ParamError):
        timing.speed_samples(sound, 0.0)


def test_captions_are_one_relation(spark, tmp_path):
    times = lambda s: f"00:00:{s:02d},000"
    (tmp_path / "c.srt").write_text("\n".join(f"{k}\n{times(k % 60)} --> {times(k % 60 + 1)}\nI\n" for k in range(40)))
    black = Clip(generate.solid(spark, 32, 40, (0, 0, 0), 60_000_000), 60_000_000, 32, 40, 1.0)
    out = made(spark, graph(op("b", "subtitle.burn", "s", cues=[{"uri": str(tmp_path / "c.srt"), "in": 0, "duration": 60, "start": 0}])), black)
    assert len(out.video._jdf.queryExecution().logical().toString()) < 20_000
    px = pictures(out.pictures())
    assert [bool(p.any()) for p in px] == [k < 40 for k in range(60)] and (out.w, out.h) == (32, 40)


def test_picture_files(spark, tmp_path):
    px = np.arange(5 * 4 * 3, dtype=np.uint8).reshape(4, 5, 3)
    (tmp_path / "a.png").write_bytes(write.png(px))
    (tmp_path / "b.png").write_bytes(write.png(np.dstack([px, np.full((4, 5), 9, np.uint8)])))
    (tmp_path / "no.png").write_bytes(b"no picture")
    rows = documents.read_images(spark, str(tmp_path), 2_000_000).orderBy("clip_id").collect()
    assert [(r.w, r.h, r.channels, r.dur_us) for r in rows] == [(5, 4, 3, 2_000_000), (5, 4, 4, 2_000_000)]
    assert bytes(rows[0].data) == px.tobytes() and (np.frombuffer(rows[1].data, np.uint8).reshape(4, 5, 4)[..., :3] == px).all()
    with pytest.raises(MediaError):
        documents.read_images(spark, str(tmp_path), 0)


def test_proxies_and_seals(spark, tmp_path):
    at = str(tmp_path / "proxy")
    assert write.proxy(generate.gradient(spark, 4, 64, 36, 2.0), at, 2.0, (32, 32)) == (32, 18)
    assert write.proxy(generate.gradient(spark, 1, 7, 5, 2.0), str(tmp_path / "small"), 2.0) == (6, 4)
    sealed = spark.createDataFrame(jobs.seal(spark, at).collect())
    files = [r.file for r in sealed.collect()]
    assert files and all(len(r.sha256) == 64 and not r.file.startswith("/") for r in sealed.collect()) and jobs.broken(spark, at, sealed).count() == 0
    for crc in (tmp_path / "proxy").rglob("*.crc"):
        crc.unlink()
    (tmp_path / "proxy" / next(f for f in files if f.endswith(".parquet"))).write_bytes(b"x")
    (tmp_path / "proxy/more.parquet").write_bytes(b"y")
    assert sorted(r.why for r in jobs.broken(spark, at, sealed).collect()) == ["changed", "new"]


def test_a_resumed_job_goes_on_after_its_last_stage(spark, tmp_path):
    clip = Clip(generate.gradient(spark, 4, 8, 6, 1.0), 4_000_000, 8, 6, 1.0)
    doc = graph(op("i", "color.invert", "s"), op("v", "adapter.tracks", "i", masks=[{"t": 0, "cx": 4, "cy": 3, "radius": 2}]), op("r", "redaction.region", "v"), op("g", "gpu.passthrough", "r"), op("h", "transform.hflip", "g"))
    store, out = jobs.Store(spark, f"file://{tmp_path}/jobs"), f"file://{tmp_path}/out"
    job = store.submit(G.Graph.from_json(doc))
    cache, c = jobs.StageCache(spark, out), G.compile_graph(G.Graph.from_json(doc), run.default_registry())
    reads = []

    class Counting(jobs.StageCache):
        def put(self, key, df):
            reads.append(self.hit(key))
            return super().put(key, df)

    keep = jobs.keeper(Counting(spark, out), c, jobs.Cancel())
    first = run.materialize(run.Context(spark, {"a": clip}), c, keep=keep)["main"]
    assert reads and not any(reads)
    reads.clear()
    again = run.materialize(run.Context(spark, {"a": clip}), c, keep=keep)["main"]
    assert reads and all(reads) and (pictures(first.pictures()) == pictures(again.pictures())).all()
    straight = run.materialize(run.Context(spark, {"a": clip}), c)["main"]
    done = jobs.run(run.Context(spark, {"a": clip}), store, job, out)
    assert done.state == "done" and (pictures(jobs.outputs(run.Context(spark), done)["main"]) == pictures(straight.sampled(1.0))).all()
    stage = next(k for k, st in enumerate(G.schedule(c).stages) if "r" in st.ids)
    assert cache.hit(G.fingerprint([G.stage_keys(c)[stage], "r", "video"]))


def test_regions_by_clip_or_for_all(spark):
    frames = generate.gradient(spark, 2, 4, 4, 1.0, "a").unionByName(generate.gradient(spark, 2, 4, 4, 1.0, "b"))
    one = "0.0D AS cx, 0.0D AS cy, 1.0D AS radius, 1.0D AS conf, 'active' AS lifecycle, false AS occluded"
    by = spark.sql(f"SELECT 'a' AS clip_id, 's' AS subject, 0L AS t_us, {one}")
    got = {(r.clip_id, r.t_us): len(r.regions or []) for r in vision.with_regions(frames, by).collect()}
    assert got == {("a", 0): 1, ("a", 1_000_000): 1, ("b", 0): 0, ("b", 1_000_000): 0}
    assert all(len(r.regions) == 1 for r in vision.with_regions(frames, by.drop("clip_id"), clips=False).collect())


def test_stills_go_through_kernels_once_and_sample_alike(spark, monkeypatch):
    from lumitide.kernels import pictures as K

    still = generate.still(spark, bytes(range(96)), 8, 4, 2_000_000)
    chain = (K.Crop(0, 0, 4, 4), K.HFlip(), K.Fade(1.0), K.Invert())
    plain = pictures(FR.apply(timing.to_grid(still, 5.0), chain))
    for limit in (timing.PICTURE_BYTES, 1):
        monkeypatch.setattr(timing, "PICTURE_BYTES", limit)
        clip = Clip(still, 2_000_000, 8, 4)
        for k in chain:
            clip = clip.kernel(k)
        rows = clip.sampled(5.0)
        assert rows.count() == 10 and (pictures(rows) == plain).all() and rows.orderBy("idx").first().idx == 0


def test_composition_by_stretches(spark, monkeypatch):
    from lumitide.operators import compose

    moving = generate.gradient(spark, 7, 6, 4, 7.0)
    layers = [{"frames": moving, "dur_us": 1_000_000, "start_us": 200_000}, {"frames": generate.solid(spark, 3, 2, (9, 8, 7), 500_000), "dur_us": 500_000, "start_us": 700_000, "x": 2, "y": 1, "opacity": 0.5}]
    made = []
    for most in (1, 4 * 6 * 3 * 5, 1 << 24):
        monkeypatch.setattr(compose, "STRETCH_BYTES", most)
        rows = compose.compose_frames(layers, 6, 4, 10.0, 1_500_000, (1, 2, 3)).orderBy("idx").collect()
        assert [r.idx for r in rows] == list(range(15))
        made.append([bytes(r.data) for r in rows])
    assert made[0] == made[1] == made[2]
    first = np.frombuffer(made[0][0], np.uint8).reshape(4, 6, 3)
    assert (first == [1, 2, 3]).all() and made[0][2] != made[0][0] and made[0][8] != made[0][7]
