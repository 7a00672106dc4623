"""Linear plans, graphs, timelines, previews, jobs and the command line."""

import dataclasses
import json

import numpy as np
import pytest

from lumitide import cli
from lumitide.clips import Clip
from lumitide.errors import ContractError, CycleError, DuplicateAsset, DuplicateNode, DuplicateOutput, EngineError, NotExecutable, ParamError, UnknownId, UnknownOperation
from lumitide.mediatime import MediaTime
from lumitide.plans import graph as G
from lumitide.plans import jobs, linear, preview, project, run
from lumitide.plans import registry as R
from lumitide.sources import generate

REG = run.default_registry()


def op(name, operation, *inputs, **params):
    return {"id": name, "body": {"kind": "op", "operation": operation, "params": params}, "inputs": list(inputs)}


def source(name, asset="a"):
    return {"id": name, "body": {"kind": "source", "asset": asset}, "inputs": []}


def doc(*nodes, assets=("a",), last=None, role=None):
    out = last or nodes[-1]["id"]
    return {"version": 1, "assets": [{"id": a, "uri": f"{a}.parquet"} | ({"role": role} if role else {}) for a in assets], "nodes": [*nodes, {"id": "out", "body": {"kind": "output", "name": "main"}, "inputs": [out]}], "outputs": [{"name": "main", "node": "out"}]}


def plan(*ops):
    return linear.Plan.from_json({"version": 1, "source": {"type": "file", "path": "x"}, "ops": list(ops)})


def test_optimizer():
    p = plan({"op": "identity"}, {"op": "crop", "x": 10, "y": 10, "w": 100, "h": 80}, {"op": "crop", "x": 5, "y": 5, "w": 50, "h": 40}, {"op": "h_flip"}, {"op": "h_flip"}, {"op": "scale", "w": 10, "h": 10}, {"op": "scale", "w": 20, "h": 20}, {"op": "custom", "name": "BW"})
    best, st = linear.optimize(p)
    assert [o["op"] for o in best.ops] == ["crop", "scale", "custom"] and best.ops[0] == {"op": "crop", "x": 15, "y": 15, "w": 50, "h": 40} and best.ops[1]["w"] == 20
    assert (st.identities_removed, st.crops_merged, st.flips_cancelled, st.scales_merged, st.eliminated) == (1, 1, 1, 1, 5)
    assert linear.extract(p).fully_native and linear.require_native(p).prefix
    wide = plan({"op": "crop", "x": 0, "y": 0, "w": 10, "h": 10}, {"op": "crop", "x": 5, "y": 0, "w": 10, "h": 10})
    assert len(linear.optimize(wide)[0].ops) == 2
    assert len(linear.optimize(plan(*[{"op": "v_flip"}] * 5))[0].ops) == 1


def test_prefix_and_remainder():
    s = linear.extract(plan({"op": "trim", "start": 0, "duration": 1}, {"op": "custom", "name": "invert"}, {"op": "h_flip"}))
    assert [o["op"] for o in s.prefix] == ["trim"] and len(s.remainder) == 2
    assert linear.filter_text(s.prefix).startswith("trim=")
    with pytest.raises(EngineError):
        linear.require_native(s.plan)
    with pytest.raises(EngineError):
        linear.require_native(plan({"op": "identity"}))
    with pytest.raises(ParamError):
        linear.validate_remainder([{"op": "custom", "name": "sparkle"}])
    for bad in ({"version": 2, "source": {"type": "file", "path": "x"}}, {"version": 1, "source": {"type": "file", "path": " "}}, {"version": 1}, {"version": 1, "source": {"type": "file", "path": "x"}, "ops": [{"op": "spin"}]}):
        with pytest.raises(EngineError):
            linear.Plan.from_json(bad)


def test_graph_validation():
    ok = doc(source("s"), op("t", "transform.hflip", "s"))
    assert G.Graph.from_json(json.dumps(ok)).order() == ["s", "t", "out"]
    assert G.Graph.from_json(G.Graph.from_json(ok).to_json()) == G.Graph.from_json(ok)
    twice = doc(source("s"), op("c", "timeline.concat", "s", "s"))
    assert "c" in G.Graph.from_json(twice).order()
    for error, bad in (
        (UnknownId, doc(source("s"), op("t", "transform.hflip", "no"))), (UnknownId, doc(source("s", "no"))), (CycleError, doc(source("s"), op("t", "transform.hflip", "u"), op("u", "transform.hflip", "t"))), (DuplicateNode, doc(source("s"), source("s"))),
        (DuplicateAsset, doc(source("s"), assets=("a", "a"))), (DuplicateOutput, ok | {"outputs": ok["outputs"] * 2}), (EngineError, ok | {"version": 0}), (EngineError, {"version": 1, "nodes": [{"id": 1}]}),
    ):
        with pytest.raises(error) as e:
            G.Graph.from_json(bad)
        assert str(e.value).startswith("[LT_")


@pytest.mark.parametrize(
    ("error", "node"),
    [
        (UnknownOperation, op("t", "transform.spin", "s")), (ParamError, op("t", "transform.trim", "s")), (ParamError, op("t", "transform.speed", "s", factor=0)), (ParamError, op("t", "transform.crop", "s", w=1)), (ParamError, op("t", "transform.loop", "s")),
        (ParamError, op("t", "transform.rotate", "s", mode="degrees")), (ParamError, op("t", "transform.freeze", "s", at=1)), (ParamError, op("t", "redaction.region", "s", style="solid")), (ContractError, op("t", "timeline.concat", "s")), (ContractError, op("t", "transform.hflip", "s", "s")), (ContractError, op("t", "transform.hflip")),
    ],
)
def test_compile_errors(error, node):
    with pytest.raises(error):
        G.compile_graph(G.Graph.from_json(doc(source("s"), node)), REG)


def test_contracts():
    c = lambda *n, **k: G.compile_graph(G.Graph.from_json(doc(*n, **k)), REG).nodes[-1].output
    assert c(source("s"), op("d", "audio.drop", "s")) == R.Contract(True, False)
    assert c(source("s"), op("v", "adapter.anything", "s")) == R.Contract(True, True, True)
    assert c(source("s"), op("e", "encode.h264", "s", preserve_audio=False)) == R.Contract(True, False)
    assert c(source("s"), op("d", "audio.drop", "s"), op("c", "timeline.concat", "d", "s")) == R.Contract(True, False)
    with pytest.raises(ContractError):
        c(source("s"), op("f", "transform.hflip", "s"), role="audio")
    with pytest.raises(ContractError):
        c(source("s"), op("d", "audio.drop", "s"), op("m", "audio.mix", "d"))


def test_registry():
    assert len(REG.ids()) == 29
    for name in REG.ids():
        assert REG.executable(f"vendor.{name}").id == name
    assert REG.get("vendor.adapter.somebody").id == "adapter.tracks"
    own = R.Registry().register(R.Descriptor("transform.demo", "kernel", R.nothing))
    with pytest.raises(NotExecutable):
        own.executable("transform.demo")


def test_schedule_and_fingerprints():
    nodes = [source("s"), op("a", "transform.hflip", "s"), op("b", "color.invert", "a"), op("c", "adapter.x", "b"), op("d", "gpu.passthrough", "c")]
    g = G.Graph.from_json(doc(*nodes))
    c = G.compile_graph(g, REG)
    stages = G.schedule(c).stages
    assert [s.backend for s in stages] == ["native", "kernel", "adapter", "device", "native"]
    assert stages[0].ids == ("s", "a") and stages[1].inputs == (stages[0].nodes[1],)
    shuffled = dataclasses.replace(g, nodes=g.nodes[::-1])
    assert G.fingerprint(G.compile_graph(shuffled, REG)) == G.fingerprint(c)
    changed = G.Graph.from_json(doc(*nodes[:2], op("b", "color.painting", "a"), *nodes[3:]))
    one, two = G.stage_keys(c), G.stage_keys(G.compile_graph(changed, REG))
    assert one[0] == two[0] and all(x != y for x, y in zip(one[1:], two[1:]))
    assert "stage 0 [native]" in G.explain(g, REG)


def clip(spark, n=10, fps=10.0, w=8, h=6):
    return Clip(generate.gradient(spark, n, w, h, fps), round(n * 1e6 / fps), w, h, fps)


def values(df, x=0, y=0, c=0):
    out = {}
    for r in df.collect():
        out[r.idx] = int(np.frombuffer(r.data, np.uint8).reshape(r.h, r.w, r.channels)[y, x, c])
    return [out[k] for k in sorted(out)]


def materialize(spark, d, **seeds):
    ctx = run.Context(spark, seeds)
    return run.materialize(ctx, G.Graph.from_json(d))["main"]


def test_retiming_graph(spark):
    d = doc(source("s"), op("t", "transform.trim", "s", start=0.2, duration=0.4), op("x", "transform.speed", "t", factor=2.0), op("l", "transform.loop", "x", times=2))
    out = materialize(spark, d, a=clip(spark))
    assert out.duration_us == 400_000 and values(out.sampled(10.0)) == [2, 4, 2, 4]
    frozen = materialize(spark, doc(source("s"), op("f", "transform.freeze", "s", at=0.1, hold={"ticks": 3, "timescale": 10})), a=clip(spark, 4))
    assert values(frozen.sampled(10.0)) == [0, 1, 1, 1, 1, 2, 3]
    with pytest.raises(ParamError):
        materialize(spark, doc(source("s"), op("t", "transform.trim", "s", duration=99)), a=clip(spark))


def test_fade_of_a_held_picture(spark):
    still = Clip(generate.solid(spark, 4, 4, (200, 200, 200), 1_000_000), 1_000_000, 4, 4, 10.0)
    out = materialize(spark, doc(source("s"), op("f", "transform.fade_in", "s", duration=0.5), op("z", "transform.speed", "f", factor=0.5)), a=still)
    got = values(out.sampled(5.0))
    assert got[0] == 0 and got[1] == 39 and got[-1] == 200 and len(got) == 10


def test_compose_concat_mix(spark):
    red, blue = (Clip(generate.solid(spark, 4, 4, v, 1_000_000), 1_000_000, 4, 4, 10.0) for v in ((255, 0, 0), (0, 0, 255)))
    layers = [{"layer_index": 1, "start": 0.5}, {"layer_index": 0}]
    d = doc(source("s"), source("t", "b"), op("c", "compose.layers", "s", "t", layers=layers, w=4, h=4), assets=("a", "b"))
    out = materialize(spark, d, a=red, b=blue)
    assert out.duration_us == 1_500_000 and values(out.sampled(2.0)) == [0, 255, 255] and values(out.sampled(2.0), c=2) == [255, 0, 0]
    cat = materialize(spark, doc(source("s"), source("t", "b"), op("c", "timeline.concat", "s", "t"), assets=("a", "b")), a=red, b=blue)
    assert values(cat.sampled(1.0)) == [255, 0]
    tone = generate.tone(spark, 1.0, 8, 1_000_000).withColumn("v", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(0.75))
    both = [c.replace(audio=tone, rate=8, channels=1) for c in (red, blue)]
    mixed = materialize(spark, doc(source("s"), source("t", "b"), op("m", "audio.mix", "s", "t", tracks=[{}, {"start": 0.5}]), op("g", "audio.gain", "m", factor=2), assets=("a", "b")), a=both[0], b=both[1])
    assert sorted((r.i, r.v) for r in mixed.audio.collect())[3:5] == [(3, 1.5), (4, 2.0)]


def test_redaction_and_adapter(spark):
    white = Clip(generate.solid(spark, 32, 32, (250, 250, 250), 1_000_000), 1_000_000, 32, 32, 4.0)
    masks = {"samples": [{"t": 0, "cx": 8, "cy": 8, "radius": 4}, {"t": 1, "cx": 24, "cy": 8, "radius": 4}]}
    node = {"id": "r", "body": {"kind": "redaction", "redaction": {"masks": masks, "style": {"kind": "solid"}}}, "inputs": ["s"]}
    out = materialize(spark, doc(source("s"), node), a=white).sampled(4.0)
    assert values(out, 8, 8) == [0, 250, 250, 250] and values(out, 16, 8)[2] == 0 and values(out, 8, 30) == [250] * 4
    tracks = {"tracks": [{"id": "face", "samples": [{"t": 0, "cx": 8, "cy": 8, "radius": 4}]}]}
    via = materialize(spark, doc(source("s"), op("v", "adapter.any", "s", tracks=tracks), op("r", "redaction.region", "v")), a=white)
    assert values(via.sampled(2.0), 8, 8)[0] >= 249  # blurred white stays white
    with pytest.raises(ParamError):
        materialize(spark, doc(source("s"), op("r", "redaction.region", "s")), a=white)


def test_subtitles(spark, tmp_path):
    (tmp_path / "c.srt").write_text("00:00:00,500 --> 00:00:01,000\nI\n")
    black = Clip(generate.solid(spark, 40, 60, (0, 0, 0), 2_000_000), 2_000_000, 40, 60, 2.0)
    d = doc(source("s"), op("b", "subtitle.burn", "s", cues=[{"uri": str(tmp_path / "c.srt"), "start": 0.5, "in": 0, "duration": 2}]))
    out = materialize(spark, d, a=black).sampled(2.0).collect()
    assert [sum(r.data) > 0 for r in sorted(out, key=lambda r: r.idx)] == [False, False, True, False]


def test_linear_execution(spark):
    p = plan({"op": "trim", "start": 0.1, "duration": 0.3}, {"op": "h_flip"}, {"op": "custom", "name": "negate"}, {"op": "custom", "name": "multiply", "params": {"factor": 1.0}})
    assert values(linear.execute(run.Context(spark), p, clip(spark)).sampled(10.0)) == [255 - 8, 255 - 9, 255 - 10]
    blur = plan({"op": "custom", "name": "face_blur", "params": {"tracks": [{"samples": [{"t": 0, "cx": 2, "cy": 2, "radius": 2}]}]}})
    assert linear.execute(run.Context(spark), blur, clip(spark, 2)).sampled(10.0).count() == 2
    many = plan({"op": "custom", "name": "head_blur", "params": {"tracks": [{"id": k, "samples": [{"t": 0, "cx": 2, "cy": 2, "radius": 2}]} for k in "ab"]}})
    assert linear.execute(run.Context(spark), many, clip(spark, 2)).sampled(10.0).count() == 2
    with pytest.raises(ParamError):
        linear.execute(run.Context(spark), plan({"op": "custom", "name": "redaction"}), clip(spark))
    assert "prefix:" in linear.explain(p)


def ms(n):
    return {"ticks": n, "timescale": 1000}


def item(name, start, length, **more):
    return {"kind": "clip", "id": name, "media": "m", "source": {"start": ms(start), "duration": ms(length)}} | more


def timeline(*tracks, sequences=(), **more):
    return {"version": 1, "id": "p", "name": "p", "media": [{"id": "m", "uri": "m.parquet"}], "sequences": [{"id": "main", "name": "main", "tracks": list(tracks)} | more.pop("main", {}), *sequences]} | more


def video(*items, **more):
    return {"id": "v", "kind": "video", "items": list(items)} | more


def ops(c):
    return [n.operation or n.kind for n in c.graph.nodes]


def test_timeline():
    c = project.compile_project(timeline(video(item("a", 0, 2000))))
    assert ops(c) == ["source", "transform.trim", "output"] and not c.warnings
    c = project.compile_project(timeline(video({"kind": "gap", "duration": ms(1500)}, item("a", 0, 2000))))
    comp = next(n for n in c.graph.nodes if n.operation == "compose.layers")
    assert comp.params["layers"][0]["start"] == ms(1500)
    freeze = item("a", 0, 2000, retiming={"mode": "freeze", "at": ms(500), "hold": ms(1000)})
    twice = item("b", 0, 2000, retiming={"mode": "loop", "times": 2})
    fast = item("d", 2000, 3000, retiming={"mode": "speed", "factor": 2.0}, transition_in={"kind": "dissolve", "duration": ms(250)})
    crop = item("c", 0, 1000, crop={"x": 80, "y": 45, "w": 160, "h": 90}, scale_to=[320, 180])
    c = project.compile_project(timeline(video(freeze, twice, fast, crop)))
    starts = [x["start"]["ticks"] for x in next(n for n in c.graph.nodes if n.operation == "compose.layers").params["layers"]]
    assert starts == [0, 3000, 6750, 8250]
    assert {"transform.freeze", "transform.loop", "transform.speed", "transform.fade_out", "transform.even_dims", "transform.scale"} <= set(ops(c))
    G.compile_graph(c.graph, REG)
    assert project.record_duration(fast) == (1500, 1000) and project.record_duration(freeze) == (3000, 1000)


def test_timeline_parts():
    insert = {"id": "insert", "name": "insert", "tracks": [video(item("n", 0, 700))]}
    sound = {"id": "s", "kind": "audio", "items": [{"kind": "gap", "duration": ms(100)}, item("w", 0, 400)]}
    words = {"id": "t", "kind": "subtitle", "items": [item("cap", 100, 400)]}
    wipe = item("x", 0, 1000, transition_in={"kind": "wipe", "duration": ms(200)})
    c = project.compile_project(timeline(video(item("a", 0, 1000), {"kind": "nested", "sequence": "insert"}, wipe), sound, words, video(item("q", 0, 1), id="v2", muted=True), sequences=[insert], semantic=[{"kind": "subject", "id": "face"}, {"kind": "query", "id": "q1"}], markers=[{"t": ms(0), "name": "x"}]))
    comp = next(n for n in c.graph.nodes if n.operation == "compose.layers")
    assert [x["start"]["ticks"] for x in comp.params["layers"]] == [0, 1000, 1500]
    assert len(c.warnings) == 3 and {"audio.drop", "audio.mix", "subtitle.burn", "adapter.tracks", "redaction", "transform.slide_in"} <= set(ops(c))
    mix = next(n for n in c.graph.nodes if n.operation == "audio.mix")
    assert mix.params["tracks"][1]["start"] == ms(100)
    vision = next(n for n in c.graph.nodes if n.operation == "adapter.tracks")
    assert vision.params["subjects"] == ["face"] and vision.params["query"] == ["q1"]
    loop = {"id": "insert", "name": "i", "tracks": [video({"kind": "nested", "sequence": "insert"})]}
    for bad in (timeline(video({"kind": "nested", "sequence": "insert"}), sequences=[loop]), timeline(video()), timeline(video(item("a", 0, 1) | {"media": "no"})), {"version": 2}, timeline(video(item("a", 0, 1)), active_sequence="no"), timeline(video(item("a", 0, 1, retiming={"mode": "loop"}))), {"version": 0, "sequences": []}):
        with pytest.raises(EngineError):
            project.compile_project(bad)
    assert project.load({"version": 0})["version"] == 1


def test_preview(spark):
    d = doc(source("s"), source("t", "b"), op("c", "compose.layers", "s", "t", layers=[{}, {"start": 5.0}]), op("e", "encode.h264", "c"), assets=("a", "b"))
    g = G.Graph.from_json(d)
    early = preview.plan(g, MediaTime(0, 1000))
    assert early.bypass == ("e",) and "t" in early.skip and len(early.graph.assets) == 1
    assert next(n for n in early.graph.nodes if n.id == "out").inputs == ("c",)
    late = preview.plan(g, MediaTime(6000, 1000))
    assert not late.skip and len(late.graph.assets) == 2
    assert preview.proxy_size(1920, 1080, 640, 360) == (640, 360) and preview.proxy_size(100, 51, 640, 360) == (100, 50) and preview.output_size(9, 9, "full") == (9, 9)
    shot, row = preview.frame(run.Context(spark, {"a": clip(spark, w=640, h=360)}), G.Graph.from_json(doc(source("s"), op("i", "color.invert", "s"))), MediaTime(300, 1000), "draft")
    assert (shot.w, shot.h) == (320, 180) and row.first().w == 320
    with pytest.raises(EngineError):
        preview.plan(G.Graph(), MediaTime(0, 1))


def test_jobs(spark, tmp_path):
    store = jobs.Store(spark, f"file://{tmp_path}/jobs")
    ctx = run.Context(spark, {"a": clip(spark)})
    job = store.submit(G.Graph.from_json(doc(source("s"), op("i", "color.invert", "s"))))
    assert store.list() == [job.id] and store.load(job.id).state == "queued"
    cancel = jobs.Cancel()
    cancel.cancel()
    out = f"file://{tmp_path}/out"
    assert jobs.run(ctx, store, job, out, cancel).state == "paused"
    seen = []
    done = jobs.run(ctx, store, store.load(job.id), out, progress=lambda *x: seen.append(x))
    assert done.state == "done" and seen == [("main", 1, 1)] and values(jobs.outputs(ctx, done)["main"])[0] == 255
    again = []
    assert jobs.run(ctx, store, store.load(job.id), out, progress=lambda *x: again.append(x)).state == "done" and not again
    job.graph = doc(source("s"), op("i", "transform.trim", "s", duration=99.0))
    with pytest.raises(ParamError):
        jobs.run(ctx, store, job, out)
    assert store.load(job.id).state == "failed" and "beyond" in store.load(job.id).error
    with pytest.raises(EngineError):
        store.load("none")
    assert jobs.manifest(G.Graph.from_json(doc(source("s"))))["outputs"][0]["name"] == "main"
    cache = jobs.StageCache(spark, out)
    assert cache.first_invalid(["none"]) == 0


def test_cli(spark, tmp_path, capsys):
    assert cli.main(["version"]) == 0 and capsys.readouterr().out.strip() == cli.VERSION
    src = str(tmp_path / "in")
    generate.gradient(spark, 10, 8, 6, 10.0).write.parquet(src)
    assert cli.main(["probe", src]) == 0 and json.loads(capsys.readouterr().out)["fps"] == 10.0
    assert cli.main(["cut", src, str(tmp_path / "cut"), "--start", "0.2", "--duration", "0.3"]) == 0
    assert spark.read.parquet(str(tmp_path / "cut")).count() == 3
    assert cli.main(["cut", src, str(tmp_path / "no"), "--duration", "-1"]) == 2 and "INVALID_PARAMS" in capsys.readouterr().err
    assert cli.main(["filter", src, str(tmp_path / "no"), "--width", "3"]) == 2
    assert cli.main(["filter", src, str(tmp_path / "small"), "--width", "4", "--height", "2", "--grey"]) == 0
    assert spark.read.parquet(str(tmp_path / "small")).first().w == 4
    (tmp_path / "p.json").write_text(json.dumps({"version": 1, "source": {"type": "file", "path": src}, "ops": [{"op": "h_flip"}]}))
    assert cli.main(["plan", str(tmp_path / "p.json"), "--run", str(tmp_path / "planned")]) == 0
    g = doc(source("s"), op("i", "color.invert", "s"))
    g["assets"][0]["uri"] = src
    (tmp_path / "g.json").write_text(json.dumps(g))
    assert cli.main(["graph", str(tmp_path / "g.json"), "--run", str(tmp_path / "made")]) == 0
    assert spark.read.parquet(str(tmp_path / "made/main")).count() == 10
    assert cli.main(["preview", str(tmp_path / "g.json"), str(tmp_path / "x.png"), "--at", "0.1"]) == 0 and (tmp_path / "x.png").read_bytes().startswith(b"\x89PNG")
    (tmp_path / "t.json").write_text(json.dumps(timeline(video(item("a", 0, 2000)), markers=[{"name": "x"}])))
    assert cli.main(["project", str(tmp_path / "t.json")]) == 0 and "warning" in capsys.readouterr().err
