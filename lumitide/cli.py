"""Command line: version, probe, cut, filter, plan, graph, project, preview."""

from __future__ import annotations

import argparse
import json
import math
import sys

VERSION = "0.1.0"


def _session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("lumitide").getOrCreate()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "32")
    return spark


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("lumitide", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    q = sub.add_parser("probe", help="facts of a Parquet clip")
    q.add_argument("input")
    q = sub.add_parser("cut")
    q.add_argument("input")
    q.add_argument("output")
    q.add_argument("--start", type=float, default=0.0)
    q.add_argument("--duration", type=float, required=True)
    q = sub.add_parser("filter")
    q.add_argument("input")
    q.add_argument("output")
    q.add_argument("--width", type=int)
    q.add_argument("--height", type=int)
    q.add_argument("--grey", action="store_true")
    for name in ("plan", "graph", "project"):
        q = sub.add_parser(name)
        q.add_argument("file")
        q.add_argument("--run", metavar="OUTPUT", help="write the result as Parquet")
    q = sub.add_parser("preview")
    q.add_argument("file")
    q.add_argument("png")
    q.add_argument("--at", type=float, default=0.0)
    q.add_argument("--quality", choices=("draft", "proxy", "full"), default="proxy")
    return p


def main(argv: list[str] | None = None) -> int:
    from .errors import EngineError

    try:
        return _run(parser().parse_args(argv))
    except EngineError as e:
        print(e, file=sys.stderr)
        return 2


def _run(a: argparse.Namespace) -> int:
    from .errors import ParamError
    from .mediatime import MediaTime
    from .plans import graph, linear, preview, project, run
    from .plans.jobs import manifest

    if a.command == "version":
        print(VERSION)
        return 0
    read = lambda path: open(path, encoding="utf-8").read()  # noqa: E731, SIM115
    if a.command == "plan":
        plan = linear.Plan.from_json(read(a.file))
        print(linear.explain(plan))
        if a.run:
            clip = linear.execute(run.Context(_session()), plan)
            clip.sampled((plan.output or {}).get("fps") or clip.fps or 24.0).write.parquet(a.run)
        return 0
    if a.command in ("graph", "project", "preview"):
        text = read(a.file)
        if a.command == "project":
            made = project.compile_project(text)
            g = made.graph
            for w in made.warnings:
                print(f"warning: {w}", file=sys.stderr)
        else:
            g = graph.Graph.from_json(text)
        if a.command == "preview":
            from .sources.write import thumbnail

            t = MediaTime.from_secs(a.at)
            _, row = preview.frame(run.Context(_session()), g, t, a.quality)
            data = thumbnail(row, t.micros)
            if data is None:
                raise ParamError(f"there's no frame at {a.at}")
            with open(a.png, "wb") as f:
                f.write(data)
            return 0
        print(graph.explain(g, run.default_registry()))
        print(json.dumps(manifest(g)))
        if a.run:
            for name, clip in run.materialize(run.Context(_session()), g).items():
                clip.sampled(clip.hints.get("fps") or clip.fps or 24.0).write.parquet(f"{a.run}/{name}")
        return 0
    if a.command == "cut" and not (math.isfinite(a.start) and a.start >= 0 and math.isfinite(a.duration) and a.duration > 0):
        raise ParamError("a cut needs start >= 0 and duration > 0")
    if a.command == "filter" and (a.width is None) != (a.height is None):
        raise ParamError("a filter needs both sizes or none")
    ctx = run.Context(_session())
    clip = run.open_asset(ctx, a.input, None)
    if a.command == "probe":
        print(json.dumps({"w": clip.w, "h": clip.h, "fps": clip.fps, "duration": clip.duration_us / 1e6}))
        return 0
    if a.command == "cut":
        ops = [{"op": "trim", "start": a.start, "duration": a.duration}]
    else:
        ops = ([{"op": "scale", "w": a.width, "h": a.height}] if a.width else []) + ([{"op": "custom", "name": "grey"}] if a.grey else [])
    linear.apply(ctx, clip, ops).pictures().write.parquet(a.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
