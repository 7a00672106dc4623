"""Jobs that can be cancelled and resumed: stages are written as Parquet and reused by fingerprint.

The store and the stages live in any folder that Hadoop's file systems reach; on a cluster it must be
one that all executors share.
"""

from __future__ import annotations

import dataclasses
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..clips import Clip
from ..errors import Cancelled, EngineError
from .graph import CompiledGraph, Graph, canonical, compile_graph, fingerprint, schedule, stage_keys
from .run import Context, default_registry, materialize

SCHEMA = 2
STATES = ("queued", "running", "paused", "failed", "done")


class Folder:
    """Small files and existence checks through the session's Hadoop file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        p = self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return p, p.getFileSystem(self.conf)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        p, fs = self._at(name)
        return fs.exists(p)

    def delete(self, name: str) -> None:
        p, fs = self._at(name)
        fs.delete(p, True)

    def write(self, name: str, text: str) -> None:
        """Written aside and renamed, so a reader never sees half of it."""
        tmp, fs = self._at(f".{uuid.uuid4().hex}")
        s = fs.create(tmp, True)
        s.write(bytearray(text.encode()))
        s.close()
        p, _ = self._at(name)
        if fs.exists(p):
            fs.delete(p, False)
        if not fs.rename(tmp, p):
            raise EngineError(f"can't write {name}")

    def read(self, name: str) -> str:
        p, fs = self._at(name)
        s = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(s)).decode()
        finally:
            s.close()

    def names(self, suffix: str) -> list[str]:
        p, fs = self._at("")
        return sorted(f.getPath().getName() for f in fs.listStatus(p) if f.getPath().getName().endswith(suffix)) if fs.exists(p) else []


class Cancel:
    """A flag that a running job looks at between stages; set, it also cancels the running stage's tasks."""

    def __init__(self, spark: SparkSession | None = None):
        self.spark, self.group, self.on = spark, f"lumitide-{uuid.uuid4().hex}", False

    def cancel(self) -> None:
        self.on = True
        if self.spark is not None:
            self.spark.sparkContext.cancelJobGroup(self.group)

    def check(self) -> None:
        if self.on:
            raise Cancelled("cancelled")


@dataclasses.dataclass
class Job:
    id: str
    graph: dict
    state: str = "queued"
    fingerprint: str = ""
    done: list[str] = dataclasses.field(default_factory=list)
    error: str | None = None
    output: str | None = None
    updated: float = 0.0
    schema: int = SCHEMA


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.folder = Folder(spark, root)

    def save(self, job: Job) -> None:
        job.updated = time.time()
        self.folder.write(f"{job.id}.json", json.dumps(dataclasses.asdict(job)))

    def load(self, job: str) -> Job:
        if not self.folder.exists(f"{job}.json"):
            raise EngineError(f"no job {job}")
        d = json.loads(self.folder.read(f"{job}.json"))
        if d.get("schema", 0) > SCHEMA:
            raise EngineError(f"job {job} is of a newer version")
        return Job(**d)

    def list(self) -> list[str]:
        return [n[: -len(".json")] for n in self.folder.names(".json")]

    def submit(self, graph: Graph) -> Job:
        job = Job(uuid.uuid4().hex[:16], graph.to_json(), fingerprint=fingerprint(compile_graph(graph, default_registry())))
        self.save(job)
        return job


class StageCache:
    """Written relations by content key; one is valid when its success mark is there."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, Folder(spark, root)

    def hit(self, key: str) -> bool:
        return self.folder.exists(f"{key}/_SUCCESS")

    def read(self, key: str) -> DataFrame:
        return self.spark.read.parquet(self.folder.path(key))

    def put(self, key: str, df: DataFrame) -> DataFrame:
        if not self.hit(key):
            df.write.mode("overwrite").parquet(self.folder.path(key))
        return self.read(key)

    def first_invalid(self, keys: list[str]) -> int:
        return next((k for k, key in enumerate(keys) if not self.hit(key)), len(keys))


def manifest(graph: Graph) -> dict:
    """What a run of the graph leaves behind: stages with their keys, and the outputs."""
    c = compile_graph(graph, default_registry())
    keys = stage_keys(c)
    return {"version": 1, "graph": fingerprint(c), "stages": [{"index": k, "backend": s.backend, "key": key, "nodes": list(s.ids)} for k, (s, key) in enumerate(zip(schedule(c).stages, keys))], "outputs": [{"name": n, "node": c.nodes[i].node.id, "uri": u} for n, i, u in c.outputs]}


def keeper(cache: StageCache, c: CompiledGraph, cancel: Cancel) -> Callable[[int, Clip], Clip]:
    """Writes what a stage hands on to later stages, under its content key, and reads it from then on.

    What is there already isn't made again, so a resumed job goes on after its last whole stage.  Kernels
    that look at the time wait on, as they must see the times of the output's grid.
    """
    stages, keys = schedule(c).stages, stage_keys(c)
    own = {i: k for k, st in enumerate(stages) for i in st.nodes}
    handed = {i for st in stages for i in st.outputs if c.nodes[i].node.kind in ("op", "redaction") and any(i in n.inputs and n.node.kind != "output" for n in c.nodes)}

    def keep(i: int, clip: Clip) -> Clip:
        if i not in handed:
            return clip
        cancel.check()
        late = any(k.by_time for k in clip.chain)
        parts = {"video": clip.video if late or clip.video is None else clip.pictures(), "audio": clip.audio, "masks": clip.masks}
        at = lambda what: fingerprint([keys[own[i]], c.nodes[i].node.id, what])
        return clip.replace(**{what: cache.put(at(what), df) for what, df in parts.items() if df is not None}, chain=clip.chain if late else ())

    return keep


def run(ctx: Context, store: Store, job: Job, out: str, cancel: Cancel | None = None, progress: Callable[[str, int, int], None] | None = None, stages: bool = True) -> Job:
    """Runs or resumes a job: each output's frames (and sound) are written below ``out``, and so is what stages hand on.

    Outputs and stages that are there under the same key aren't made again; a changed graph starts
    over but for the stages before its change; a cancelled job is paused, and one that fails says why.
    """
    graph = Graph.from_json(job.graph)
    compiled = compile_graph(graph, default_registry())
    now = fingerprint(compiled)
    if job.fingerprint != now:
        job.fingerprint, job.done, job.state = now, [], "queued"
    cache = StageCache(ctx.spark, out)
    wanted = [o.name for o in graph.outputs]
    key = lambda name, what: fingerprint([now, name, what])
    if job.state == "done" and all(cache.hit(key(n, "video")) or cache.hit(key(n, "audio")) for n in wanted):
        return job
    job.state, job.error, job.output = "running", None, out
    store.save(job)
    cancel = cancel or Cancel(ctx.spark)
    try:
        ctx.spark.sparkContext.setJobGroup(cancel.group, f"job {job.id}", True)
        made = materialize(ctx, compiled, keep=keeper(cache, compiled, cancel) if stages else None)
        for k, name in enumerate(wanted):
            cancel.check()
            clip = made[name]
            if clip.video is not None:
                cache.put(key(name, "video"), clip.sampled(clip.hints.get("fps") or clip.fps or ctx.fps))
            if clip.audio is not None:
                cache.put(key(name, "audio"), clip.audio)
            job.done = sorted({*job.done, name})
            store.save(job)
            if progress:
                progress(name, k + 1, len(wanted))
        job.state = "done"
    except Cancelled:
        job.state = "paused"
    except Exception as e:
        job.state, job.error = ("paused", None) if cancel.on else ("failed", str(e)[:500])
        store.save(job)
        if job.state == "failed":
            raise
    store.save(job)
    return job


def outputs(ctx: Context, job: Job) -> dict[str, DataFrame]:
    """The written pictures of a job, by output."""
    cache = StageCache(ctx.spark, job.output or "")
    found = {}
    for o in job.graph.get("outputs", []):
        key = fingerprint([job.fingerprint, o["name"], "video"])
        if cache.hit(key):
            found[o["name"]] = cache.read(key)
    return found


def seal(spark: SparkSession, path: str) -> DataFrame:
    """``file, bytes, sha256`` of every file below a folder: its manifest, hashed where the files are read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    base = F.regexp_replace(F.lit(path.rstrip("/")), "^file:/*", "/")
    name = F.expr("substring(path, len(base_) + 2)")
    return found.withColumn("base_", base).withColumn("path", F.regexp_replace("path", "^file:/*", "/")).select(name.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def broken(spark: SparkSession, path: str, sealed: DataFrame) -> DataFrame:
    """``file, why`` of files that are missing, new or other than a manifest says."""
    now = seal(spark, path).select("file", F.col("sha256").alias("now"))
    why = F.when(F.col("now").isNull(), "missing").when(F.col("sha256").isNull(), "new").when(F.col("now") != F.col("sha256"), "changed")
    return sealed.select("file", "sha256").join(now, "file", "full").select("file", why.alias("why")).where("why is not null")


__all__ = ["Cancel", "Folder", "Job", "StageCache", "Store", "broken", "canonical", "keeper", "manifest", "outputs", "run", "seal"]
