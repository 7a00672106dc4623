"""Tables written between steps, in the folder that all executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``; a lost executor then costs a
reread, not a rerun.  Only where that setting is absent (tests, a single machine) a folder of
this machine is used.  The folders are removed when the driver's Python exits.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: A table of up to so many bytes is broadcast; a larger one is joined by shuffle, with the same result.
BROADCAST_BYTES = 32 << 20
#: Columns that the operators read in rows which they pass on.
KEPT = frozenset(("doc_id", "text", "n_chars"))

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the session's checkpoint folder, or a new local one in local mode."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = have.get() if have.isDefined() else None
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="lumitide-"))
    return at.rstrip("/")


def _remove(jvm, conf, path: str) -> None:
    try:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception:  # noqa: BLE001  the session has ended before us
        import shutil

        if path.startswith("file:"):
            shutil.rmtree(path[len("file:") :].replace("//", "/", 1) if path.startswith("file://") else path[5:], ignore_errors=True)


def save(df: DataFrame) -> DataFrame:
    """The same rows, read back from Parquet in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lumitide-{uuid.uuid4().hex}"
    df.write.parquet(path)
    sc = spark.sparkContext
    atexit.register(_remove, sc._jvm, sc._jsc.hadoopConfiguration(), path)
    return spark.read.schema(df.schema).parquet(path)


def columns(df: DataFrame) -> list[Column]:
    """All columns by their literal names, dots and all."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``mapInArrow`` to the same columns; it doesn't take names with dots, so they go by number, those in KEPT by name."""
    number = {c: c if c in KEPT else f"c{k}_" for k, c in enumerate(df.columns)}
    inner = StructType([StructField(number[f.name], f.dataType, f.nullable) for f in df.schema])
    return df.toDF(*[number[c] for c in df.columns]).mapInArrow(run, inner).toDF(*df.columns)


def small(ids: DataFrame) -> DataFrame:
    """A saved table of numbers, marked for broadcast if it is few bytes."""
    return F.broadcast(ids) if ids.count() * 8 * len(ids.columns) <= BROADCAST_BYTES else ids
