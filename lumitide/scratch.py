"""Where intermediate tables go: the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of up to so many bytes of Parquet is broadcast, and of so many in memory where those are counted.
BROADCAST_BYTES, BROADCAST_MEMORY = 16 << 20, 64 << 20

_made: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; in local mode without that setting, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _made:
            _made[app] = tempfile.mkdtemp(prefix="lumitide-core-")
            atexit.register(shutil.rmtree, _made[app], True)
        base = _made[app]
    return f"{base.rstrip('/')}/core-{uuid.uuid4().hex}"


def small(df: DataFrame, held: Column | None = None) -> DataFrame:
    """df, written and read back; marked for broadcast if what was written is small.

    held: the bytes of a row in memory, for rows that repeat much, which Parquet writes once; their sum must be small, too.
    """
    spark = df.sparkSession
    path = folder(spark)
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    back = spark.read.schema(df.schema).parquet(path)
    if size > BROADCAST_BYTES:
        return back
    if held is not None and (back.agg(F.sum(held)).first()[0] or 0) > BROADCAST_MEMORY:
        return back.hint("merge")  # else Spark goes by the size of the files
    return F.broadcast(back)
