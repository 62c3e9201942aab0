"""Durable intermediate tables and small session helpers.

Intermediate results that are read more than once are written as Parquet below
the folder that the cluster names in ``spark.checkpoint.dir``, so that a lost
executor costs at most the tasks it was running.  The tables go away when the
operator releases them, at the end of a ``scratch()`` block, or when the driver exits.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_live: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor can read; our own only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return "/tmp/checkpoints/tessera"
    raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a frame that reads what was written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _live[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete tables that ``durable`` wrote and nothing will read again."""
    for df in frames:
        path = getattr(df, "_tessera_path", None)
        if path and path in _live:
            _delete(_live.pop(path), path)


@contextmanager
def scratch() -> Iterator[None]:
    """At the block's end all tables written inside it go, those behind results included."""
    before = set(_live)
    try:
        yield
    finally:
        for path in set(_live) - before:
            _delete(_live.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _release_all() -> None:
    for path, spark in list(_live.items()):
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the JVM may be gone by now; its own cleanup applies
            break
    _live.clear()


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
