"""Intermediate tables in the folder that the cluster shares, and their removal."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths of the tables written in each open scope, the innermost last.
_OPEN: ContextVar[tuple[list[tuple[SparkSession, str]], ...]] = ContextVar("open_scopes", default=())


def work_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder, which only a local master can use."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def kept(df: DataFrame, name: str, outlives: bool = False) -> DataFrame:
    """Write ``df`` once and read it back: its lineage is cut, and what reads it several times does not compute it again.

    The table goes with the :func:`scope` around it; one that ``outlives`` it goes with the scope around that one. Outside all scopes tables stay.
    """
    path = f"{work_dir(df.sparkSession)}/factloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    scopes = _OPEN.get()[: -1 if outlives else None]
    if scopes:
        scopes[-1].append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a table that are sent to every executor.
BROADCAST_ROWS = 1 << 18


def small(df: DataFrame) -> DataFrame:
    """``df``, marked for a broadcast if it has at most :data:`BROADCAST_ROWS` rows; a larger one is joined by a shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def folder(spark: SparkSession, name: str) -> str:
    """A new folder for what a job writes by itself; it goes with the :func:`scope` around it."""
    path = f"{work_dir(spark)}/factloom/{name}-{uuid.uuid4().hex}"
    if _OPEN.get():
        _OPEN.get()[-1].append((spark, path))
    return path


@contextmanager
def scope():
    """Tables that are :func:`kept` within the block are removed at its end, once nothing reads them any more."""
    token = _OPEN.set((*_OPEN.get(), []))
    try:
        yield
    finally:
        for spark, name in _OPEN.get()[-1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _OPEN.reset(token)
