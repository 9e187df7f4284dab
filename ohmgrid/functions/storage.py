"""Cutting lineage in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that are sent to every task at most; more are met by an exchange.
BROADCAST_ROWS = 1_000_000

#: Folders that open scopes have to remove, innermost last.
_scopes: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, ``spark.checkpoint.dir``.

    On one machine, as in tests, a folder is made where none is set; a cluster
    without one is refused, as its machines do not share their temporary folders.
    """
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ohmgrid-"))
    return context.getCheckpointDir().get()


def new_folder(spark: SparkSession, name: str = "table") -> str:
    """A path in the shared folder that no one has used, removed with the innermost open scope."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as a table and read again; lost executors do not lose it.

    Unlike a checkpoint a table forgets all that the optimizer knew of its rows,
    which in iterations grows from round to round until plans take minutes.
    """
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder wherever Spark keeps it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, what operators have stored within it; results have to be written or read before."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)


def small_side(rows: DataFrame) -> DataFrame:
    """A stored ``rows``, marked for broadcast if counting proves it small."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
