"""A job table in a shared folder: versions that are renamed into place once, merged by key when they are read.

Every commit is a folder of changed rows, written aside and then renamed to the
next version; a rename onto a version that is there fails, so of two writers who saw the same version
one wins and the other reads again.  Readers take each job's last row, with columns that older
versions lack as nulls.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from py4j.protocol import Py4JJavaError

from ohmgrid.functions.storage import remove
from ohmgrid.operators import jobs, ordered

VERSION = "version"


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def versions(spark: SparkSession, root: str) -> list[int]:
    """The committed versions, one small listing; a table that is not there has none."""
    folder = _path(spark, root)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n.removeprefix(f"{VERSION}=")) for n in names if n.startswith(f"{VERSION}="))


def commit(changes: DataFrame, root: str, seen: int) -> int:
    """Makes ``changes`` the version after ``seen``; ``Conflict`` if there is one already."""
    spark = changes.sparkSession
    aside, target = f"{root}/_writing-{uuid.uuid4().hex}", f"{root}/{VERSION}={seen + 1:012d}"
    changes.write.parquet(aside)
    jvm = spark.sparkContext._jvm
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, root).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        files.rename(_path(spark, aside), _path(spark, target), none)
    except Py4JJavaError as error:
        remove(spark, aside)
        if seen + 1 in versions(spark, root):
            raise Conflict(f"version {seen + 1} has been committed") from error
        raise
    return seen + 1


def read(spark: SparkSession, root: str, key: str = "job_id", at: int | None = None) -> tuple[DataFrame | None, int]:
    """(rows as of version ``at`` or the last one, that version); no table yet is (None, 0)."""
    there = [v for v in versions(spark, root) if at is None or v <= at]
    if not there:
        return None, 0
    paths = [f"{root}/{VERSION}={v:012d}" for v in there]
    rows = spark.read.option("mergeSchema", True).option("basePath", root).parquet(*paths)
    return ordered.latest_by(rows, [key], [VERSION]).drop(VERSION), there[-1]


def update(spark: SparkSession, root: str, change: Callable[[DataFrame | None], DataFrame], tries: int = 5, key: str = "job_id") -> int:
    """Commits what ``change`` makes of the current rows, the changed rows alone; after a conflict it is asked again."""
    for _ in range(tries):
        rows, seen = read(spark, root, key)
        try:
            return commit(change(rows), root, seen)
        except Conflict:
            continue
    raise Conflict(f"{tries} tries met other writers")


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """The rows of ``after`` that are not in ``before``."""
    return after.exceptAll(before.select(*after.columns))


def enqueue(spark: SparkSession, root: str, new: DataFrame) -> int:
    """Adds jobs whose signature no active job has; they may have columns that the table lacks."""
    return update(spark, root, lambda rows: new if rows is None else changed(_with(rows, new), _with(jobs.queue_jobs(rows, new), new)))


def _with(rows: DataFrame, other: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``other`` that it lacks, as nulls."""
    return rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in other.schema if f.name not in rows.columns})


def claim(spark: SparkSession, root: str, worker: str, now: float, lease_s: float) -> DataFrame:
    """Claims the next job for ``worker`` and returns its row, read back from the version that this made; no row if the queue is empty."""
    def change(rows: DataFrame | None) -> DataFrame:
        if rows is None:
            raise AnalysisException("there is no job table")
        return changed(rows, jobs.claim(rows, worker, now, lease_s))

    made = update(spark, root, change)
    return spark.read.parquet(f"{root}/{VERSION}={made:012d}")


def recover(spark: SparkSession, root: str, now: float) -> int:
    """Requeues, fails or cancels jobs whose lease has run out."""
    def change(rows: DataFrame) -> DataFrame:
        state = jobs.expire(F.col("state"), F.col("lease_expires_at"), F.col("attempt"), F.lit(now))
        free = state.isin("QUEUED", "FAILED", "CANCELLED") & (state != F.col("state"))
        columns = {"claimed_by": F.when(~free, F.col("claimed_by")), "lease_expires_at": F.when(~free, F.col("lease_expires_at")), "state": state}
        return rows.where(state != F.col("state")).withColumns(columns)

    return update(spark, root, change)
