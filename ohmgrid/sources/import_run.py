"""Imports that record themselves: start, finish or failure, with counts observed while the sections are written."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ohmgrid.sources import ipc2581

#: Sections that a finish counts.
COUNTED = ("feature", "pad", "hole", "layer", "component", "unknown")
RECORD = "run string, path string, event string, at timestamp, documents long, rows long, " + ", ".join(f"{s} long" for s in COUNTED) + ", error string"


def _record(spark: SparkSession, root: str, run: str, path: str, event: str, counts: dict[str, int] | None = None, error: str | None = None) -> None:
    counts = counts or {}
    row = (run, path, event, datetime.now(timezone.utc), *[counts.get(c) for c in ("documents", "rows", *COUNTED)], error)
    spark.createDataFrame([row], RECORD).coalesce(1).write.mode("append").parquet(f"{root}/records")


def run_import(spark: SparkSession, path: str, root: str) -> str:
    """Writes the section rows of the documents at ``path`` to ``root``/rows-<run> and returns the run's name.

    The records of the run are appended to ``root``/records: ``started`` first, then
    ``finished`` with the counts, which Spark observes in the pass that writes, or ``failed`` with what
    went wrong, in a few words that hold nothing of the document.  The failure is raised again.
    """
    run = f"import-{uuid.uuid4().hex[:16]}"
    _record(spark, root, run, path, "started")
    seen = Observation(run)
    section = F.col("section")
    counts = [F.count_if(section == "header").alias("documents"), F.count(F.lit(1)).alias("rows"), *[F.count_if(section == s).alias(s) for s in COUNTED]]
    try:
        ipc2581.read_rows(spark, path).observe(seen, *counts).write.partitionBy("section").parquet(f"{root}/rows-{run}")
    except Exception as error:
        text = str(error)
        known = text.rpartition("Refused: ")[2].splitlines()[0] if "Refused: " in text else type(error).__name__
        _record(spark, root, run, path, "failed", error=known[:200])
        raise
    _record(spark, root, run, path, "finished", seen.get)
    return run


def records(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(RECORD).parquet(f"{root}/records")


def rows_of(spark: SparkSession, root: str, run: str) -> DataFrame:
    """The section rows of a run, for ``ipc2581.sections_of``."""
    return spark.read.schema(ipc2581.ROW).parquet(f"{root}/rows-{run}")
