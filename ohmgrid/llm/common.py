"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmgrid.functions.storage import BROADCAST_ROWS, durable, shared_folder, small_side

__all__ = ["BROADCAST_ROWS", "content_id", "durable", "free_name", "lower_ascii", "shared_folder", "small_batches", "small_side", "without_rows"]

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; all-ASCII texts take the faster built-in."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, ASCII_UPPER, ASCII_LOWER)).otherwise(F.lower(text))



#: Bytes of an Arrow batch that a Python worker is handed at once.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches to ``BATCH_BYTES``, unless they are smaller: workers hold a batch and what is made of it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def content_id(df: DataFrame, *columns: str) -> Column:
    """struct(a, b): 128 bits that the values of ``columns`` alone decide, whatever the split or the order of the rows.

    Numbers given to rows by their place change when a table is split anew, as it
    may be after executors are lost; these do not.  Equal rows have equal ids.
    """
    parts: list[Column] = []
    for f in df.select(*[f"`{c}`" for c in columns]).schema:
        column = F.col(f"`{f.name}`")
        # Maps cannot be hashed.
        parts += [column.isNull(), F.to_json(F.struct(column)) if "map<" in f.dataType.simpleString() else column]
    return F.struct(F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *parts).alias("b"))


def without_rows(documents: DataFrame, dropped: DataFrame, identity: Column) -> DataFrame:
    """``documents`` without the rows whose ``identity`` is in ``dropped`` (a, b).

    The identities are stored and counted first; only a proven small set is broadcast.
    """
    name = free_name(documents, "own_id")
    gone = small_side(durable(dropped.select(F.struct("a", "b").alias(name))))
    return documents.withColumn(name, identity).join(gone, name, "left_anti").drop(name)
