"""Streaming forms of the queue operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmgrid.operators.jobs import stream_states


def event_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Lifecycle events from Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def unique_requests(requests: DataFrame, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The first request of each signature within the watermark's delay."""
    return requests.withWatermark(time, delay).dropDuplicatesWithinWatermark(["signature"])


def windowed_counts(events: DataFrame, kind: str, time: str = "ts", length: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Events of each kind in tumbling windows; windows behind the watermark are final."""
    return events.withWatermark(time, delay).groupBy(F.window(time, length), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what is there and stops; ``update`` results are kept batch by batch with their number."""
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    else:
        keep = lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(path)
        query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def latest_states(spark: SparkSession, path: str) -> DataFrame:
    """The last state of every job among the kept batches."""
    rows = spark.read.parquet(path)
    return rows.groupBy("job").agg(F.max_by(F.struct("state", "n_applied", "n_refused"), "batch").alias("z")).select("job", "z.*")


__all__ = ["event_stream", "latest_states", "run_available", "stream_states", "unique_requests", "windowed_counts"]
