"""Importance resampling towards a target distribution by hashed n-grams.

Each task packs the buckets of its documents' n-grams into streams of unsigned
16-bit numbers with the place where each document starts, and stores them.  The
counts of the corpus and of the target come from the stored streams: every block
is sorted and run-length encoded, and the runs are summed.  Later a second pass
over the streams, not over the texts, gathers each feature's gain and sums it by
document with ``np.add.reduceat``.  Gumbel noise keyed by the document makes the
highest scores a sample without replacement.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmgrid.llm.common import durable
from ohmgrid.operators import ranges

#: Bytes that are parts of words, A-Z as a-z; all others become spaces. Bytes of characters beyond ASCII are parts.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Buckets of a block, of two bytes each, and bytes of text that are split at once; longer texts go on in the next ones.
BLOCK, SLICE = 1 << 21, 1 << 20


def feature_buckets(raw: bytes, longest: int, buckets: int, size: int = SLICE) -> Iterator[tuple[np.ndarray, int]]:
    """For slices of a UTF-8 text: the buckets of the runs of up to ``longest`` words that end in the slice, and its words.

    The checksum of a run goes on from that of the run without its last word.
    """
    folded = raw.translate(FOLD)
    at, tail = 0, []
    while at < len(folded):
        end = folded.find(b" ", at + size)
        end = len(folded) if end < 0 else end
        new = folded[at:end].split()
        words, at = tail + new, end
        runs, found = [crc32(w) for w in words], []
        for n in range(1, longest + 1):
            found.append(np.array(runs[max(0, len(tail) - n + 1) :], dtype=np.uint32) % np.uint32(buckets))
            runs = [crc32(w, crc32(b" ", run)) for w, run in zip(words[n:], runs[: len(words) - n], strict=True)]
        if new:
            yield np.concatenate(found).astype("<u2"), len(new)
            tail = words[max(0, len(words) - longest + 1) :] if longest > 1 else []


def pack_streams(documents: DataFrame, key: str, text: str, longest: int, buckets: int) -> DataFrame:
    """Blocks of packed streams: (keys, rows, n_words, starts, stream), one entry of the arrays for each document.

    A document that does not fit goes on in the next block under the same number.  A document
    without words has an entry and no buckets.  Numbers are unique once stored.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets have to fit in 16 bits")
    source = documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = source.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), 0
        keys, rows, n_words, starts, parts, size = [], [], [], [], [], 0

        def block(kind: pa.DataType) -> pa.RecordBatch:
            columns = [pa.array([keys], pa.list_(kind)), pa.array([rows], pa.list_(pa.int64())), pa.array([n_words], pa.list_(pa.int64())), pa.array([starts], pa.list_(pa.int64()))]
            stream = np.concatenate(parts).tobytes() if parts else b""
            return pa.RecordBatch.from_arrays([*columns, pa.array([stream], pa.binary())], names=["keys", "rows", "n_words", "starts", "stream"])

        of = pa.null()
        for batch in batches:
            of = batch.schema.field(0).type
            for own, value in zip(batch.column(0), batch.column(1), strict=True):
                row, seen = (task << 40) + seen, seen + 1
                for found, n in [(None, 0), *feature_buckets((value.as_py() or "").encode("utf-8", "surrogatepass"), longest, buckets)]:
                    if size >= BLOCK:
                        yield block(of)
                        keys, rows, n_words, starts, parts, size = [], [], [], [], [], 0
                    if not rows or rows[-1] != row:
                        keys.append(own.as_py())
                        rows.append(row)
                        n_words.append(0)
                        starts.append(size)
                    if n:
                        parts.append(found)
                        n_words[-1] += n
                        size += len(found)
        if rows:
            yield block(of)

    return source.mapInArrow(run, f"keys array<{kind}>, rows array<long>, n_words array<long>, starts array<long>, stream binary")


def count_buckets(streams: DataFrame, name: str) -> DataFrame:
    """(bucket, ``name``): every block is sorted, its runs of equal buckets are measured and a task's runs are summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for stream in batch.column(0):
                ordered = np.sort(np.frombuffer(stream.as_buffer(), "<u2"))
                heads = np.flatnonzero(np.diff(ordered, prepend=-1))
                total[ordered[heads]] += np.diff(heads, append=len(ordered))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held])], names=["bucket", "n"])

    counts = streams.select("stream").mapInArrow(run, "bucket long, n long")
    return counts.groupBy("bucket").agg(F.sum("n").alias(name))


def learn_gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Gain of each bucket, in thousandths of a nat: floor(1000 ln of the smoothed share in the target over that in the corpus).

    A row for each bucket comes to the driver, 65,536 at most, whatever the size of the corpus.
    """
    s, t = ({r["bucket"]: r["n"] for r in count_buckets(streams, "n").collect()} for streams in (corpus, target))
    all_s, all_t = float(sum(s.values())), float(sum(t.values()))
    share = [(t.get(b, 0) + 1.0) * (all_s + buckets) / ((s.get(b, 0) + 1.0) * (all_t + buckets)) for b in range(buckets)]
    return np.array([math.floor(1000 * math.log(x)) for x in share], np.int64)


def weigh(streams: DataFrame, gains: np.ndarray, key: str) -> DataFrame:
    """(number_in_table, key, n_words, n_features, weight): the floored mean gain of each document, 0 for one without features.

    Documents that lie in several blocks are summed by their number; the others take no exchange.
    """
    kind = streams.schema["keys"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                keys, rows, n_words, starts, stream = (batch.column(c)[k] for c in range(5))
                gained = gains[np.frombuffer(stream.as_buffer(), "<u2")]
                start = np.array(starts.values, np.int64)
                sizes = np.diff(start, append=len(gained))
                sums = np.zeros(len(start), np.int64)
                full = np.flatnonzero(sizes)
                if len(full):
                    sums[full] = np.add.reduceat(gained, start[full])
                # Only the first and the last document of a block can go on in another.
                edge = np.zeros(len(start), bool)
                edge[[0, -1]] = True
                columns = [keys.values, rows.values, n_words.values, pa.array(sizes), pa.array(sums), pa.array(edge)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "row", "n_words", "n_features", "gained", "edge"])

    parts = streams.select("keys", "rows", "n_words", "starts", "stream").mapInArrow(run, f"key {kind}, row long, n_words long, n_features long, gained long, edge boolean")
    cut = parts.where("edge").groupBy("row").agg(F.first("key").alias("key"), *[F.sum(c).alias(c) for c in ("n_words", "n_features", "gained")])
    columns = ["row", "key", "n_words", "n_features", "gained"]
    mean = F.coalesce(F.floor(F.expr("gained div nullif(n_features, 0)") - F.when(F.expr("gained % nullif(n_features, 0) < 0"), 1).otherwise(0)), F.lit(0))
    both = parts.where("not edge").select(*columns).unionByName(cut.select(*columns))
    return both.select(F.col("row").alias("number_in_table"), F.col("key").alias(key), "n_words", "n_features", mean.cast("long").alias("weight"))


def resample(
    documents: DataFrame,
    target: DataFrame,
    share: tuple[int, int] = (25, 100),
    least_words: int = 20,
    seed: int = 7,
    longest: int = 2,
    buckets: int = 10_000,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: key, n_words, n_features, weight, score and rank (null if not drawn).

    Of the documents with ``least_words``, the share (numerator, denominator) with the
    highest scores is drawn; ties go to the smaller key, null keys first.  Null and empty texts
    have no words and weight 0.  Repeated rows and keys are documents of their own and
    score alike.  Texts of any length are cut into blocks and summed.  An empty table
    gives no rows, and with an empty ``target`` all of its counts are zero.  Other columns, whatever their names, are ignored.
    """
    corpus = durable(pack_streams(documents, key, text, longest, buckets))
    aim = durable(pack_streams(target.withColumn("key", F.lit(0)), "key", text, longest, buckets))
    weighed = weigh(corpus, learn_gains(corpus, aim, buckets), key)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weighed.withColumn("score", F.col("weight") + noise)
    able = F.col("n_words") >= least_words
    # Those that cannot be drawn are a group of their own.
    placed = ranges.numbered(scored.withColumn("able", able), ["able"], [F.col("score").desc(), F.col(f"`{key}`").asc(), F.col("number_in_table")], "place", "n")
    num, den = share
    drawn = F.col("able") & (F.col("place") < F.call_function("div", F.col("n") * num, F.lit(den)))
    return placed.select(f"`{key}`", "n_words", "n_features", "weight", "score", F.when(drawn, F.col("place") + 1).alias("rank"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, drawn towards the text of the benchmark."""
    docs, aim = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs.select("doc_id", "text"), aim.select("text")).select("doc_id", "n_features", "weight", "score", "rank")
