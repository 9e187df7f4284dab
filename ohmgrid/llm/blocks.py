"""Comparison of the rows of each bucket, in blocks of bounded size.

A bucket of up to ``block`` rows is one run.  A larger one is dealt into parts,
and every pair of parts is a run of its own, so that no task holds a bucket and
all pairs of rows still meet once.  A run's kernel returns links or counts, never
its pairs: what leaves it is at most a row for each row that entered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ohmgrid.llm.common import durable, small_side

#: Rows of a part; a run has at most two parts.
BLOCK = 2048
#: Rows of one key that a join leaves together.
DEAL = 20_000


def runs(rows: DataFrame, bucket: str, spread: str, block: int = BLOCK) -> DataFrame:
    """``rows`` with ``run`` and ``side`` in place of ``bucket`` (long): the runs that each row takes part in.

    Only buckets of more than ``block`` rows are dealt into parts.  There are at
    most rows / block of them; their table is stored and counted, and broadcast only
    if it is small.  ``spread`` is a column that tells the rows of a bucket apart.
    """
    large = rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > block)
    large = durable(large.select(bucket, F.ceil(F.col("__n") / F.lit(block)).cast("int").alias("__parts")))
    met = rows.join(small_side(large), bucket, "left")
    part = F.coalesce(F.pmod(F.xxhash64(spread, F.lit(7)), F.col("__parts")).cast("int"), F.lit(0))
    dealt = met.withColumn("__part", part).withColumn("__other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__parts"), F.lit(1)) - 1)))
    low, high = F.least("__part", "__other"), F.greatest("__part", "__other")
    run = F.when(F.col("__parts").isNull(), F.col(bucket)).otherwise(F.xxhash64(bucket, low, high))
    side = F.when(F.col("__part") == F.col("__other"), 2).when(F.col("__part") < F.col("__other"), 0).otherwise(1)
    others = [c for c in rows.columns if c != bucket]
    return dealt.select(*others, run.alias("run"), side.cast("byte").alias("side")).repartition("run").sortWithinPartitions("run")


def dealt_join(rows: DataFrame, counted: DataFrame, keys: list[str], spread: list[str], most: int = DEAL) -> DataFrame:
    """``rows`` joined to ``counted`` (stored: keys that occur once each, ``n`` rows of each, more columns); ``n`` goes.

    Keys of more than ``most`` rows are dealt into parts by ``spread``, so that no
    task reads all rows of a key.  At most rows / most keys are that large.
    """
    large = counted.where(F.col("n") > most).select(*keys, F.ceil(F.col("n") / F.lit(most)).cast("int").alias("__parts"))
    large = durable(large)
    if large.isEmpty():
        return rows.join(counted.drop("n"), keys)
    parts = F.coalesce("__parts", F.lit(1))
    left = rows.join(small_side(large), keys, "left").withColumn("__part", F.pmod(F.xxhash64(*spread), parts).cast("int")).drop("__parts")
    right = counted.withColumn("__part", F.explode(F.sequence(F.lit(0), F.ceil(F.greatest(F.col("n"), F.lit(1)) / F.lit(most)).cast("int") - 1)))
    return left.join(right.drop("n"), [*keys, "__part"]).drop("__part")


def whole_runs(batches: Iterator[pa.RecordBatch], most: int = 65_536) -> Iterator[pa.Table]:
    """Tables that end where a run ends; runs are bounded, so each table is too."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        run = batch.column("run").to_numpy()
        last = int(np.searchsorted(run, run[-1], "left")) if run[0] <= run[-1] else 0
        if held and last == 0 and held[-1].column("run")[-1].as_py() != run[0].item():
            yield pa.Table.from_batches(held)
            held = []
        if last:
            held.append(batch.slice(0, last))
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def pair_steps(run: np.ndarray, side: np.ndarray, same: Callable[[np.ndarray, np.ndarray], np.ndarray], most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of the pairs in the same run for which ``same`` holds, a bounded number at a time.

    Rows i and i + d are compared for d = 1, 2, ... as long as both lie in one run.
    """
    n = len(run)
    ends = np.append(np.flatnonzero(run[1:] != run[:-1]) + 1, n)
    stop = np.repeat(ends, np.diff(np.concatenate(([0], ends))))
    left = np.arange(n)
    d = 1
    while True:
        left = left[left + d < stop[left]]
        if not len(left):
            return
        for k in range(0, len(left), most):
            i = left[k : k + most]
            j = i + d
            ok = (side[i] == 2) | (side[i] != side[j])
            i, j = i[ok], j[ok]
            ok = same(i, j)
            if ok.any():
                yield i[ok], j[ok]
        d += 1


class Forest:
    """Union-find over the rows of a table, by vectorised hooking to the smaller root."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up
