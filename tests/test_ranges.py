"""Numbers, running sums, quantiles and marking over sorted ranges against plain versions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ohmgrid.functions import storage
from ohmgrid.operators import ordered, ranges, weighted


def rows_of(n, groups, values, seed=3):
    rng = random.Random(seed)
    return [(rng.choice(groups), rng.randrange(values), k, rng.choice([None, rng.randrange(1, 9)])) for k in range(n)]


@pytest.mark.parametrize(("n", "groups", "values"), [(0, ["a"], 3), (1, [None], 3), (700, ["a", "b", None], 40), (400, ["only"], 1), (300, [f"g{k}" for k in range(200)], 9)])
def test_numbered(spark, n, groups, values):
    rows = rows_of(n, groups, values)
    df = spark.createDataFrame(rows, "part string, at long, rows long, before long").repartition(3)
    out = ranges.numbered(df, ["part"], [F.col("at").desc(), F.col("rows").asc()], "first", "total", {"run": F.col("before")}, {"run": "whole"}).collect()
    expected = []
    for g in set(r[0] for r in rows):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        for k, r in enumerate(own):
            expected.append((*r, k, sum(x[3] or 0 for x in own[: k + 1]), len(own), sum(x[3] or 0 for x in own)))
    assert sorted(map(str, (tuple(r) for r in out))) == sorted(map(str, expected))


def test_one_large_group_is_many_ranges(spark):
    df = spark.range(40_000).select(F.lit("one").alias("g"), F.xxhash64("id").alias("v"))
    with storage.scope(spark):
        out = ranges.numbered(df, ["g"], [F.col("v").asc()], "k").withColumn("p", F.spark_partition_id())
        first, last = out.agg(F.min("k"), F.max("k")).first()
        assert (first, last, out.select("k").distinct().count()) == (0, 39_999, 40_000)
        ordered_rows = out.orderBy("k").select("v").limit(2000).collect()
        assert ordered_rows == sorted(ordered_rows)


def test_scope_removes_what_was_stored(spark):
    with storage.scope(spark):
        kept = storage.durable(spark.range(3))
        path = kept.inputFiles()[0]
        assert kept.count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path).count()


def test_quantiles_and_marks(spark):
    rng = random.Random(9)
    rows = [("ab"[k % 5 == 0], rng.randrange(30), rng.randrange(1, 6), k) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, v long, w long, id long")
    found = {r["g"]: r["q"] for r in weighted.weighted_quantiles(df, ["g"], "v", F.col("w"), {"q": (99, 100)}).collect()}
    marked = {(r["g"], r["id"]) for r in ordered.mark(df, ["g"], "v", ["id"], (7, 10)).collect()}
    lanes = {r["id"]: (r["committed"], r["admitted"]) for r in ordered.admitted(df, ["g"], ["v", "id"], F.col("w"), 300).collect()}
    for g in "ab":
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[3]))
        total, run = sum(r[2] for r in own), 0
        quantile = None
        for r in own:
            run += r[2]
            assert lanes[r[3]] == (run, run <= 300)
            quantile = r[1] if quantile is None and run * 100 >= total * 99 else quantile
        assert found[g] == quantile
        squares, done = sum(r[1] ** 2 for r in own), 0
        for r in sorted(own, key=lambda r: (-r[1], r[3])):
            assert ((g, r[3]) in marked) == (done * 10 < squares * 7 and r[1] > 0)
            done += r[1] ** 2
