"""Connected components of large graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ohmgrid.functions.storage import durable


#: Pointer doublings of a round, and levels that are resolved before the result is stored.
DOUBLINGS, LEVELS = 2, 4


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (u, v: long) reaches.

    Each round, nodes pick the smallest of their closed neighbourhood, by id in
    the first round and by a fresh hash in the others, picks of picks are followed
    four steps far, and the graph is contracted along them; rounds grow with the
    logarithm of the graph, for chains too.  Hubs are met by partial aggregation
    and skew-split joins, and nothing is collected.
    """
    live = durable(
        edges.where(F.col("u") != F.col("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    )
    levels: list[DataFrame] = []
    while not live.isEmpty():
        turn = len(levels)

        def rank(name: str, turn: int = turn):
            return F.col(name) if turn == 0 else F.xxhash64(name, F.lit(turn))

        both = live.unionAll(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        best = both.groupBy("u").agg(F.min(F.struct(rank("v").alias("rank"), F.col("v").alias("node"))).alias("best"))
        own = F.struct(rank("u").alias("rank"), F.col("u").alias("node"))
        picked = durable(best.select(F.col("u").alias("node"), F.least(own, F.col("best"))["node"].alias("parent")))
        for _ in range(DOUBLINGS):
            picked = picked.join(picked.toDF("parent", "next"), "parent").select("node", F.col("next").alias("parent"))
        picked = durable(picked)
        ends = live.join(picked.toDF("u", "pu"), "u").join(picked.toDF("v", "pv"), "v").where(F.col("pu") != F.col("pv"))
        live = durable(ends.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct())
        levels.append(picked)
    if not levels:
        return live.toDF("node", "component")
    roots = levels.pop()
    while levels:
        roots = levels.pop().join(roots.toDF("parent", "root"), "parent", "left").select("node", F.coalesce("root", "parent").alias("parent"))
        if len(levels) % LEVELS == 0:
            roots = durable(roots)
    return roots.join(roots.groupBy("parent").agg(F.min("node").alias("component")), "parent").select("node", "component")


def dense_ids(components: DataFrame) -> DataFrame:
    """Adds ``dof``: components numbered from 0 by their smallest node.

    Roots are numbered by range: each range is numbered by itself and shifted by
    the ranges before it, so no task sorts them all.
    """
    roots = durable(components.select("component").distinct().repartitionByRange("component").withColumn("__range", F.spark_partition_id()))
    sizes = roots.groupBy("__range").agg(F.count(F.lit(1)).alias("n"))
    # One row per range: as many as there are shuffle partitions.
    shift = sizes.select("__range", F.coalesce(F.sum("n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("shift"))
    numbered = roots.join(F.broadcast(shift), "__range").select(
        "component", (F.col("shift") + F.row_number().over(W.partitionBy("__range").orderBy("component")) - 1).alias("dof")
    )
    return components.join(numbered, "component")


def same_component(components: DataFrame, pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with ``connected``: whether both ends lie in one component; nodes without any edge reach themselves alone."""
    left = components.select(F.col("node").alias(a), F.col("component").alias("__a"))
    right = components.select(F.col("node").alias(b), F.col("component").alias("__b"))
    met = pairs.join(left, a, "left").join(right, b, "left")
    return met.withColumn("connected", F.coalesce("__a", a) == F.coalesce("__b", b)).drop("__a", "__b")
