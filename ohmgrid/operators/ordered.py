"""Operators on ordered series: changes, streaks, extrapolation, marking, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ohmgrid.operators import ranges


def relative_change(value: Column, previous: Column) -> Column:
    """Movement as a fraction of the previous value; null for the first and after zero."""
    return F.when(previous != 0, F.abs(value - previous) / F.abs(previous))


def with_change(df: DataFrame, series: list[str], order: list[str], value: str, out: str = "change") -> DataFrame:
    return df.withColumn(out, relative_change(F.col(value), F.lag(value).over(W.partitionBy(*series).orderBy(*order))))


def streaks(df: DataFrame, series: list[str], order: list[str], success: Column) -> DataFrame:
    """Per series: its longest and its last run of successes in a row; a failure or null resets."""
    along = W.partitionBy(*series).orderBy(*order)
    ok = F.coalesce(success, F.lit(False))
    marked = df.select(*series, *order, ok.alias("__ok"))
    islands = marked.withColumn("__island", F.sum(F.when(F.col("__ok"), 0).otherwise(1)).over(along))
    lengths = islands.groupBy(*series, "__island").agg(F.sum(F.when(F.col("__ok"), 1).otherwise(0)).alias("__n"))
    return lengths.groupBy(*series).agg(F.max("__n").cast("long").alias("longest"), F.max_by("__n", "__island").cast("long").alias("current"))


def last_values(df: DataFrame, series: list[str], order: list[str], columns: list[str], n: int = 3) -> DataFrame:
    """Per series, the last ``n`` rows as columns c_1 (last), c_2, ...; null where there are fewer."""
    back = F.row_number().over(W.partitionBy(*series).orderBy(*[F.col(c).desc() for c in order]))
    recent = df.withColumn("__k", back).where(F.col("__k") <= n)
    return recent.groupBy(*series).agg(
        *[F.max(F.when(F.col("__k") == k, F.col(c))).alias(f"{c}_{k}") for c in columns for k in range(1, n + 1)]
    )


def richardson(v1: Column, v2: Column, v3: Column, dofs1: Column, dofs2: Column) -> Column:
    """struct(limit, rate) extrapolated from the last three values (v1 last), or null.

    Both steps must go one way and shrink, the problem must have grown, and the
    observed rate must lie in 0.5..6; otherwise nothing is claimed.
    """
    early, late = v2 - v3, v1 - v2
    ratio = F.sqrt(dofs1 / dofs2)
    rate = F.ln(F.abs(early / late)) / F.ln(ratio)
    shrinking = (early * late > 0) & (F.abs(late) < F.abs(early)) & (dofs1 > dofs2) & (dofs2 > 0)
    safe_rate = F.when(shrinking, rate)
    return F.when(safe_rate.between(0.5, 6.0), F.struct((v1 + late / (F.pow(ratio, safe_rate) - 1)).alias("limit"), safe_rate.alias("rate")))


def verdict(change: Column, target: float, singular: Column) -> Column:
    """``converged``, ``moving`` or ``singular``; a singular quantity never converges and a first value is moving."""
    return F.when(singular, "singular").when(change <= target, "converged").otherwise("moving")


def doerfler(df: DataFrame, group: list[str], error: str, theta: tuple[int, int]) -> DataFrame:
    """Per group: the fewest rows, largest errors first, whose squares reach theta of the total of squares.

    Returns total, n_marked, threshold (every larger error is marked) and
    n_at_threshold (how many of that error are).  Errors are integers; they are
    counted first, and sums are carried over sorted ranges of distinct values.
    """
    num, den = theta
    square = F.col(error) * F.col(error)
    counted = df.groupBy(*group, F.col(error).alias("__e"), square.alias("__s")).agg(F.count(F.lit(1)).alias("__n"))
    mass = F.col("__s") * F.col("__n")
    laid = ranges.numbered(counted, group, [F.col("__e").desc()], "__k", sums={"__cum": mass, "__rows": F.col("__n")}, totals={"__cum": "total"})
    # What is marked before a value.
    run = laid.withColumns({"__cum": F.col("__cum") - mass, "__rows": F.col("__rows") - F.col("__n")})
    # Marking goes on while what is marked so far falls short.
    cut = run.where((F.col("__cum") * den < F.col("total") * num) & (F.col("__s") > 0))
    last = cut.groupBy(*group, "total").agg(F.min_by(F.struct("__e", "__s", "__n", "__cum", "__rows"), "__e").alias("z"))
    missing = F.col("total") * num - F.col("z.__cum") * den
    step = F.col("z.__s") * den
    at = F.least(F.col("z.__n"), F.call_function("div", missing + step - 1, step))
    return last.select(*group, "total", (F.col("z.__rows") + at).alias("n_marked"), F.col("z.__e").alias("threshold"), at.alias("n_at_threshold"))


def mark(df: DataFrame, group: list[str], error: str, ties: list[str], theta: tuple[int, int]) -> DataFrame:
    """The marked rows themselves; equal errors are marked in the order of ``ties``, numbered over ranges of them."""
    cut = doerfler(df, group, error, theta).select(*group, "threshold", "n_at_threshold")
    met = df.join(cut, group) if group else df.crossJoin(F.broadcast(cut))
    above = met.where(F.col(error) > F.col("threshold")).select(*df.columns)
    at = met.where(F.col(error) == F.col("threshold"))
    k, = ranges.free_names(at, "k")
    placed = ranges.numbered(at, group, [F.col(c).asc() for c in ties], k)
    return above.unionByName(placed.where(F.col(k) < F.col("n_at_threshold")).select(*df.columns))


def adjacent_pairs(df: DataFrame, series: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Each row with the next of its series: c and next_c; the last row of a series has no pair."""
    along = W.partitionBy(*series).orderBy(*order)
    paired = df.select(*series, *columns, *[F.lead(c).over(along).alias(f"next_{c}") for c in columns], F.lead(F.lit(True)).over(along).alias("__more"))
    return paired.where(F.col("__more")).drop("__more")


def dangling(df: DataFrame, key: list[str], member: str, least: int = 2) -> DataFrame:
    """(key, n) of those with fewer than ``least`` distinct members."""
    return df.groupBy(*key).agg(F.countDistinct(member).alias("n")).where(F.col("n") < least)


def monotone(df: DataFrame, series: list[str], order: list[str], value: str) -> DataFrame:
    """Per series: whether every value is smaller than the one before."""
    stepped = df.select(*series, F.col(value).alias("__v"), F.lag(value).over(W.partitionBy(*series).orderBy(*order)).alias("__p"))
    return stepped.groupBy(*series).agg(F.coalesce(F.bool_and(F.col("__v") < F.col("__p")), F.lit(True)).alias("decreasing"), F.count(F.lit(1)).alias("n"))


def claim_next(queue: DataFrame, state: str, queued: str, order: list[str], n: int = 1) -> DataFrame:
    """The next ``n`` rows of the queue: a top-k, so no task sorts it all."""
    return queue.where(F.col(state) == queued).orderBy(*order).limit(n)


def latest_by(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by partial aggregation: rows of a key never meet in one task."""
    rest = [c for c in df.columns if c not in key and c not in order]
    last = df.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("z"))
    return last.select(*key, *[F.col(f"z.{c}").alias(c) for c in df.columns if c not in key])


def admitted(queue: DataFrame, lane: list[str], order: list[str], need: Column, budget: int) -> DataFrame:
    """Running total of ``need`` along each lane of the queue, carried over ranges of it, and whether it stays within the budget."""
    place, = ranges.free_names(queue, "place")
    laid = ranges.numbered(queue, lane, [F.col(c).asc() for c in order], place, sums={"committed": need}).drop(place)
    return laid.withColumn("admitted", F.col("committed") <= budget)


def most_recent(events: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The ``n`` keys that were touched last, most recent first, with the time of the last touch."""
    last = events.groupBy(key).agg(F.max(F.struct(*order)).alias("z")).select(key, *[F.col(f"z.{c}").alias(c) for c in order])
    return last.orderBy(*[F.col(c).desc() for c in order], F.col(key)).limit(n)
