"""Weighted statistics: quantiles by running weight, ranges, histograms, conservation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ohmgrid.operators import ranges


def weighted_quantiles(df: DataFrame, group: list[str], value: str, weight: Column, fractions: dict[str, tuple[int, int]]) -> DataFrame:
    """Per group, the smallest value at which the running weight reaches a fraction (numerator, denominator) of the total.

    Equal values are summed first, and the running weight is carried over sorted ranges
    of (group, value), so a group may have any number of distinct values.  Integer weights make the
    result independent of row order.
    """
    values = df.groupBy(*group, F.col(value).alias("__v")).agg(F.sum(weight).alias("__w"))
    running = ranges.numbered(values, group, [F.col("__v").asc()], "__k", sums={"__r": F.col("__w")}, totals={"__r": "__t"})
    return running.groupBy(*group).agg(
        *[F.min(F.when(F.col("__r") * den >= F.col("__t") * num, F.col("__v"))).alias(name) for name, (num, den) in fractions.items()]
    )


def twentieth(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Per group, 20 times the linearly interpolated 5th percentile of integers, exact; values are counted before they are ordered."""
    counted = df.groupBy(*group, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    running = ranges.numbered(counted, group, [F.col("__v").asc()], "__k", sums={"__r": F.col("__n")}, totals={"__r": "__t"})
    run = running.select(*group, "__v", "__r", (F.col("__t") - 1).alias("__m"))
    at = F.call_function("div", F.col("__m"), F.lit(20))
    low = F.min(F.when(F.col("__r") > at, F.col("__v")))
    high = F.min(F.when(F.col("__r") > F.least(at + 1, F.col("__m")), F.col("__v")))
    rest = F.max("__m") % 20
    return run.groupBy(*group).agg((low * (20 - rest) + high * rest).alias("p05_x20"))


def weighted_mean_peak(df: DataFrame, group: list[str], value: Column, weight: Column) -> DataFrame:
    """Per group: weighted_sum, weight, peak; the mean is their quotient, left to the reader so that integers stay exact."""
    return df.groupBy(*group).agg(F.sum(value * weight).alias("weighted_sum"), F.sum(weight).alias("weight"), F.max(value).alias("peak"))


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """(bin, n) of values over [min, max], both clamped into the first and last bin."""
    bounds = df.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    share = (value - F.col("__lo")) / F.when(F.col("__hi") > F.col("__lo"), F.col("__hi") - F.col("__lo")).otherwise(1.0)
    number = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(share * bins))).cast("int")
    # The bounds are one row.
    return df.crossJoin(F.broadcast(bounds)).groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def auto_range(df: DataFrame, group: list[str], value: str, weight: Column) -> DataFrame:
    """Display range per group: the least value, and the area-weighted 99.5th percentile as the upper clip."""
    low = df.groupBy(*group).agg(F.min(value).alias("low"), F.max(value).alias("peak"))
    clip = weighted_quantiles(df, group, value, weight, {"high": (995, 1000)})
    return low.join(clip, group)


def log_log_slope(df: DataFrame, group: list[str], x: Column, y: Column) -> DataFrame:
    """Least-squares slope of ln y over ln x: the observed order of convergence."""
    return df.where((x > 0) & (y > 0)).groupBy(*group).agg(F.regr_slope(F.ln(y), F.ln(x)).alias("slope"), F.count(F.lit(1)).alias("n"))


def conservation(sources: DataFrame, loads: DataFrame, dissipated: DataFrame) -> DataFrame:
    """One row: source and load totals, imbalance and power mismatch as fractions, and a verdict.

    ``sources`` and ``loads`` have (voltage, current), ``dissipated`` has (power).
    Warned above 1e-6, refused above 1e-3.
    """
    s = sources.agg(F.coalesce(F.sum("current"), F.lit(0.0)).alias("source_a"), F.coalesce(F.sum(F.col("voltage") * F.col("current")), F.lit(0.0)).alias("in_w"))
    l_ = loads.agg(F.coalesce(F.sum("current"), F.lit(0.0)).alias("load_a"), F.coalesce(F.sum(F.col("voltage") * F.col("current")), F.lit(0.0)).alias("out_w"))
    d = dissipated.agg(F.coalesce(F.sum("power"), F.lit(0.0)).alias("dissipated_w"))
    one = s.crossJoin(l_).crossJoin(d).withColumn("terminal_w", F.col("in_w") - F.col("out_w"))
    imbalance = F.abs(F.col("source_a") - F.col("load_a")) / F.greatest(F.abs("source_a"), F.abs("load_a"), F.lit(1e-30))
    mismatch = F.abs(F.col("terminal_w") - F.col("dissipated_w")) / F.greatest(F.abs("terminal_w"), F.abs("dissipated_w"), F.lit(1e-30))
    worst = F.greatest("imbalance_fraction", "power_mismatch_fraction")
    return one.withColumns({"imbalance_fraction": imbalance, "power_mismatch_fraction": mismatch}).withColumn(
        "severity", F.when(worst > 1e-3, "error").when(worst > 1e-6, "warning").otherwise("ok")
    )


def reference_voltage(df: DataFrame, group: list[str], voltage: str) -> DataFrame:
    """Per group, the largest finite potential; null if there is none."""
    v = F.col(voltage)
    return df.groupBy(*group).agg(F.max(F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)).alias("reference"))
