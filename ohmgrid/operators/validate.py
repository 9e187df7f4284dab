"""Checks of boards, studies and drafts as counts of offending rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that more than one row has."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def unknown(df: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
    """Rows whose reference is not null and not among the known keys."""
    return df.where(F.col(column).isNotNull()).join(known.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def disordered(layers: DataFrame, board: list[str], index: str) -> DataFrame:
    """Boards whose stackup indices do not strictly grow in the order of ``pos``."""
    along = W.partitionBy(*board).orderBy("pos") if board else W.orderBy("pos")
    return layers.withColumn("__p", F.lag(index).over(along)).where(F.col(index) <= F.col("__p")).select(*board, index)


def overlaps(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Members that both sides have, such as a terminal that is source and load."""
    return left.select(*columns).intersect(right.select(*columns))


def report(checks: dict[str, DataFrame]) -> DataFrame:
    """(name, passed): a check passes if it has no offending row; each looks for one row only."""
    rows = [
        offending.limit(1).agg((F.count(F.lit(1)) == 0).alias("passed")).select(F.lit(name).alias("name"), "passed") for name, offending in checks.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def all_passed(checks: DataFrame) -> DataFrame:
    return checks.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"))


def first_fault(faults: dict[str, Column]) -> Column:
    """Name of the first rule that a row breaks, or null; a rule whose value is null is not broken."""
    out = F.lit(None).cast("string")
    for name, broken in reversed(list(faults.items())):
        out = F.when(broken, name).otherwise(out)
    return out


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def draft_faults(drafts: DataFrame, ceilings: dict[str, float]) -> DataFrame:
    """``drafts`` with ``fault``, the first broken rule.

    Columns: kind, accuracy, source_ids, to_ids (arrays), loads (array of struct
    ids, current), voltage, policy (struct passes, dofs, target) or null.
    """
    load_ids = F.flatten(F.transform(F.coalesce("loads", F.array()), lambda x: x["ids"]))
    currents = F.transform(F.coalesce("loads", F.array()), lambda x: x["current"])
    reference = F.col("accuracy") == "reference"
    rules = {
        "no source": F.size(F.coalesce("source_ids", F.array())) == 0,
        "voltage is not finite": ~finite(F.col("voltage")),
        "an IR drop needs a load": (F.col("kind") == "ir_drop") & (F.size(load_ids) == 0),
        "a resistance has no loads": (F.col("kind") == "resistance") & (F.size(load_ids) > 0),
        "a resistance needs a far end": (F.col("kind") == "resistance") & (F.size(F.coalesce("to_ids", F.array())) == 0),
        "current is not positive": F.exists(currents, lambda a: ~(finite(a) & (a > 0))),
        "source and load overlap": F.arrays_overlap("source_ids", load_ids),
        "source and far end overlap": F.arrays_overlap("source_ids", F.coalesce("to_ids", F.array())),
        "a load is named twice": F.size(F.array_distinct(load_ids)) < F.size(load_ids),
        "a policy needs the reference profile": F.col("policy").isNotNull() & ~reference,
        "the reference profile needs a policy": F.col("policy").isNull() & reference,
        "too many passes": F.col("policy.passes") > ceilings["passes"],
        "too many unknowns": F.col("policy.dofs") > ceilings["dofs"],
        "target is out of bounds": ~F.col("policy.target").between(1e-6, 0.5),
    }
    return drafts.withColumn("fault", first_fault(rules))
