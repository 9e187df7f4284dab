"""Numbers and running sums over sorted ranges, so that no task holds a whole group.

Rows are dealt to ranges of (group, order), numbered inside their range, and the
counts and sums of the ranges before are carried over.  A group of any size is as
many ranges as it fills; what is carried is a row for each range and group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ohmgrid.functions.storage import durable, small_side


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until no column of ``df`` begins with it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while any(c.startswith(name.lower()) for c in taken):
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(
    df: DataFrame, group: list[str], order: list[Column], number: str = "number", total: str | None = None, sums: dict[str, Column] | None = None, totals: dict[str, str] | None = None
) -> DataFrame:
    """``df`` with the ``number`` of each row in its group, from 0, and running ``sums`` up to and with the row.

    ``total`` names a column for the rows of the group, ``totals`` one for the whole of each sum.  Rows that are equal in ``order`` come in
    any order, but are spread over ranges only by columns that ``order`` names.  A null in
    ``group`` is a group of its own, the first; an empty table gives no rows.  The
    sorted rows are stored once, so that numbers stay when executors are lost.
    """
    sums, totals = sums or {}, totals or {}
    part, at, first, before, rows = free_names(df, "part", "at", "first", "before", "rows")
    keys = [*[F.col(f"`{g}`").asc_nulls_first() for g in group], *order]
    laid = df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df
    laid = durable(laid.withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id()}))
    cells = [part, *[f"`{g}`" for g in group]]
    own = [F.coalesce(F.sum(v), F.lit(0)).alias(f"{before}{k}") for k, v in enumerate(sums.values())]
    parts = laid.groupBy(*cells).agg(F.count(F.lit(1)).alias(rows), F.min(at).alias(first), *own)
    whole = W.partitionBy(*[f"`{g}`" for g in group])
    earlier = whole.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    carried = {before: F.coalesce(F.sum(rows).over(earlier), F.lit(0)), rows: F.sum(rows).over(whole)}
    carried |= {f"{before}{k}": F.coalesce(F.sum(f"{before}{k}").over(earlier), F.lit(0)) for k in range(len(sums))}
    carried |= {f"{rows}{k}": F.coalesce(F.sum(f"{before}{k}").over(whole), F.lit(0)) for k in range(len(sums))}
    renamed = {g: name for g, name in zip(group, free_names(df, *[f"group{k}" for k in range(len(group))]), strict=True)}
    ranges = parts.select(F.col(part).alias(f"{part}0"), first, *[F.col(f"`{g}`").alias(n) for g, n in renamed.items()], *[v.alias(c) for c, v in carried.items()])
    met = F.col(part) == F.col(f"{part}0")
    for g, n in renamed.items():
        met &= F.col(f"`{g}`").eqNullSafe(F.col(n))
    inside = W.partitionBy(*cells).orderBy(at).rowsBetween(W.unboundedPreceding, 0)
    running = {name: F.sum(v).over(inside) for name, v in sums.items()}
    out = laid.withColumns(running).join(small_side(durable(ranges)), met)
    made = {number: F.col(before) + F.col(at) - F.col(first)}
    made |= {name: F.coalesce(F.col(name), F.lit(0)) + F.col(f"{before}{k}") for k, name in enumerate(sums)}
    made |= {total: F.col(rows)} if total else {}
    made |= {totals[name]: F.col(f"{rows}{k}") for k, name in enumerate(sums) if name in totals}
    kept = [c for c in df.columns if c not in made]
    return out.select(*[f"`{c}`" for c in kept], *[v.alias(c) for c, v in made.items()])
