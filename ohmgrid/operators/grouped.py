"""Python over the rows of each group, many groups to a batch.

Groups are met in sorted batches instead of one by one, as a call for each costs more than
the work of a small group.  A group is held whole, nothing else is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a batch that is made.
ROWS = 4096


def map_groups(df: DataFrame, keys: list[str], order: list[str], run: Callable[[tuple, list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """The rows that ``run`` makes of each group's key and rows, the columns beside ``keys`` in their order, sorted by ``order``; a null is a key of its own."""
    kept = [c for c in df.columns if c not in keys]
    kind = StructType.fromDDL(schema)
    n = len(keys)

    def batches_of(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(kind)
        key, held, made = None, [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:n] != key:
                    if held:
                        made += run(key, held)
                        if len(made) >= ROWS:
                            yield batches_of(made, arrow)
                            made = []
                    key, held = row[:n], []
                held.append(row[n:])
        if held:
            made += run(key, held)
        yield batches_of(made, arrow)

    dealt = df.select(*keys, *kept).repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(each, kind)
