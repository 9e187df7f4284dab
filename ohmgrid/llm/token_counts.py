"""Token counts by section, attributed through character offsets.

Each document is encoded once, as a whole.  The character spans of its tokens are
joined by interval to the spans of its sections; a token that crosses a boundary
belongs to the section that holds most of its bytes, the earlier one on a tie.
So the counts of the sections add up to the document's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmgrid.llm import tokens

COUNTS = "section int, start long, n_chars long, n_tokens long, n_crossing long"


def token_ends(ids: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """Byte offset after each token; byte-level tokens cover the text's bytes without gaps."""
    return np.cumsum(n_bytes[ids])


def section_bounds(raw: np.ndarray, separator: int = 0x0A) -> np.ndarray:
    """Byte offsets 0, ..., n: sections are lines, each with the line feed that ends it."""
    return np.unique(np.concatenate(([0], np.flatnonzero(raw == separator) + 1, [len(raw)])))


def attribute(ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(section of each token, whether it crosses a boundary) for sorted token ends and section bounds in bytes."""
    starts = np.concatenate(([0], ends))[:-1]
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends, "left") - 1
    section = first.copy()
    for t in np.flatnonzero(last > first):
        cuts = np.concatenate(([starts[t]], bounds[first[t] + 1 : last[t] + 1], [ends[t]]))
        section[t] = first[t] + int(np.argmax(np.diff(cuts)))
    return section, last > first


def count_sections(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """One row per section: key, section (from 0), start and n_chars (code points), n_tokens, n_crossing.

    ``n_crossing`` counts the section's tokens that reach into another section.
    Null and empty texts have one empty section without tokens.  Repeated rows and
    keys, null ones too, are each counted; other columns are ignored.
    """
    path = path or tokens.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path)
        for batch in batches:
            at, columns = [], [[] for _ in range(5)]
            for row, value in enumerate(batch.column(1)):
                text = value.as_py() or ""
                raw = np.frombuffer(text.encode(), np.uint8)
                bounds = section_bounds(raw)
                if len(bounds) == 1:
                    bounds = np.array([0, 0])
                section, crossing = attribute(token_ends(encoder.ids(text), encoder.n_bytes), bounds)
                chars = bounds if text.isascii() else np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[bounds]
                n = len(bounds) - 1
                at.append(np.full(n, row))
                for column, values in zip(
                    columns,
                    (np.arange(n), chars[:-1], np.diff(chars), np.bincount(section, minlength=n), np.bincount(section[crossing], minlength=n)),
                    strict=True,
                ):
                    column.append(values)
            if at:
                keys = batch.column(0).take(pa.array(np.concatenate(at)))
                kinds = (pa.int32(), *[pa.int64()] * 4)
                values = [pa.array(np.concatenate(c).astype(np.int64)).cast(k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([keys, *values], names=[key, "section", "start", "n_chars", "n_tokens", "n_crossing"])

    source = documents.select(key, F.col(text).cast("string"))
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"`{key}` {kind}, {COUNTS}")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return count_sections(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
