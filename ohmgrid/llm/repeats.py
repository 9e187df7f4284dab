"""Removal of long byte strings that repeat anywhere in the corpus, by bucket refinement.

Every position of a text gets bucket identifiers of growing depth: the identifier
of a q-gram is refined by that of the q-gram at the later offset q, the results
are reused for the next doubling, and the last step combines two overlapping ones
to the full length.  Positions fall into the same bucket at full depth exactly if
their strings are equal, up to collisions of 128 bits.

Sorting all positions of a corpus would shuffle many times its size, so buckets
are refined only as far as they can still hold two strings, as in a suffix sort
that leaves singletons alone:

1. Each string is represented by its anchor, the position inside it whose q-gram
   bucket has the smallest identifier.  Equal strings have equal anchors, about
   one position in 70 is one, and anchors alone in their bucket are settled.
2. The strings of one anchor start in one interval.  The bucket of the anchor is
   refined by the identifier of the whole stretch of text that they cover; equal
   stretches settle all their strings at once.
3. Of each kind of stretch in an anchor bucket that holds several, one is cut into
   cells of strings that start at the same few offsets before the anchor.  Cells
   whose common core is alone in its bucket are settled, and so are equal cells.
4. The cells that are left are refined to the full depth, one of each kind, and
   equal strings are found there.

Identifiers are exchanged, counted and joined; no bucket is gathered in a task, and
the large ones are dealt into parts.  Texts are exchanged compressed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmgrid.llm import blocks
from ohmgrid.llm.common import durable

SIZE = 200
#: Strings of a cell.
CELL = 16
#: Zstandard level of exchanged texts.
PACK_LEVEL = 1
#: Bytes that are refined at once; longer texts are taken in overlapping parts.
CHUNK_BITS = 17
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def refine(bucket: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Identifiers of the buckets of pairs (bucket, bucket at a later offset)."""
    x = bucket * _A
    x ^= x >> np.uint64(29)
    x += later
    x *= _B
    x ^= x >> np.uint64(32)
    x *= _A
    return x


def gram_length(size: int) -> int:
    """Depth of the anchors' buckets: 8, 16, 32, ..., at most a third of ``size``."""
    q = 8
    while q * 2 * 3 <= size:
        q *= 2
    return q


def _combine(x: np.ndarray, depth: int, size: int) -> np.ndarray:
    """Identifiers at ``size`` from those at ``depth``, at least half of it: two overlapping ones each."""
    n = max(len(x) + depth - size, 0)
    return refine(x[:n], x[size - depth : size - depth + n])


def buckets(data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Identifiers at the depth of grams, of cells' cores and at full depth, for every position where such a string starts."""
    gram, depth = gram_length(size), 8
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    # The first bucket is the eight bytes themselves.
    x = np.ndarray(max(len(data) - 7, 0), "<u8", padded, strides=(1,))
    short = half = x
    while depth * 2 <= size:
        half, x = x, refine(x[: max(len(x) - depth, 0)], x[depth:])
        depth *= 2
        if depth == gram:
            short = x
    core = core_length(size)
    if depth > core:
        x, depth = half, depth // 2
    return short, _combine(x, depth, core), _combine(x, depth, size)


def core_length(size: int) -> int:
    """Bytes that all strings of a cell have in common."""
    return size - cell_strings(size) + 1


def cell_strings(size: int) -> int:
    """Strings of a cell; fewer where strings are short."""
    return min(CELL, size // 4)


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by block-wise running minima from both sides."""
    n = len(values) - width + 1
    full = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(values)] = values
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def parts_of(lengths: np.ndarray, size: int) -> Iterator[list[tuple[int, int, int]]]:
    """Chunks of (row, first string, number of strings) that fit a chunk's bytes; texts shorter than ``size`` have none."""
    most = (1 << CHUNK_BITS) - 2 * size
    chunk, used = [], 0
    for row in np.flatnonzero(lengths >= size):
        strings = int(lengths[row]) - size + 1
        for first in range(0, strings, most):
            count = min(most, strings - first)
            if used + count + size > 1 << CHUNK_BITS:
                yield chunk
                chunk, used = [], 0
            chunk.append((int(row), first, count))
            used += count + size - 1
    if chunk:
        yield chunk


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, bounds of each text) of an Arrow string column, without a copy; null texts are empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), bounds


def anchors_of(data: np.ndarray, bounds: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, first string, anchor's offset from it, further strings, anchor bucket, stretch bucket), chunk by chunk."""
    gram = gram_length(size)
    mask = np.uint64((1 << CHUNK_BITS) - 1)
    for chunk in parts_of(np.diff(bounds), size):
        rows, firsts, counts = (np.array(c, np.int64) for c in zip(*chunk, strict=True))
        spans = [data[bounds[r] + f : bounds[r] + f + n + size - 1] for r, f, n in chunk]
        text = np.concatenate(spans)
        begins = np.cumsum([0, *(len(s) for s in spans[:-1])])
        short, _, full = buckets(text, size)
        # The place in the low bits breaks ties to the left and tells the anchor.
        place = np.arange(len(short), dtype=np.uint64)
        least = sliding_minimum((short & ~mask) | place, size - gram + 1)
        part = np.repeat(np.arange(len(chunk)), counts)
        inside = np.arange(len(part)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = begins[part] + inside
        anchor = (least[at] & mask).astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1]))))
        ends = np.append(starts[1:], len(at)) - 1
        a, b, p = at[starts], at[ends], anchor[starts]
        yield rows[part[starts]], firsts[part[starts]] + inside[starts], p - a, b - a, short[p], cover(full, a, b, p)


def cover(full: np.ndarray, a: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Identifier of the text that the strings from ``a`` to ``b`` cover, and of the anchor's place in it."""
    return refine(full[a], full[b] + (b - a).astype(np.uint64) * _B + (p - a).astype(np.uint64))


def pack_span(first: np.ndarray, offset: np.ndarray, more: np.ndarray) -> np.ndarray:
    """One number for a first string, the anchor's offset from it and the number of further strings."""
    return (first << 18) | (offset << 9) | more


def unpack_span(span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return span >> 18, (span >> 9) & 511, span & 511


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _scan(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), list(_unpacked(batch.column(1)))
            bounds = np.cumsum([0, *map(len, texts)])
            for row, first, offset, more, anchor, stretch in anchors_of(np.concatenate(texts) if texts else np.zeros(0, np.uint8), bounds, size):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row]), pa.array(pack_span(first, offset, more)), _signed(anchor), _signed(stretch)],
                    names=["row", "span", "bucket", "name"],
                )

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=PACK_LEVEL).compress
    for batch in batches:
        data, bounds = string_bytes(batch.column("text"))
        packed = pa.array([pack(data[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], packed], names=[*batch.schema.names[:-1], "packed"])


def _unpacked(column: pa.Array) -> Iterator[np.ndarray]:
    unpack = zstandard.ZstdDecompressor().decompress
    for packed in column:
        yield np.frombuffer(unpack(packed.as_buffer()), np.uint8)


def _cells(size: int):
    """The cells of the stretches that a text was asked for: their core's bucket and the name of all they cover."""
    width = cell_strings(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, asked = batch.column("row").to_numpy(), batch.column("asked")
            for k, text in enumerate(_unpacked(batch.column("packed"))):
                spans = np.array([a["span"] for a in asked[k].as_py()], np.int64)
                anchors = np.array([a["bucket"] for a in asked[k].as_py()], np.int64).view(np.uint64)
                out = []
                for first, offset, more, anchor in zip(*unpack_span(spans), anchors, strict=True):
                    _, core, full = buckets(text[first : first + more + size], size)
                    # Cells by the distance to the anchor: the same for all stretches of a bucket.
                    cell = np.arange((offset - more) // width, offset // width + 1)
                    a = np.maximum(offset - (cell + 1) * width + 1, 0)
                    b = np.minimum(offset - cell * width, more)
                    # The core starts with the cell's last string and ends inside the stretch, whether or not that has the string.
                    own = core[offset - cell * width]
                    name = cover(full, a, b, np.full(len(a), offset))
                    bucket = refine(own, anchor + cell.astype(np.uint64))
                    out.append((pack_span(first + a, offset - a, b - a), np.full(len(a), anchor), bucket, name))
                span, anchor, bucket, name = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(span), ids[k])), pa.array(span), _signed(anchor), _signed(bucket), _signed(name)],
                    names=["row", "span", "anchor", "bucket", "name"],
                )

    return run


def _strings(size: int):
    """Every string of the cells that a text was asked for, with its bucket at full depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, asked = batch.column("row").to_numpy(), batch.column("asked")
            for k, text in enumerate(_unpacked(batch.column("packed"))):
                spans = np.array([a["span"] for a in asked[k].as_py()], np.int64)
                anchors = np.array([a["anchor"] for a in asked[k].as_py()], np.int64)
                at, anchor, name = [], [], []
                for first, _, more, own in zip(*unpack_span(spans), anchors, strict=True):
                    at.append(np.arange(first, first + more + 1))
                    anchor.append(np.full(more + 1, own))
                    name.append(buckets(text[first : first + more + size], size)[2])
                at = np.concatenate(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), ids[k])), pa.array(pack_span(at, 0, 0)), pa.array(np.concatenate(anchor)), _signed(np.concatenate(name))],
                    names=["row", "span", "bucket", "name"],
                )

    return run


def merged(spans: np.ndarray, size: int) -> np.ndarray:
    """int64[k, 2]: maximal removed runs (start, end) of packed spans."""
    spans = np.sort(spans)
    start, _, more = unpack_span(spans)
    end = start + more + size
    reach = np.maximum.accumulate(end)
    new = np.concatenate(([True], start[1:] > reach[:-1]))
    firsts = np.flatnonzero(new)
    return np.column_stack((start[firsts], reach[np.append(firsts[1:], len(start)) - 1]))


def _removed(size: int, key: str, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, n_spans, digests, kept_texts = [], [], [], [], []
            for own, spans in zip(_unpacked(batch.column("packed")), batch.column("spans"), strict=True):
                runs = merged(np.array(spans.as_py(), np.int64), size) if spans.is_valid and len(spans) else np.zeros((0, 2), np.int64)
                cuts = np.concatenate(([0], runs.ravel(), [len(own)]))
                kept = b"".join(own[a:b].tobytes() for a, b in zip(cuts[::2], cuts[1::2], strict=True))
                n_bytes.append(len(own))
                n_removed.append(len(own) - len(kept))
                n_spans.append(len(runs))
                digests.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept if with_text else None)
            columns = [batch.column("key"), *(pa.array(c, pa.int64()) for c in (n_bytes, n_removed, n_spans)), pa.array(digests, pa.string())]
            names = [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns.append(pa.array(kept_texts, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans whose strings repeat, one span of each name in the buckets that hold several names).

    ``rows`` has (row, span, bucket, name, ...).  A bucket of one row is settled; so
    is one of a single name, and a name that several rows have.
    """
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("least"), F.max("name").alias("most"))
    shared = durable(shared.where(F.col("n") > 1).select("bucket", "n", (F.col("least") != F.col("most")).alias("mixed")))
    met = durable(blocks.dealt_join(rows, shared, ["bucket"], ["row", "span"]))
    mixed = met.where("mixed").drop("mixed")
    first = F.min(F.struct("row", "span", *[c for c in rows.columns if c not in ("row", "span", "bucket", "name")])).alias("one")
    kinds = durable(mixed.groupBy("bucket", "name").agg(F.count(F.lit(1)).alias("n"), first))
    equal = blocks.dealt_join(mixed, kinds.where(F.col("n") > 1).select("bucket", "name", "n"), ["bucket", "name"], ["row", "span"])
    settled = met.where(~F.col("mixed")).select("row", "span").unionAll(equal.select("row", "span"))
    return settled, kinds.select("one.*", "bucket")


def remove_repeats(documents: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, with_text: bool = False) -> DataFrame:
    """One row per document: key, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the remaining bytes).

    A byte is removed if it lies in a string of ``size`` bytes that starts at any
    other place of the same or another document; strings never cross documents and
    are judged on the input alone.  Null texts are empty.  Repeated rows are other
    documents; keys may repeat or be null.  Other columns are ignored.  ``size`` is
    24 to 500.  Rows are numbered once and stored with their numbers, compressed,
    so it does not matter in which splits they are read again.
    """
    if not 24 <= size <= 500:
        raise ValueError(f"size {size} is not in 24..500")
    rows = documents.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")
    )
    kind = rows.select("key").schema[0].dataType.simpleString()
    texts = durable(rows.mapInArrow(_pack, f"row long, key {kind}, packed binary"))

    def read_again(asked: DataFrame, what: str, kernel, schema: str) -> DataFrame:
        by_text = asked.select("row", F.struct("span", what).alias("asked")).groupBy("row").agg(F.collect_list("asked").alias("asked"))
        return texts.select("row", "packed").join(by_text, "row").select("row", "packed", "asked").mapInArrow(kernel(size), schema)

    stretches = texts.select("row", "packed").mapInArrow(_scan(size), "row long, span long, bucket long, name long")
    in_stretches, asked = _split(stretches)
    cells = durable(read_again(asked, "bucket", _cells, "row long, span long, anchor long, bucket long, name long"))
    in_cells, asked = _split(cells)
    strings = durable(read_again(asked, "anchor", _strings, "row long, span long, bucket long, name long"))
    twice = durable(strings.groupBy("bucket", "name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))
    found = blocks.dealt_join(strings, twice, ["bucket", "name"], ["row", "span"])
    spans = in_stretches.unionAll(in_cells).unionAll(found.select("row", "span"))
    by_text = spans.groupBy("row").agg(F.collect_list("span").alias("spans"))
    schema = f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return texts.join(by_text, "row", "left").select("key", "packed", "spans").mapInArrow(_removed(size, key, with_text), schema)


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the strings of 200 bytes that repeat."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
