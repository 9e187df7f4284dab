"""Best-fit packing of token pieces into sequences, improved by swaps.

Documents are cut into full pieces, which are sequences of their own, and at most
one shorter first piece.  Shorter pieces have fewer than ``capacity`` lengths, so
the packing is planned on their histogram: bins with the same contents are one
group with a count.  A best-fit start is followed by a local search over the
underfull groups, which moves pieces and exchanges one for one, two for one or
one for two so that the sum of squared fills grows, until bins are empty and no
exchange helps.  An exchange is made in as many equal bins at once as there are, and of
many equal bins bundles are exchanged, so that the work on the driver is bounded.  The pieces are
then dealt to its slots by their rank among the pieces of their length, in
parallel and without collecting any of them.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ohmgrid.llm import tokens
from ohmgrid.llm.common import durable

CAPACITY = 1024
END = 2
#: Underfull bins, or bundles of equal ones, that are searched at once on the driver.
UNITS = 1 << 17

PIECES = "piece int, start long, length long, ids_crc32 long, task int, rank long"


def cut_pieces(documents: DataFrame, key: str, text: str, capacity: int, path: str, end: int) -> DataFrame:
    """One row per piece, with its task and its rank among the task's pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path).ids
        task, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows = defaultdict(list)
            for at, value in enumerate(batch.column(1)):
                ids = np.append(encode(value.as_py() or ""), np.uint32(end)).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                starts = [0, *range(first, len(ids), capacity)]
                for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    rows["at"].append(at)
                    rows["piece"].append(piece)
                    rows["start"].append(a)
                    rows["length"].append(b - a)
                    rows["ids_crc32"].append(zlib.crc32(ids[a:b].tobytes()))
                    rows["rank"].append(seen[b - a])
                    seen[b - a] += 1
            keys = batch.column(0).take(pa.array(rows["at"], pa.int64()))
            cols = [pa.array(rows[c], t) for c, t in (("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()))]
            cols += [pa.array([task] * len(keys), pa.int32()), pa.array(rows["rank"], pa.int64())]
            yield pa.RecordBatch.from_arrays([keys, *cols], names=[key, "piece", "start", "length", "ids_crc32", "task", "rank"])

    source = documents.select(key, F.col(text).cast("string"))
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"`{key}` {kind}, {PIECES}")


Pattern = tuple[int, ...]


class Held:
    """What bins can give back, by the room that giving it back makes: the smallest size for each room."""

    def __init__(self, capacity: int):
        #: count[f, s]: groups of bins with f free that hold the size s.
        self.count = np.zeros((capacity + 1, capacity + 1), np.int32)
        #: least[f + s]: the smallest such s, or more than any.
        self.none = capacity + 1
        self.least = np.full(2 * capacity + 2, self.none, np.int64)

    def put(self, free: int, sizes: np.ndarray) -> None:
        self.count[free, sizes] += 1
        self.least[free + sizes] = np.minimum(self.least[free + sizes], sizes)

    def take(self, free: int, sizes: np.ndarray) -> None:
        self.count[free, sizes] -= 1
        for s in sizes[(self.count[free, sizes] == 0) & (self.least[free + sizes] == sizes)]:
            room = free + s
            others = np.arange(max(1, room - len(self.count) + 1), min(room, len(self.count) - 1) + 1)
            found = others[self.count[room - others, others] > 0]
            self.least[room] = found[0] if len(found) else self.none

    def smallest(self, low: int, high: int, below: int) -> tuple[int, int] | None:
        """(free, size) of the smallest size under ``below`` whose room is in low..high - 1."""
        least = self.least[low:high]
        if not len(least):
            return None
        k = int(least.argmin())
        return (low + k - int(least[k]), int(least[k])) if least[k] < below else None


class Bins:
    """Groups of bins with the same contents (lengths, longest first), found by free space and by content."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.full: Counter[Pattern] = Counter()
        self.open: dict[int, Counter[Pattern]] = defaultdict(Counter)
        #: The free spaces as bits.
        self.frees = 0
        self.one, self.two = Held(capacity), Held(capacity)
        self.sums: dict[Pattern, np.ndarray] = {}

    def add(self, pattern: Pattern, count: int) -> None:
        if not count or not pattern:
            return
        free = self.capacity - sum(pattern)
        if not free:
            self.full[pattern] += count
            return
        group = self.open[free]
        before = group[pattern]
        group[pattern] = before + count
        if bool(before) == bool(before + count):
            return
        if before:
            del group[pattern]
            if not group:
                del self.open[free]
                self.frees ^= 1 << free
        else:
            self.frees |= 1 << free
        for held, sizes in ((self.one, np.array(sorted(set(pattern)))), (self.two, self.pair_sums(pattern))):
            (held.take if before else held.put)(free, sizes)

    def pair_sums(self, pattern: Pattern) -> np.ndarray:
        if pattern not in self.sums:
            p = np.array(pattern)
            i, j = np.triu_indices(len(p), 1)
            self.sums[pattern] = np.unique(p[i] + p[j])
        return self.sums[pattern]

    def tightest(self, length: int) -> int | None:
        """Smallest free space of at least ``length``."""
        above = self.frees >> length
        return length + (above & -above).bit_length() - 1 if above else None

    def holding(self, free: int, length: int) -> Pattern:
        return min(p for p in self.open[free] if length in p)

    def holding_two(self, free: int, size: int) -> tuple[Pattern, tuple[int, int]]:
        """A bin and two of its pieces of that size together."""
        pattern = min(p for p in self.open[free] if size in self.pair_sums(p))
        a = next(x for k, x in enumerate(pattern) if size - x in pattern[k + 1 :])
        return pattern, (a, size - a)


def without(pattern: Pattern, *lengths: int) -> Pattern:
    left = list(pattern)
    for s in lengths:
        left.remove(s)
    return tuple(left)


def plus(pattern: Pattern, *lengths: int) -> Pattern:
    return tuple(sorted((*pattern, *lengths), reverse=True))


def best_fit(histogram: dict[int, int], capacity: int) -> Bins:
    """Longest pieces first, each into the fullest bin that has room; equal bins are filled together."""
    bins = Bins(capacity)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            free = bins.tightest(length)
            if free is None:
                each = capacity // length
                bins.add((length,) * each, left // each)
                bins.add((length,) * (left % each), 1)
                break
            pattern, count = max(bins.open[free].items())
            n = min(count, left)
            bins.add(pattern, -n)
            bins.add(plus(pattern, length), n)
            left -= n
    return bins


def _exchange(bins: Bins, donor: Pattern, give: tuple[int, ...]) -> tuple[int, Pattern, tuple[int, ...]] | None:
    """What a bin can take ``give`` for: (its free space, its contents, what it gives back), the least given back first.

    The donor's own bin is not in ``bins``.  Squared fill grows if the taker ends
    up fuller than the donor was: the room it makes is under ``most``.
    """
    size, most = sum(give), bins.capacity + sum(give) - sum(donor)
    room = bins.tightest(size)
    if room is not None and room < most:
        return room, min(bins.open[room]), ()
    found = bins.one.smallest(size, most, size)
    if found:
        return found[0], bins.holding(*found), (found[1],)
    if len(give) == 1 and (found := bins.two.smallest(size, most, size)):  # one for two
        pattern, back = bins.holding_two(*found)
        return found[0], pattern, back
    return None


def improve(bins: Bins, floor: int) -> Bins:
    """Empties the emptiest bins by moves and exchanges, until there are ``floor`` bins or none can give anything.

    All bins of equal contents give together, to as many equal bins as there are: an exchange
    uses up a group on one side.  Only if no other bins can take are they split into halves that
    give and take.  So a histogram with all counts multiplied takes the same exchanges.
    """
    n = sum(bins.full.values()) + sum(sum(c.values()) for c in bins.open.values())
    gained = True
    while gained and n > floor:
        gained = False
        for start in [p for f in sorted(bins.open, reverse=True) for p in sorted(bins.open[f])]:
            free = bins.capacity - sum(start)
            held = bins.open[free][start] if free in bins.open else 0
            if not held or n <= floor:
                continue
            bins.add(start, -held)
            donor = start
            while donor and held:
                gives = [(x,) for x in sorted(set(donor), reverse=True)]
                gives += dict.fromkeys((a, b) for i, a in enumerate(donor) for b in donor[i + 1 :])
                found = next(((give, met) for give in gives if (met := _exchange(bins, donor, give))), None)
                if not found and donor == start and held > 1:
                    # Nothing else can take: one half may give to the other.
                    bins.add(start, held - held // 2)
                    held //= 2
                    found = next(((give, met) for give in gives if (met := _exchange(bins, donor, give))), None)
                if not found:
                    break
                give, (room, taker, back) = found
                many = min(held, bins.open[room][taker])
                bins.add(donor, held - many)
                held = many
                bins.add(taker, -many)
                bins.add(plus(without(taker, *back), *give), many)
                donor = plus(without(donor, *give), *back)
                gained = True
            bins.add(donor, held)
            n -= 0 if donor else held
    return bins


def bins_of(bins: Bins) -> int:
    return sum(bins.full.values()) + sum(sum(c.values()) for c in bins.open.values())


def improve_in_units(bins: Bins, units: int = UNITS) -> Bins:
    """``improve`` with work that does not grow with the documents.

    Underfull bins of equal contents are bundled, so that at most ``units`` bundles are
    searched; an exchange between bundles is one in each of their bins.  What is left
    over from bundling, less than a bundle for each content, is searched in smaller bundles, down to single bins.
    """
    out = Bins(bins.capacity)
    out.full = bins.full
    left = {p: c for group in bins.open.values() for p, c in group.items()}
    while left:
        unit = 1
        while sum(left.values()) // unit > units:
            unit *= 2
        bundled = Bins(bins.capacity)
        for pattern, count in left.items():
            bundled.add(pattern, count // unit)
        left = {p: c % unit for p, c in left.items() if c % unit}
        filled = sum(sum(p) * c for group in bundled.open.values() for p, c in group.items())
        improve(bundled, -(-filled // bins.capacity))
        for pattern, count in [*bundled.full.items(), *((p, c) for group in bundled.open.values() for p, c in group.items())]:
            out.add(pattern, count * unit)
    return out


def plan_slots(bins: Bins) -> tuple[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], int]:
    """For each length: first ranks, first sequence numbers and offsets of its slots; and the number of sequences."""
    groups = list(bins.full.items()) + [(p, n) for f in sorted(bins.open) for p, n in bins.open[f].items()]
    slots: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    given: Counter[int] = Counter()
    first = 0
    for pattern, count in sorted(groups):
        offset = 0
        for length in pattern:
            slots[length].append((given[length], first, offset))
            given[length] += count
            offset += length
        first += count
    return {s: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for s, rows in slots.items()}, first


def pack(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    path: str | None = None,
    end: int = END,
) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    Each document is its ids and then ``end``; a null text is empty and so one
    piece of one id.  Only documents longer than ``capacity`` are cut, the first
    piece being the shorter one.  Repeated rows and keys, null ones too, are packed
    each on their own.  An empty table gives no rows; other columns are ignored.
    """
    pieces = durable(cut_pieces(documents, key, text, capacity, path or tokens.default_path(), end))
    short = pieces.where(F.col("length") < capacity)
    per_task = short.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1))
    bases = per_task.select("length", "task", "n", F.coalesce(before, F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    bins = improve_in_units(best_fit(histogram, capacity))
    slots, n_short = plan_slots(bins)
    names = [key, "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for s in np.unique(length):
                own = np.flatnonzero(length == s)
                ranks, firsts, offsets = slots[int(s)]
                slot = np.searchsorted(ranks, rank[own], "right") - 1
                sequence[own] = firsts[slot] + rank[own] - ranks[slot]
                offset[own] = offsets[slot]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"]
            )

    ranked = short.join(bases.select("length", "task", "base"), ["length", "task"]).select(
        *names, (F.col("rank") + F.col("base")).alias("rank")
    )
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(*names).schema)
    placed = ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")
    whole = pieces.where(F.col("length") == capacity)
    # Full pieces are numbered by task and rank, above all others.
    number = F.lit(n_short) + F.shiftleft(F.col("task").cast("long"), 36) + F.col("rank")
    return placed.unionByName(whole.select(*names, number.alias("sequence_id"), F.lit(0).cast("long").alias("offset")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1,024 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
