"""SimHash near-duplicates by a generalised pigeonhole search.

The 64 bits are grouped into partitions of correlated bits.  If the partitions'
thresholds t satisfy sum(t + 1) = radius + 1, two fingerprints within the radius
agree within t in at least one partition.  The thresholds are unequal: dynamic
programming picks those with the fewest estimated probes and candidates, the
estimates coming from all distinct fingerprints.  Candidates share a masked
fingerprint and are verified on all 64 bits, in blocks of bounded size.

``keep_one``, the pipeline's stage, runs this search first and holds what it finds
against the Jaccard similarity of whole shingle sets.  Similar sets whose fingerprints
are further apart are then found by joining their prefixes, which loses no pair.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmgrid.llm import blocks
from ohmgrid.llm.common import ASCII_LOWER, ASCII_UPPER, content_id, durable, free_name, small_side, without_rows
from ohmgrid.operators.graph import connected_components

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
#: Numbers of partitions that are tried.
PARTITIONS = (2, 3, 4)
#: Cost of a candidate against that of a probe row, which is shuffled.
CANDIDATE_COST = 0.05

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans(ASCII_UPPER, ASCII_LOWER)
#: Rows of unpacked bits that are held at once.
_STEP = 65_536


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of the word shingles of ``text``, repeats included; fewer words are one shingle, none give none."""
    text = text or ""
    words = _WORD.findall(text.lower() if text.isascii() else text.translate(_LOWER))
    if len(words) < shingle:
        grams = [" ".join(words)] if words else []
    else:
        grams = map(" ".join, zip(*[words[k:] for k in range(shingle)], strict=False))
    hashed = xxhash.xxh64_intdigest
    return np.array([hashed(g, SEED) for g in grams], dtype=">u8")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned SimHash of the word shingles of ``text``; zero without words."""
    return majority(shingle_hashes(text, shingle))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(h), _STEP):
        ones += np.unpackbits(h[k : k + _STEP].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(documents: DataFrame, text: str = "text", shingle: int = SHINGLE, name: str = "fp") -> DataFrame:
    """``documents`` with the fingerprint, as a signed long, in place of the text."""
    others = [c for c in documents.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([_signed(fingerprint(t.as_py(), shingle)) for t in batch.column(batch.num_columns - 1)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], fps], names=[*others, name])

    source = documents.select(*others, F.col(text).cast("string"))
    schema = documents.select(*others).schema.add(name, "long")
    return source.mapInArrow(run, schema)


def bit_counts(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j both set, over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            fp = batch.column(0).to_numpy().astype(np.int64).view(np.uint64)
            bits = ((fp[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
            both += bits.T @ bits
            n += len(fp)
        cell = np.arange(BITS * BITS + 1)
        count = np.append(both.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(count, pa.int64())], names=["cell", "n"])

    cells = distinct.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1)
    for row in cells:
        flat[row["cell"]] = row["n"]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of near-equal size, each grown by the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    free, groups = list(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        start = max(free, key=lambda b: (corr[b, free].sum(), -b))
        group = [start]
        free.remove(start)
        while len(group) < size:
            best = max(free, key=lambda b: (corr[b, group].mean(), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def equal_pairs(distinct: DataFrame, groups: list[list[int]]) -> list[float]:
    """For each group of bits, the pairs of fingerprints that agree on all of it, counted over all of them."""
    masks = F.array(*[F.lit(_signed(sum(1 << b for b in g))) for g in groups])
    rows = distinct.select("fp", F.posexplode(masks).alias("part", "mask"))
    sizes = rows.groupBy("part", F.col("fp").bitwiseAND(F.col("mask")).alias("value")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    found = {r["part"]: r["pairs"] for r in sizes.groupBy("part").agg(F.sum(F.expr("n * (n - 1) / 2")).alias("pairs")).collect()}
    return [found.get(k, 0.0) for k in range(len(groups))]


def allocate(costs: list[list[float]], radius: int) -> tuple[float, list[int]]:
    """Cheapest thresholds with sum(t + 1) = radius + 1; ``costs[i][t + 1]`` is that of partition i, -1 leaves it out."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t1, c in enumerate(own):
                if used + t1 <= radius + 1 and (used + t1 not in step or cost + c < step[used + t1][0]):
                    step[used + t1] = (cost + c, [*chosen, t1 - 1])
        best = step
    return best[radius + 1]


def choose_masks(distinct: DataFrame, radius: int = RADIUS) -> list[int]:
    """Signed masks such that any two fingerprints within ``radius`` agree on at least one of them."""
    n, both = bit_counts(distinct)
    p = np.diag(both) / max(n, 1)
    agree = np.maximum(p * p + (1 - p) * (1 - p), 0.5)
    plans = []
    for parts in PARTITIONS:
        groups = group_bits(n, both, parts)
        exact = equal_pairs(distinct, groups)
        costs = []
        for group, pairs in zip(groups, exact, strict=True):
            # One bit may differ: odds of disagreement, bit by bit; two may: pairs of bits.
            odds = [(1 - agree[b]) / agree[b] for b in group]
            first, second = sum(odds), (sum(odds) ** 2 - sum(o * o for o in odds)) / 2
            w = len(group)
            costs.append([
                0.0,
                n + CANDIDATE_COST * pairs,
                n * w + CANDIDATE_COST * pairs * (w + first),
                n * w * (w - 1) / 2 + CANDIDATE_COST * pairs * (w * (w - 1) / 2 + (w - 1) * first + second),
            ][: radius + 2])
        cost, thresholds = allocate(costs, radius)
        plans.append((cost, parts, groups, thresholds))
    _, _, groups, thresholds = min(plans, key=lambda plan: plan[:2])
    masks = []
    for group, t in zip(groups, thresholds, strict=True):
        if t >= 0:
            masks += [_signed(sum(1 << b for b in group if b not in off)) for off in combinations(group, t)]
    return masks


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks.whole_runs(batches):
            fp = table.column("fp").to_numpy()
            bits = fp.view(np.uint64)
            forest = blocks.Forest(len(fp))

            def near(i, j, bits=bits):
                return np.bitwise_count(bits[i] ^ bits[j]) <= radius

            for i, j in blocks.pair_steps(table.column("run").to_numpy(), table.column("side").to_numpy(), near):
                forest.link(i, j)
            linked = np.flatnonzero(forest.root != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[forest.root[linked]])], names=["u", "v"])

    return run


def near_fingerprints(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): links between distinct fingerprints that join exactly those within ``radius`` of each other by some chain."""
    keyed = masked(distinct.select("fp"), choose_masks(distinct, radius))
    return blocks.runs(keyed, "bucket", "fp").mapInArrow(_links(radius), "u long, v long")


def masked(rows: DataFrame, masks: list[int]) -> DataFrame:
    """``rows`` (fp, and other columns) under every mask, with ``bucket``: a hash of the mask's number and the bits it leaves."""
    each = rows.select(*rows.columns, F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("part", "mask"))
    return each.select(*rows.columns, F.xxhash64("part", F.col("fp").bitwiseAND(F.col("mask"))).alias("bucket"))


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: key, fp (signed long), component_id (smallest key of its component).

    Fingerprints link at ``radius`` or fewer differing bits; documents with equal
    fingerprints are in one component, those without words (null and empty texts)
    too.  Keys may repeat; a null key is never the smallest, and a component of
    null keys alone has a null id.  Other columns are ignored.
    """
    fps = durable(fingerprints(documents.select(key, text), text, shingle))
    classes = durable(fps.groupBy("fp").agg(F.min(key).alias("first")))
    parts = connected_components(near_fingerprints(classes, radius))
    rooted = classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    rooted = durable(rooted.select("fp", "first", "root"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(rooted.join(ids, "root").select("fp", "component_id"), "fp", "left").select(key, "fp", "component_id")


SIMILAR = 0.8
#: Documents sampled to find common shingles, the sampled documents that make one common, and how many are held.
#: They only set the order of shingles: any order gives the same groups.
SAMPLED, COMMON, MOST_COMMON = 4_000, 4, 50_000
#: Bits of the parity signature of a shingle set.
PARITY = 512
#: Slack of the bounds for rounding; a bound that is too loose costs a comparison and loses nothing.
EPS = 1e-9


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    return np.unique(shingle_hashes(text, shingle).astype(np.uint64))


def common_shingles(texts: DataFrame, row: str, text: str, shingle: int) -> np.ndarray:
    """Shingles that many documents of a sample hold, the rarest first."""
    share = min(1.0, SAMPLED / max(texts.count(), 1))
    drawn = texts.where(F.pmod(F.xxhash64(row, F.lit(SEED)), F.lit(1_000_000)) < int(share * 1_000_000)).select(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                h = shingle_set(value.as_py(), shingle)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    counted = drawn.mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    found = counted.orderBy(F.desc("n"), "h").limit(MOST_COMMON).collect()
    return np.array([r["h"] for r in reversed(found)], np.int64).view(np.uint64)


def in_order(h: np.ndarray, common: np.ndarray, by_value: np.ndarray) -> np.ndarray:
    """The sorted hashes ``h``, those in ``common`` moved to the end in its order; ``by_value`` is its argsort."""
    if not len(common) or not len(h):
        return h
    values = common[by_value]
    at = np.minimum(np.searchsorted(values, h), len(values) - 1)
    known = values[at] == h
    return np.concatenate((h[~known], common[np.sort(by_value[at[known]])]))


def parity(h: np.ndarray, cells: int = PARITY) -> bytes:
    """Parity of the hashes in each of the cells; sets differ in at least as many hashes as these in bits."""
    return np.packbits(np.bincount((h & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1).tobytes()


def long_parity(h: np.ndarray) -> bytes | None:
    """Parity in twice as many cells as there are hashes, a power of two, as few cells tell nothing of a long set; none for short ones."""
    return parity(h, 1 << (2 * len(h) - 1).bit_length()) if 2 * len(h) > PARITY else None


def parity_distance(x: bytes, y: bytes) -> int:
    """Differing bits of two parities, the longer one folded to the length of the other."""
    a, b = (np.frombuffer(s, np.uint8) for s in (x, y))
    while len(a) != len(b):
        a, b = sorted((a, b), key=len)
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def prefixes(texts: DataFrame, name: str, text: str, shingle: int, similar: float, common: np.ndarray) -> DataFrame:
    """(name, fp, digest, n, prefix, bits, sig): the text's fingerprint, the set's digest and size, its first hashes in order, its parity and, if it is long, a longer one.

    The fingerprint is that of ``near_duplicates``, over its own shingles.  Two sets of at least this similarity share one of their first n - ceil(similar n) + 1 hashes in any common order.
    """
    by_value = np.argsort(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, digests, sizes, firsts, bits, long = [], [], [], [], [], []
            for value in batch.column(1):
                h = shingle_set(value.as_py(), shingle)
                fps.append(_signed(fingerprint(value.as_py())))
                digests.append(xxhash.xxh3_128_digest(h.tobytes()))
                sizes.append(len(h))
                firsts.append(in_order(h, common, by_value)[: len(h) - math.ceil(similar * len(h) - EPS) + 1].tobytes())
                bits.append(parity(h))
                long.append(long_parity(h))
            arrays = [pa.array(fps, pa.int64()), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(firsts, pa.binary()), pa.array(bits, pa.binary()), pa.array(long, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[name, "fp", "digest", "n", "prefix", "bits", "sig"])

    source = texts.select(name, F.col(text).cast("string"))
    return source.mapInArrow(run, f"`{name}` {source.schema[0].dataType.simpleString()}, fp long, digest binary, n int, prefix binary, bits binary, sig binary")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per hash of a prefix: (token, cls, n, pos)."""
    for whole in batches:
        for k in range(0, whole.num_rows, 500):
            batch = whole.slice(k, 500)
            own = [np.frombuffer(p, np.int64) for p in batch.column("prefix").to_pylist()]
            sizes = np.array([len(p) for p in own], np.int64)
            pos = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            cls, n = (np.repeat(batch.column(c).to_numpy(), sizes) for c in ("cls", "n"))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), pa.array(cls), pa.array(n), pa.array(pos.astype(np.int32))], names=["token", "cls", "n", "pos"])


def _shared(name: str):
    """Rows, sorted by the column ``name``, whose value in it another row has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, twice = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            token = batch.column(name).to_numpy()
            equal = token[1:] == token[:-1]
            keep = np.append(equal, False) | np.insert(equal, 0, False)
            if last is not None:
                same = last.column(name)[0].as_py() == token[0]
                keep[0] |= same
                if twice or same:
                    yield last
            last, twice = batch.slice(batch.num_rows - 1), bool(keep[-1])
            yield batch.slice(0, batch.num_rows - 1).filter(pa.array(keep[:-1]))
        if last is not None and twice:
            yield last

    return run


def folded(sigs: list[bytes]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """(length of each parity in bytes, for each length the parities of at least that length folded to it, zeros for shorter ones)."""
    lengths = np.array([len(s) for s in sigs], np.int64)
    out = {}
    for size in np.unique(lengths):
        matrix = np.zeros((len(sigs), int(size) // 8), np.uint64)
        for k in np.flatnonzero(lengths >= size):
            matrix[k] = np.bitwise_xor.reduce(np.frombuffer(sigs[k], np.uint8).reshape(-1, int(size)), axis=0).view(np.uint64)
        out[int(size)] = matrix
    return lengths, out


def _possible(table: pa.Table, similar: float, radius: int):
    """(i, j) -> whether the rows can be similar: by fingerprint, by size, by position, by parity, by the longer parity if given, and not linked yet.

    The token is taken to be the first that both sets hold in the order, as it is in one run of every similar pair.
    Where rows met by a token their fingerprints are given as zero, where by a fingerprint their positions.
    """
    fp = table.column("fp").to_numpy().view(np.uint64)
    n, pos, label = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "pos", "label"))
    short = table.column("bits").to_pylist()
    bits = np.frombuffer(b"".join(short), np.uint64).reshape(len(n), -1)
    lengths, long = folded([s or b for s, b in zip(table.column("sig").to_pylist(), short, strict=True)]) if "sig" in table.column_names else (None, {})

    def near(i, j):
        a, b = n[i], n[j]
        need = np.ceil(similar / (1 + similar) * (a + b) - EPS)
        ok = (np.bitwise_count(fp[i] ^ fp[j]) <= radius) & (np.minimum(a, b) >= similar * np.maximum(a, b) - EPS) & (np.minimum(a - pos[i], b - pos[j]) >= need) & (label[i] != label[j])
        at = np.flatnonzero(ok)
        most = n[i[at]] + n[j[at]] - 2 * need[at]
        fits = np.bitwise_count(bits[i[at]] ^ bits[j[at]]).sum(axis=1, dtype=np.int64) <= most
        for size, matrix in long.items():
            own = np.flatnonzero(fits & (np.minimum(lengths[i[at]], lengths[j[at]]) == size))
            for k in range(0, len(own), 4_000_000 // size + 1):
                part = own[k : k + 4_000_000 // size + 1]
                fits[part] = np.bitwise_count(matrix[i[at[part]]] ^ matrix[j[at[part]]]).sum(axis=1, dtype=np.int64) <= most[part]
        ok[at] = fits
        return ok

    return near, bits


def _nearest(similar: float, radius: int):
    """For each row of a run, its class v, the nearest possible partner u, and how far apart they are at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks.whole_runs(batches):
            near, bits = _possible(table, similar, radius)
            cls = table.column("cls").to_numpy()
            none = np.iinfo(np.int64).max
            nearest = np.full(len(cls), none)
            for i, j in blocks.pair_steps(table.column("run").to_numpy(), table.column("side").to_numpy(), near):
                apart = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64) << 40
                np.minimum.at(nearest, i, apart | j)
                np.minimum.at(nearest, j, apart | i)
            rows = np.flatnonzero(nearest < none)
            apart, other = nearest[rows] >> 40, nearest[rows] & ((1 << 40) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(cls[rows]), pa.array(cls[other]), pa.array(apart)], names=["v", "u", "apart"])

    return run


def _rest(similar: float, radius: int):
    """Possible pairs that are not linked yet: (run, side, u, v), and where a run has more pairs than rows, its rows in them, v null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks.whole_runs(batches):
            near, _ = _possible(table, similar, radius)
            cls, number, side = (table.column(c).to_numpy() for c in ("cls", "run", "side"))
            own = np.cumsum(np.insert(number[1:] != number[:-1], 0, False))
            size = np.bincount(own)
            pairs, held = np.zeros(len(size), np.int64), np.zeros(len(cls), bool)
            few: list[tuple[np.ndarray, np.ndarray]] = []
            for i, j in blocks.pair_steps(number, side, near):
                pairs += np.bincount(own[i], minlength=len(size))
                held[i] = held[j] = True
                ok = pairs[own[i]] <= size[own[i]]
                few.append((i[ok], j[ok]))
            dense = pairs > size
            i = np.concatenate([p[0] for p in few]) if few else np.zeros(0, np.int64)
            j = np.concatenate([p[1] for p in few]) if few else i
            ok = ~dense[own[i]]
            i, j = i[ok], j[ok]
            rows = np.flatnonzero(held & dense[own])
            first, u = np.concatenate((i, rows)), np.concatenate((np.minimum(cls[i], cls[j]), cls[rows]))
            v = np.concatenate((np.maximum(cls[i], cls[j]), np.full(len(rows), -1)))
            yield pa.RecordBatch.from_arrays([pa.array(number[first]), pa.array(side[first]), pa.array(u), pa.array(v, mask=v < 0)], names=["run", "side", "u", "v"])

    return run


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two whole sets."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def _sets(column) -> list[np.ndarray]:
    return [np.frombuffer(s, np.uint64) for s in column.to_pylist()]


def _by_home(columns: list[str], keep):
    """(u, v) of a home and each class sent to it for which ``keep`` holds; the home's own row, ``cls`` equal to ``home``, comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, own = None, None
        for batch in batches:
            u, v = [], []
            for at, cls, *values in zip(*(batch.column(c).to_pylist() for c in ("home", "cls", *columns)), strict=True):
                if at == cls:
                    home, own = at, values
                elif at != home:
                    raise ValueError("a home's own row comes first")
                elif keep(*own, *values):
                    u.append(at)
                    v.append(cls)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _plausible(similar: float):
    """Whether the parities of two sets allow the similarity."""

    def keep(n, bits, sig, n2, bits2, sig2) -> bool:
        need = math.ceil(similar / (1 + similar) * (n + n2) - EPS)
        return parity_distance(sig or bits, sig2 or bits2) <= n + n2 - 2 * need

    return keep


def _similar(least: float):
    """Whether two whole sets are similar."""
    return lambda x, y: similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= least


def _dense_links(least: float, radius: int):
    """Verifies every possible pair of a run that no chain of its links joins; at most a link for each row leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks.whole_runs(batches):
            near, _ = _possible(table, least, radius)
            cls, sets = table.column("cls").to_numpy(), _sets(table.column("set"))
            forest = blocks.Forest(len(cls))
            for i, j in blocks.pair_steps(table.column("run").to_numpy(), table.column("side").to_numpy(), near):
                for a, b in zip(i, j, strict=True):
                    if forest.root[a] != forest.root[b] and similarity(sets[a], sets[b]) >= least:
                        forest.link(np.array([a]), np.array([b]))
            linked = np.flatnonzero(forest.root != np.arange(len(cls)))
            yield pa.RecordBatch.from_arrays([pa.array(cls[linked]), pa.array(cls[forest.root[linked]])], names=["u", "v"])

    return run


def whole_sets(numbered: DataFrame, shingle: int, asked: DataFrame) -> DataFrame:
    """``asked`` (cls, id, and other columns) with ``set``: all shingle hashes of a row of that id, made from its text again.

    Equal rows have one id; a task makes the set of each id once.
    """
    others = [c for c in asked.columns if c not in ("cls", "id")]
    asked = durable(asked.distinct().groupBy("cls", "id").agg(F.collect_list(F.struct(*others)).alias("for")) if others else asked.distinct())
    source = numbered.join(small_side(asked), "id")
    kept = [c for c in ("cls", "for") if c in asked.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            fresh = []
            for cls in batch.column("cls").to_pylist():
                fresh.append(cls not in seen)
                seen.add(cls)
            batch = batch.filter(pa.array(fresh))
            sets = [shingle_set(t.as_py(), shingle).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sets, pa.binary())], names=[*kept, "set"])

    source = source.select(*kept, "text")
    found = source.mapInArrow(run, source.select(*kept).schema.add("set", "binary"))
    return found.select("cls", F.explode("for").alias("for"), "set").select("cls", "for.*", "set") if others else found


def sent_home(pairs: DataFrame) -> DataFrame:
    """(home, part, cls) of ``pairs`` (u, v; home: one of them; stored): each class to its home once, and the home to itself.

    Homes of many partners are dealt into parts.
    """
    large = durable(pairs.groupBy("home").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > blocks.BLOCK).select("home", F.ceil(F.col("n") / blocks.BLOCK).alias("parts")))
    other = F.when(F.col("home") == F.col("u"), F.col("v")).otherwise(F.col("u"))
    dealt = pairs.join(small_side(large), "home", "left").withColumn("part", F.pmod(F.xxhash64("u", "v"), F.coalesce("parts", F.lit(1))).cast("int"))
    return dealt.select("home", "part", F.explode(F.array("home", other)).alias("cls")).distinct()


def at_home(sent: DataFrame) -> DataFrame:
    """Rows of ``sent_home`` gathered by home and part, the home's own first."""
    return sent.withColumn("guest", F.col("cls") != F.col("home")).repartition("home", "part").sortWithinPartitions("home", "part", "guest")


def verified_links(numbered: DataFrame, shingle: int, classes: DataFrame, pairs: DataFrame, similar: float) -> DataFrame:
    """(u, v) of those ``pairs`` (u, v: classes; home: one of them; stored) whose whole shingle sets are similar.

    Parities that grow with the sets are compared first; they refuse nearly all
    others at a small part of the bytes.
    """
    light = at_home(sent_home(pairs).join(classes.select("cls", "n", "bits", "sig"), "cls"))
    left = durable(light.mapInArrow(_by_home(["n", "bits", "sig"], _plausible(similar)), "u long, v long").select("u", "v", F.col("u").alias("home")).distinct())
    met = whole_sets(numbered, shingle, sent_home(left).join(classes.select("cls", "id"), "cls"))
    return durable(at_home(met).mapInArrow(_by_home(["set"], _similar(similar)), "u long, v long").distinct())


def fingerprint_runs(prints: DataFrame, radius: int) -> DataFrame:
    """Runs of ``prints`` (cls, n, fp; stored) in which any two fingerprints within ``radius`` meet: (cls, n, fp, pos, run, side)."""
    masks = choose_masks(durable(prints.select("fp").distinct()), radius)
    # Many classes may have one fingerprint, and texts of one class many.
    rows = masked(prints.withColumns({"pos": F.lit(0), "spread": F.xxhash64("cls", "fp")}), masks)
    dealt = blocks.runs(rows, "bucket", "spread").drop("spread")
    return durable(dealt.mapInArrow(_shared("run"), dealt.schema))


def prefix_runs(classes: DataFrame) -> DataFrame:
    """Runs of ``classes`` in which any two that share a hash of their prefixes meet: (cls, n, fp: 0, pos, run, side)."""
    schema = "token long, cls long, n int, pos int"
    rows = classes.select("cls", "n", "prefix").mapInArrow(_tokens, schema)
    shared = rows.repartition("token").sortWithinPartitions("token").mapInArrow(_shared("token"), schema)
    return durable(blocks.runs(durable(shared), "token", "cls")).withColumn("fp", F.lit(0).cast("long"))


def similar_links(numbered: DataFrame, shingle: int, classes: DataFrame, prints: DataFrame, similar: float, radius: int = RADIUS) -> DataFrame:
    """(u, v): verified links that join exactly the classes whose sets are similar, by chains.

    Candidates have fingerprints within ``radius`` or, still apart after that search,
    share a hash of their prefixes; every one is either verified on whole sets or
    joined by links that are.  In either search each row's nearest partner is
    verified first, so that large groups close; then all pairs that are still apart.
    """
    searches = [fingerprint_runs(prints, radius), prefix_runs(classes)]

    def met(extra: DataFrame, rows: DataFrame) -> DataFrame:
        return rows.join(extra, "cls").repartition("run").sortWithinPartitions("run")

    labelled = classes.select("cls", "bits", F.col("cls").alias("label"))
    links = tried = None
    for rows in searches:
        nearest = met(labelled, rows).mapInArrow(_nearest(similar, radius), "v long, u long, apart long")
        picks = nearest.groupBy("v").agg(F.min(F.struct("apart", "u")).alias("best")).select(F.col("best.u").alias("home"), "v")
        # Two rows may pick each other.
        ends = [F.least("home", "v").alias("u"), F.greatest("home", "v").alias("v")]
        pairs = durable(picks.select("home", *ends).groupBy("u", "v").agg(F.max("home").alias("home")))
        found = verified_links(numbered, shingle, classes, pairs, similar)
        links, tried = (links.unionAll(found), tried.unionAll(pairs)) if links is not None else (found, pairs)
        parts = connected_components(links).select(F.col("node").alias("cls"), F.col("component").alias("root"))
        labelled = durable(classes.select("cls", "bits").join(parts, "cls", "left").select("cls", "bits", F.coalesce("root", "cls").alias("label")))
    dealt = searches[0].unionByName(searches[1])
    rest = durable(met(labelled, dealt).mapInArrow(_rest(similar, radius), "run long, side byte, u long, v long"))
    found = rest.where("v IS NOT NULL").select("u", "v")
    dense = rest.where("v IS NULL").select("run", "side", F.col("u").alias("cls"))
    some = not dense.isEmpty()
    if some:
        # Long sets crowd: their longer parities leave few pairs of a run.
        rows = dealt.join(dense, ["run", "side", "cls"], "left_semi")
        rest = durable(met(labelled.join(classes.select("cls", "sig"), "cls"), rows).mapInArrow(_rest(similar, radius), "run long, side byte, u long, v long"))
        found = found.unionAll(rest.where("v IS NOT NULL").select("u", "v"))
        dense = rest.where("v IS NULL").select("run", "side", F.col("u").alias("cls"))
        some = not dense.isEmpty()
    left = durable(found.distinct().join(tried, ["u", "v"], "left_anti").withColumn("home", F.col("u")))
    links = links.unionAll(verified_links(numbered, shingle, classes, left, similar))
    if not some:
        return links
    sets = durable(whole_sets(numbered, shingle, dense.select("cls").join(classes.select("cls", "id"), "cls")).dropDuplicates(["cls"]))
    rows = dealt.join(dense, ["run", "side", "cls"], "left_semi")
    return links.unionAll(met(labelled.join(sets, "cls"), rows).mapInArrow(_dense_links(similar, radius), "u long, v long"))


def keep_one(documents: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, similar: float = SIMILAR) -> DataFrame:
    """``documents`` with one row of each group of near duplicates, that of the smallest key; all columns stay.

    Equal keys are told apart by the contents of their rows, and null keys come
    last; of wholly equal rows any one is the one.

    Rows whose shingle sets have a similarity of at least ``similar`` are one group,
    by chains; every such pair is found and is held against the whole sets.  Those
    whose fingerprints differ in at most ``RADIUS`` bits are found by the pigeonhole
    search, the others by a join of prefixes.  Rows without words (null and empty texts) are one group.  Rows are known by their
    contents, so it does not matter in which splits the table is read again.
    """
    identity = content_id(documents, *documents.columns)
    numbered = documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"), identity.alias("id"))
    named = numbered.select(F.struct(F.col("key").isNull().alias("none"), "key", "id").alias("name"), "text")
    common = common_shingles(numbered.select("id", "text"), "id", "text", shingle)
    each = durable(prefixes(named, "name", "text", shingle, similar, common))
    kept = each.groupBy("digest").agg(F.min("name").alias("first"), F.min_by(F.struct("n", "prefix", "bits", "sig"), "name").alias("of"))
    # Stored at once, so that the classes keep the numbers they get here.
    classes = durable(kept.select("digest", "first", F.monotonically_increasing_id().alias("cls"), F.col("first.id").alias("id"), "of.*"))
    prints = durable(each.select("digest", "fp").distinct().join(classes.select("digest", "cls", "n"), "digest").select("cls", "n", "fp"))
    parts = connected_components(similar_links(numbered.select("id", "text"), shingle, classes, prints, similar))
    rooted = classes.select("digest", "first", "cls").join(parts.withColumnRenamed("node", "cls"), "cls", "left")
    rooted = durable(rooted.select("digest", "first", F.coalesce("component", "cls").alias("root")))
    kept = rooted.groupBy("root").agg(F.min("first").alias("kept"))
    group = durable(rooted.join(kept, "root").select("digest", "kept"))
    judged = each.select("name", "digest").join(group, "digest").select("name.id.*", (F.col("name.id") == F.col("kept.id")).alias("first"))
    rest = without_rows(documents, judged.where(~F.col("first")).select("a", "b"), identity)
    # Equal rows are all the first of their group; they are few, and one of each is put back.
    equal = durable(judged.where("first").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b"))
    if equal.isEmpty():
        return rest
    name = free_name(documents, "own_id")
    one = documents.withColumn(name, identity).join(small_side(equal.select(F.struct("a", "b").alias(name))), name, "left_semi").dropDuplicates([name]).drop(name)
    return without_rows(rest, equal, identity).unionByName(one)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = near_duplicates(docs)
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return out.select("doc_id", hexed.alias("fingerprint"), "component_id")
