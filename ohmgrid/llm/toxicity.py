"""Toxicity by compression distance.

Two zstandard dictionaries are built, from ordinary and from toxic text.  They
share a base of common words and differ in one block of equal length: fragments
(words and their beginnings) that are significantly more frequent in toxic texts,
or plain words.  A window is one word, closed by an anchor string that both
dictionaries hold; its gain is how many bytes shorter it gets under the toxic
dictionary.  A text is described by its largest gain and by its windows above a
threshold that nearly all ordinary windows stay below, and a logistic curve
calibrates these figures on the labelled texts.

The method asks for dictionaries trained on whole texts and for wide windows.  Both
were tried and cannot tell toxic texts here (figures in the README): one marked
word changes the compressed length of a window of several words by less than the
chance matches of the others do.  So a window is one word, and what the two
dictionaries do not share is chosen by contrast.

Whole texts are scored.  The model is fitted on a bounded sample of the labelled
texts and is the same in every task; labels, ids, languages and sources are no
inputs of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmgrid.llm.common import durable

#: Labelled texts per class that the model is fitted on at most, and their greatest length.
TOXIC_TEXTS, ORDINARY_TEXTS, LONGEST = 2_000, 3_000, 50_000
#: One fold in this many, by the CRC-32 of the id's text, is never learned from.
FOLDS = 5
LEVEL = 12
BASE_BYTES, FRAGMENT_BYTES = 2_048, 4_096
#: Standard deviations by which a fragment's share must differ between the classes.
SIGNIFICANT = 7.0
BEGINNINGS = (5, 6)
FEWEST = 3
#: Share of ordinary windows that stay below the threshold, in percent.
BELOW = 99.9
ANCHOR = b"0123456789abcdefghijklmnopqrstuvwxyz0123456789"
#: Words whose gain a process keeps; beyond it the cache starts anew.
CACHE = 500_000
LONGEST_WORD = 200

_WORD = re.compile(r"[^\W\d_]+")
MODEL = pa.schema([("ordinary", pa.binary()), ("toxic", pa.binary()), ("threshold", pa.float64()), ("weights", pa.list_(pa.float64()))])


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    return _WORD.findall((text or "").lower())


def fragments_of(words: list[str]) -> set[str]:
    """The words and their beginnings."""
    own = set(words)
    return own | {w[:k] for w in own for k in BEGINNINGS if len(w) > k}


@dataclass
class Model:
    """Dictionaries, threshold and calibration; small enough to be sent with every task."""

    ordinary: bytes
    toxic: bytes
    threshold: float
    weights: list[float]
    _gains: dict = field(default_factory=dict, repr=False)
    _compress: tuple | None = field(default=None, repr=False)

    def __post_init__(self):
        self.ordinary, self.toxic = bytes(self.ordinary), bytes(self.toxic)

    def parts(self) -> dict:
        return {"ordinary": self.ordinary, "toxic": self.toxic, "threshold": self.threshold, "weights": self.weights}

    def __getstate__(self):
        return {**self.parts(), "_gains": {}, "_compress": None}

    def __setstate__(self, state):
        self.__dict__.update(state)

    def gain(self, word: str) -> int:
        """Bytes that the word's window is shorter under the toxic dictionary; very long words are cut into pieces of one window."""
        found = self._gains.get(word)
        if found is None:
            if self._compress is None:
                self._compress = tuple(_compressor(d) for d in (self.ordinary, self.toxic))
            plain, toxic = self._compress
            pieces = [word[k : k + LONGEST_WORD] for k in range(0, len(word), LONGEST_WORD)]
            windows = [f" {p} ".encode() + ANCHOR for p in pieces]
            found = max(len(plain(w)) - len(toxic(w)) for w in windows)
            if len(self._gains) >= CACHE:
                self._gains.clear()
            if len(word) <= LONGEST_WORD:
                self._gains[word] = found
        return found

    def features(self, words: list[str]) -> tuple[float, ...]:
        """Largest gain, windows above the threshold, their share, their surplus, and the number of windows."""
        gains = np.fromiter(map(self.gain, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
        above = int((gains >= self.threshold).sum())
        surplus = int(np.clip(gains - self.threshold + 1, 0, None).sum())
        n = len(gains)
        return (min(int(gains.max()), 12) / 4, math.log1p(above), math.log1p(1000 * above / n), math.log1p(surplus), math.log(n))

    def score(self, text: str | None) -> float:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], self.features(words_of(text)), strict=True))
        return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))


def _compressor(content: bytes):
    plain = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=4, write_content_size=False, write_checksum=False, write_dict_id=False)
    plain.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(compression_params=how, dict_data=plain).compress


def _percentile(counts: Counter, percent: float) -> float:
    """Least value that this share of all counted values does not exceed; 0 without any."""
    reached, total = 0, sum(counts.values())
    for value in sorted(counts):
        reached += counts[value]
        if reached * 100 >= total * percent:
            return float(value)
    return 0.0


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> list[float]:
    """Weights of a ridge-penalised logistic curve, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (y - p) - w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return [float(v) for v in w]


def fit(toxic: list[str], ordinary: list[str]) -> Model:
    """Trains on the given texts; without toxic ones every score is the same low one."""
    one: dict[str, str] = {}  # one object for each distinct word
    bad, good = ([[one.setdefault(w, w) for w in words_of(t)] for t in texts] for texts in (toxic, ordinary))
    in_bad = Counter(f for words in bad for f in fragments_of(words))
    in_bad = Counter({f: n for f, n in in_bad.items() if n >= FEWEST and len(f) >= 4})
    in_good = Counter(f for words in good for f in fragments_of(words) if f in in_bad)

    def excess(fragment: str) -> float:
        a, b = in_bad[fragment], in_good[fragment]
        share = (a + b) / (len(bad) + len(good))
        spread = max(share * (1 - share), 1e-9) * (1 / len(bad) + 1 / max(len(good), 1))
        return (a / len(bad) - b / max(len(good), 1)) / math.sqrt(spread)

    rated = {f: excess(f) for f in in_bad}
    chosen = sorted((f for f, z in rated.items() if z > SIGNIFICANT), key=lambda f: (rated[f], f))
    common = Counter(w for words in good for w in set(words))
    known = set(chosen)
    plain = [w for w, _ in sorted(common.items(), key=lambda c: (c[1], c[0])) if w not in known]
    block = (" " + " ".join(chosen) + " ").encode()[-FRAGMENT_BYTES:]
    text = (" " + " ".join(plain[-20_000:]) + " ").encode()
    base = text[-BASE_BYTES:]
    filler = text[: len(text) - len(base)][-len(block) :].rjust(len(block))
    model = Model(base + filler + ANCHOR, base + block + ANCHOR, 1.0, [-5.0, 0.0, 0.0, 0.0, 0.0, 0.0])
    if not bad or not good:
        return model
    usual = Counter(model.gain(w) for words in good for w in words)
    model.threshold = max(1.0, _percentile(usual, BELOW))
    x = np.array([model.features(words) for words in bad + good])
    model.weights = _logistic(x, np.concatenate([np.ones(len(bad)), np.zeros(len(good))]))
    model._gains.clear()
    return model


def held_out(key: Column) -> Column:
    """Whether the row is in the fold that is never learned from; a null id is."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def learn(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fits the model on labelled texts outside the held-out fold.

    The sample is fixed by a hash of the text and is of bounded size, so it can be
    gathered; equal texts count once, whatever their ids.  Ids and texts that are
    labelled both ways are toxic.
    """
    marks = labels.where(F.col(label).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("k")).agg(F.max(label).alias("y"))
    texts = documents.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).where(F.length("t") <= LONGEST)
    # Digests meet the labels, and only the chosen ones meet their texts again.
    known = texts.select("k", F.sha2("t", 256).alias("h")).join(marks, "k").groupBy("h").agg(F.max("y").alias("y"))
    picks = [known.where(F.col("y") == y).orderBy("h").limit(most) for y, most in ((1, TOXIC_TEXTS), (0, ORDINARY_TEXTS))]
    chosen = F.broadcast(durable(picks[0].unionAll(picks[1])))
    sample = texts.join(chosen, F.sha2("t", 256) == F.col("h")).groupBy("h").agg(F.max("y").alias("y"), F.first("t").alias("t"))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((y, t) for batch in batches for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        model = fit([t for y, t in rows if y == 1], [t for y, t in rows if y == 0])
        yield pa.RecordBatch.from_pylist([model.parts()], schema=MODEL)

    # The sample is bounded, so one task can hold it; the driver gets the small model alone.
    found = sample.select(F.col("y").cast("int"), "t").repartition(1).mapInArrow(train, "ordinary binary, toxic binary, threshold double, weights array<double>").collect()
    return Model(**found[0].asDict()) if found else fit([], [])


def score_texts(documents: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``documents`` with the score of each whole text, from 0 to 1, added as the last column; null and empty texts have one too."""
    names = documents.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([model.score(t.as_py()) for t in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*names, name])

    return documents.mapInArrow(run, documents.select("*").schema.add(name, "double"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored: doc_id, held_out, score, predicted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_texts(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
