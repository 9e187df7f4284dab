"""Benchmark decontamination by a prefix-filtered containment join.

A window is ``size`` consecutive words of a benchmark item (a shorter item is one
window).  Containment of all words needs a prefix of one token, so each window is
indexed by its rarest word alone, rarity being counted over the whole corpus.
Document words are joined to that index; positional and length bounds place the
window in the document, and the exact words are compared there.  Built-in column
functions only.

The document side is scanned, never shuffled by word.  The index is sent to the
tasks in slices of a checked number of windows; a larger benchmark takes more
passes over the documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmgrid.llm.common import content_id, durable, free_name, lower_ascii, small_side

WINDOW = 13
#: Contaminated if hit words are at least one in this many.
ONE_IN = 20
#: Windows sent to every task at once: about 100 bytes a word, so 40 MB.
SLICE_WINDOWS = 30_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z; null has none."""
    lowered = lower_ascii(F.coalesce(text.cast("string"), F.lit("")))
    return F.filter(F.split(lowered, NOT_WORD), lambda w: w != "")


def benchmark_windows(benchmark: DataFrame, item: str, text: str, size: int) -> DataFrame:
    """(window, item): each distinct window of each item, as an array of words."""
    words = benchmark.select(F.col(item).cast("string").alias("item"), words_of(F.col(text)).alias("words"))
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1))))
    cut = words.where(F.size("words") > 0).select("item", "words", starts.alias("at"))
    return cut.select(F.slice("words", F.col("at"), F.lit(size)).alias("window"), "item").distinct()


def corpus_counts(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """How often each word of ``vocabulary`` occurs in the whole corpus."""
    seen = words.select(F.explode("words").alias("word")).join(vocabulary, "word").groupBy("word").count()
    return vocabulary.join(seen, "word", "left").select("word", F.coalesce("count", F.lit(0)).alias("times"))


def index_windows(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(number, window, token, place): each distinct window with its rarest word and that word's place in it.

    Equally rare words are ordered by text, repeated ones by place.
    """
    numbered = windows.select("window").distinct().withColumn("number", F.xxhash64(F.array_join("window", " ")))
    tokens = numbered.select("number", "window", F.posexplode("window").alias("place", "word"))
    rare = tokens.join(counts, "word").groupBy("number", "window").agg(F.min(F.struct("times", "word", "place")).alias("first"))
    return rare.select("number", "window", F.col("first.word").alias("token"), F.col("first.place").alias("place"))


def covered_words(spans: Column) -> Column:
    """Words in the union of an array of (start, length) spans."""

    def add(seen, span):
        stop = span["start"] + span["length"]
        return F.struct(
            (seen["n"] + F.greatest(stop - F.greatest(span["start"], seen["reach"]), F.lit(0))).alias("n"),
            F.greatest(seen["reach"], stop).alias("reach"),
        )

    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    return F.aggregate(F.sort_array(spans), zero, add, lambda seen: seen["n"])


def find_windows(words: DataFrame, index: DataFrame) -> DataFrame:
    """(text_id, span, number): every occurrence of a window in a text.

    ``words`` has (text_id, words).  The candidate's place must lie inside the
    document on both sides before its words are compared.
    """
    each = words.select("text_id", F.size("words").alias("n_words"), "words", F.posexplode("words").alias("at", "token"))
    met = each.join(F.broadcast(index), "token")
    start = F.col("at") - F.col("place")
    length = F.size("window")
    inside = (start >= 0) & (start + length <= F.col("n_words"))
    same = F.when(inside, F.slice("words", start + 1, length) == F.col("window"))
    return met.where(same).select("text_id", F.struct(start.alias("start"), length.alias("length")).alias("span"), "number")


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    size: int = WINDOW,
    one_in: int = ONE_IN,
    slice_windows: int = SLICE_WINDOWS,
) -> DataFrame:
    """One row per document: key, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and are clean; so is everything if the
    benchmark is empty.  Items without words are ignored, repeated items count
    once, null item ids have no name and are not listed.  Repeated rows and ids
    of documents are each judged.  Other columns are ignored.  A text is known by
    its contents, so it does not matter in which splits the table is read again.
    """
    rows = documents.select(F.col(f"`{key}`").alias("doc_key"), content_id(documents, text).alias("text_id"), words_of(F.col(f"`{text}`")).alias("words"))
    windows = durable(benchmark_windows(benchmark, item, item_text, size))
    hits = text_hits(rows.select("text_id", "words"), windows, slice_windows)
    # Texts with hits are few; the others are told clean by the same scan that counts their words.
    full = rows.select("doc_key", "text_id", F.size("words").cast("long").alias("n_words")).join(small_side(hits), "text_id", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return full.select(
        F.col("doc_key").alias(key),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * one_in >= F.col("n_words"))).alias("contaminated"),
    )


def text_hits(words: DataFrame, windows: DataFrame, slice_windows: int) -> DataFrame:
    """One stored row per distinct text with an occurrence: text_id, n_hit, items (sorted)."""
    vocabulary = windows.select(F.explode("window").alias("word")).distinct()
    n_windows = windows.select("window").distinct().count()
    if n_windows <= slice_windows:
        vocabulary = F.broadcast(vocabulary)
    index = durable(index_windows(windows, corpus_counts(words, vocabulary)))
    passes = max(1, -(-n_windows // slice_windows))
    slices = [index] if passes == 1 else [index.where(F.pmod("number", F.lit(passes)) == k) for k in range(passes)]
    found = reduce(DataFrame.unionAll, [find_windows(words, part) for part in slices])
    by_text = durable(found.groupBy("text_id").agg(F.collect_set("span").alias("spans"), F.collect_set("number").alias("numbers")))
    items = windows.where(F.col("item").isNotNull()).select(F.xxhash64(F.array_join("window", " ")).alias("number"), "item")
    named = by_text.select("text_id", F.explode("numbers").alias("number")).join(items, "number").groupBy("text_id").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return durable(by_text.join(named, "text_id", "left").select("text_id", covered_words(F.col("spans")).alias("n_hit"), "items"))


def drop_contaminated(
    documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", size: int = WINDOW, one_in: int = ONE_IN, slice_windows: int = SLICE_WINDOWS
) -> DataFrame:
    """``documents`` without the contaminated rows; all columns stay.

    The rule and its edge cases are those of ``contamination``.
    """
    identity = content_id(documents, text)
    judged = documents.select(identity.alias("text_id"), words_of(F.col(f"`{text}`")).alias("words"))
    windows = durable(benchmark_windows(benchmark, item, item_text, size))
    hits = text_hits(judged, windows, slice_windows)
    name = free_name(documents, "own_id")
    hits = small_side(durable(hits.select(F.col("text_id").alias(name), F.col("n_hit").alias(free_name(documents, "own_hits")))))
    met = documents.withColumn(name, identity).join(hits, name, "left")
    count = F.col(hits.columns[1])
    bad = F.coalesce((count > 0) & (count * one_in >= F.size(words_of(F.col(f"`{text}`")))), F.lit(False))
    return met.where(F.when(count.isNull(), True).otherwise(~bad)).select(*[f"`{c}`" for c in documents.columns])


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of every document by the whole benchmark."""
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS g, least(len(w), 13) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT r, i, dw.n, item_id FROM dw JOIN bw ON bw.g = dw.g AND bw.n = dw.n),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS s
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
