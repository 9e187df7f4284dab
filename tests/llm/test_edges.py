"""Empty tables, nulls, repeated rows and clashing columns for every corpus operator and every stage of the pipeline."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ohmgrid.llm import decontaminate, embeddings, packing, pii, repeats, secret_ledger, simhash, token_counts, toxicity, url_rules

CLASHES = ["row", "key", "id", "own_id", "own_id_", "text_id", "words", "found_values", "new_values", "toxicity_score", "span", "bucket", "cls", "n", "run", "side", "blob", "findings", "__part", "__parts", "name", "part", "label"]
rng = random.Random(8)
LONG = " ".join(f"v{rng.randrange(9000)}" for _ in range(25_000))
#: (doc_id, text): null and repeated ids, wholly equal rows, one id with two texts, empty and very long texts.
ROWS = [(1, "one two three four five six seven"), (1, "one two three four five six seven"), (1, "another text of the same id"), (None, "a row without id token=abcdef12"), (None, None), (2, None), (3, ""), (4, LONG), (5, LONG + " tail"), (6, "mail a.b@example.com now")]


def table(spark):
    df = spark.createDataFrame([(k, t, "en", None, None) for k, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(f"clash {c}") for c in CLASHES})


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 1, 1), (6, 0, 0)], "doc_id long, quality int, toxic int")


def benchmark(spark):
    return spark.createDataFrame([(0, "one two three four five six seven"), (1, None), (None, "a b c")], "item_id long, text string").withColumn("item", F.lit("clash"))


OPERATORS = {
    "pii": lambda s, d: pii.pseudonymise(d, count="n_changed"),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "packing": lambda s, d: packing.pack(d),
    "token_counts": lambda s, d: token_counts.count_sections(d),
    "decontaminate": lambda s, d: decontaminate.contamination(d, benchmark(s)),
    "toxicity": lambda s, d: toxicity.score_texts(d, toxicity.learn(d, labels(s)), name="s"),
    "repeats": lambda s, d: repeats.remove_repeats(d),
    "secrets": lambda s, d: secret_ledger.findings_by_path(d, secret_ledger.scan_unseen(d)),
    "keep_one": lambda s, d: simhash.keep_one(d),
    "drop_contaminated": lambda s, d: decontaminate.drop_contaminated(d, benchmark(s)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(spark, name):
    df = table(spark)
    out = OPERATORS[name](spark, df)
    rows = out.collect()
    ids = Counter(r["doc_id"] for r in rows)
    expected = Counter(k for k, _ in ROWS)
    if name in ("packing", "token_counts"):
        assert set(ids) == set(expected)
    elif name == "keep_one":
        # The empty texts are one group, the two long ones another; ids come first, null last.
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, (r["text"] or "")[:5]) for r in rows) == [(False, 1, "anoth"), (False, 1, "one t"), (False, 2, ""), (False, 4, LONG[:5]), (False, 6, "mail "), (True, 0, "a row")]
    elif name == "drop_contaminated":
        assert len(rows) == len(ROWS) - 2 and Counter(r["doc_id"] for r in rows)[1] == 1
    else:
        assert ids == expected
    if name in ("pii", "keep_one", "drop_contaminated"):
        assert out.columns[: len(df.columns)] == df.columns and all(r["own_id"] == "clash own_id" for r in rows)
    assert OPERATORS[name](spark, df.where("doc_id < 0")).collect() == []


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.01], 1), (3, None, 1), (4, [2.0, 0.0], None), (5, [5.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(1) for c in ("row", "own", "n", "n_links", "component_id", "node")})
    out = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in embeddings.near_vectors(df).collect())
    assert out == [(0, 3, 1, False), (1, 3, 1, True), (1, 3, 1, True), (3, 0, 3, True), (4, 0, 4, True), (5, 3, 1, False)]
    assert embeddings.near_vectors(df.where("vec_id < 0")).collect() == []


def test_vectors_against_all_pairs(spark):
    """Links, components and the kept vector of planted near pairs, chains among them, many in one label."""
    g = np.random.default_rng(3)
    base = g.standard_normal((400, 24))
    x = np.concatenate([base, *[base[:120] + s * g.standard_normal((120, 24)) for s in (0.1, 0.25, 0.38)], base[:30]])
    label = np.concatenate([np.zeros(400, int), np.zeros(360, int), np.zeros(30, int)])
    df = spark.createDataFrame([(k, [float(v) for v in x[k]], int(label[k])) for k in range(len(x))], "vec_id long, embedding array<double>, label int")
    y = x / np.linalg.norm(x, axis=1)[:, None]
    cosine = y @ y.T
    near = cosine >= 0.93
    assert not (np.abs(cosine - 0.93) < 1e-9).any() and near.sum() > len(x) + 300
    np.fill_diagonal(near, False)
    part = np.arange(len(x))
    while True:
        least = np.array([min([part[k], *part[near[k]]]) for k in range(len(x))])
        if (least == part).all():
            break
        part = least
    out = {r["vec_id"]: r for r in embeddings.near_vectors(df, recall=0.999999).collect()}
    assert [out[k]["n_links"] for k in range(len(x))] == near.sum(axis=1).tolist()
    assert [out[k]["component_id"] for k in range(len(x))] == part.tolist()
    assert all(out[k]["kept"] == (part[k] == k) for k in range(len(x)))


def test_copies_of_one_vector_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(embeddings.blocks.dealt_join, "__defaults__", (50,))
    df = spark.range(400).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"), F.lit(1).alias("label"))
    out = embeddings.near_vectors(df).collect()
    assert len(out) == 400 and {(r["n_links"], r["component_id"]) for r in out} == {(399, 0)}


def test_urls(spark):
    pages = spark.createDataFrame([(1, "http://org/"), (1, "http://org/"), (None, None)], "page_id long, url string").withColumns({c: F.lit("x") for c in ("row", "host", "path", "rule", "verdict", "digest")})
    assert sorted((r["page_id"] or 0, r["host"]) for r in url_rules.judge_urls(pages, url_rules.RULES).collect()) == [(0, ""), (1, "org"), (1, "org")]
    assert url_rules.judge_urls(pages.where("page_id < 0"), url_rules.RULES).collect() == []


@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, tmp_path, empty):
    import corpus_pipeline

    docs = table(spark).where("doc_id < 0") if empty else table(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    benchmark(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        at = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert at.columns == docs.columns
    assert (at.count() == 0) == empty


@pytest.mark.parametrize("stage", ["keep_one", "drop_contaminated", "contamination", "remove_repeats"])
def test_other_splits_change_nothing(spark, tmp_path, stage):
    """Between the call and the action the table is split and ordered anew, as after a loss of executors."""
    g = random.Random(5)
    texts = [" ".join(f"w{g.randrange(3000)}" for _ in range(60)) for _ in range(150)]
    texts += texts[:40] + [t + " end" for t in texts[40:60]] + ["one two three four five six seven"] * 3
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6).write.parquet(f"{tmp_path}/d")
    run = {
        "keep_one": lambda d: simhash.keep_one(d),
        "drop_contaminated": lambda d: decontaminate.drop_contaminated(d, benchmark(spark)),
        "contamination": lambda d: decontaminate.contamination(d, benchmark(spark)),
        "remove_repeats": lambda d: repeats.remove_repeats(d),
    }[stage]
    plain = sorted(map(str, run(spark.read.parquet(f"{tmp_path}/d")).collect()))
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")}
    try:
        out = run(spark.read.parquet(f"{tmp_path}/d"))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        assert sorted(map(str, out.collect())) == plain
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_stored_ledger(spark, tmp_path):
    """Two updates over several versions of several paths: old blobs are not scanned again, every path keeps its findings."""
    def versions(rows):
        return spark.createDataFrame(rows, "path string, version int, text string")

    first = versions([("a", 1, "token=abcdef1"), ("a", 2, "clean"), ("b", 1, "token=abcdef1"), ("c", 1, None)])
    path = f"{tmp_path}/ledger"
    assert secret_ledger.read_ledger(spark, path).count() == 0
    assert secret_ledger.update_ledger(first, path).count() == 3
    every = first.unionAll(versions([("a", 3, "secret=zzzzzz9"), ("d", 1, "clean"), ("d", 2, "secret=zzzzzz9")]))
    ledger = secret_ledger.update_ledger(every, path)
    assert ledger.count() == 4 and secret_ledger.update_ledger(every, path).count() == 4
    assert secret_ledger.update_ledger(every, path, rule_version=2).count() == 8
    found = secret_ledger.findings_by_path(every, secret_ledger.read_ledger(spark, path)).collect()
    assert {(r["path"], r["version"]): len(r["findings"]) for r in found} == {("a", 1): 1, ("a", 2): 0, ("a", 3): 1, ("b", 1): 1, ("c", 1): 0, ("d", 1): 0, ("d", 2): 1}
