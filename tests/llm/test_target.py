"""Importance resampling, WARC archives and Merkle manifests against plain versions and edge cases."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ohmgrid.functions.storage import new_folder, scope
from ohmgrid.llm import importance, merkle, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["key", "row", "n", "part", "at", "grp", "member", "able", "place", "n_words", "score", "number_in_table", "digest", "record", "size", "of", "original", "kind", "path"]
LOWER = {c: c + 32 for c in range(65, 91)}


def clashing(df):
    return df.withColumns({c: F.lit(f"clash {c}") for c in CLASHES})


# ---------------------------------------------------------------- 11
def features(text, longest=2):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return w, [" ".join(w[k : k + n]) for n in range(1, longest + 1) for k in range(len(w) - n + 1)]


def plain_resample(rows, target, share=(25, 100), least=20, buckets=10_000, longest=2):
    """(id, words, features, weight, score, rank) of each row."""
    def hashed(t):
        return Counter(zlib.crc32(f.encode()) % buckets for f in features(t, longest)[1])

    s, t = sum((hashed(x) for _, x in rows), Counter()), sum((hashed(x) for x in target), Counter())
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for k, text in rows:
        w, own = features(text, longest)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in (zlib.crc32(f.encode()) % buckets for f in own)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append([k, len(w), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((k for k, r in enumerate(out) if r[1] >= least), key=lambda k: (-out[k][4], out[k][0] is not None, out[k][0] or 0))
    rank = {k: n + 1 for n, k in enumerate(able[: share[0] * len(able) // share[1]])}
    return sorted(str((*r, rank.get(k))) for k, r in enumerate(out))


def some_texts():
    rng = random.Random(11)
    texts = [" ".join(f"W{int(rng.paretovariate(0.6))}" for _ in range(rng.randrange(120))) for _ in range(80)]
    return [*texts, None, "", " .,; ", "one", "Él niño—Ünïcode Été x9 9x " * 9, "a" * 5_000, " ".join(f"long{k % 977}" for k in range(60_000))]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_resample(spark, longest, monkeypatch):
    monkeypatch.setattr(importance, "BLOCK", 500)  # long texts lie in many blocks
    rows = list(enumerate(some_texts()))
    target = [t for _, t in rows[5:15]] + [None, "W1 W2 W3"]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    out = importance.resample(df, spark.createDataFrame([(t,) for t in target], "text string").withColumn("key", F.lit("x")), longest=longest).collect()
    assert sorted(str(tuple(r)) for r in out) == plain_resample(rows, target, longest=longest)


def test_features_of_slices():
    for text in some_texts():
        raw = (text or "").encode()
        whole = Counter(zlib.crc32(f.encode()) % 65_536 for f in features(text, 3)[1])
        for size in (1, 7, 1 << 20) if len(raw) < 10_000 else (1000,):
            parts = list(importance.feature_buckets(raw, 3, 65_536, size))
            assert sum((Counter(p.tolist()) for p, _ in parts), Counter()) == whole and sum(n for _, n in parts) == len(features(text)[0])


def test_resample_edges(spark):
    words = " ".join(f"w{k}" for k in range(30))
    rows = [(1, words), (1, words), (None, words), (None, words), (2, None), (3, words + " w1")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    none = df.where("doc_id > 9")
    for target in ([], [words]):
        aim = spark.createDataFrame([(t,) for t in target], "text string")
        out = importance.resample(df, aim, share=(2, 3)).collect()
        expected = plain_resample(rows, target, share=(2, 3))
        assert sorted(str(tuple(r)) for r in out)[0] == expected[0] and sorted(r["rank"] for r in out if r["rank"]) == [1, 2, 3]
        assert sorted(str(tuple(r)[:5]) for r in out) == sorted(x.rsplit(", ", 1)[0] + ")" for x in expected)
        assert importance.resample(none, aim).collect() == []
    with pytest.raises(ValueError):
        importance.resample(df, df, buckets=65_537)


# ---------------------------------------------------------------- 12
def plain_archive(rows, least=0):
    digests = [base64.b32encode(hashlib.sha1((b or "").encode()).digest()).decode() for _, b in rows]
    best = defaultdict(lambda: -1)
    for (k, _), d in zip(rows, digests, strict=True):
        best[d] = max(best[d], -1 if k is None else k)
    out, seen = [], set()
    for (k, b), d in zip(rows, digests, strict=True):
        n = len((b or "").encode())
        first = (k if k is not None else -1) == best[d] and d not in seen
        if n < least or first:
            seen.add(d)
            out.append((k, n, d, "response", None))
        else:
            out.append((k, n, d, "revisit", best[d] if best[d] >= 0 else None))
    return sorted(map(str, out))


PAGES = [(1, "http://a/\r\nX: y", "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"), (2, None, "same"), (3, "u", "same"), (4, "u", None), (None, "u", ""), (5, "http://é/", "é\x00" * 100_000),
         (3, "u", "same"), (None, "u", "same"), (7, "u", "lone"), (8, "u", "\r\n"), (9, "u", "same ")]


@pytest.mark.parametrize("least", [0, 4, 5, 10**9])
def test_archives(spark, least):
    df = clashing(spark.createDataFrame([(k, u, b) for k, u, b in PAGES], "page_id long, url string, html string")).repartition(3)
    with scope(spark):
        folder = new_folder(spark, "warc")
        out = sorted(str(tuple(r)) for r in warc.archive_pages(df, folder, least_bytes=least).collect())
        assert out == plain_archive([(k, b) for k, _, b in PAGES], least)
        records = warc.read_archives(spark, f"{folder}/archive", payload=True).collect()
        by_id = {r["record_id"]: r for r in records}
        assert len(by_id) == len(PAGES)
        for r in records:
            if r["record_type"] == "revisit":
                assert r["payload"] is None and by_id[r["refers_to_id"]]["payload_digest"] == r["payload_digest"]
        bodies = {(r["key"], bytes(r["payload"]).decode()) for r in records if r["record_type"] == "response"}
        assert bodies <= {(None if k is None else str(k), b or "") for k, _, b in PAGES}
        assert {r["target_uri"] for r in records} == {"http://a/%0D%0AX: y", "u", "http://é/", None}
        assert warc.archive_pages(df.where("page_id > 100"), new_folder(spark, "warc")).collect() == []


def test_many_copies(spark):
    """One body in a third of all pages, far more than a thousandth, beside pairs that are fewer."""
    rows = [(k, None, "hot" if k % 3 == 0 else f"pair {k % 2500}") for k in range(6000)]
    with scope(spark):
        out = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), new_folder(spark, "warc")).collect()
    assert sorted(str(tuple(r)) for r in out) == plain_archive([(k, b) for k, _, b in rows])


def test_foreign_archives(spark, tmp_path):
    """Members of their own, other records, revisits without an original, and files that are broken."""
    def rec(kind, body, *lines):
        return ("\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", *lines, f"Content-Length: {len(body)}"]) + "\r\n\r\n").encode() + body + b"\r\n\r\n"

    parts = [rec("warcinfo", b"software: x"), rec("response", b"HTTP/1.1 200 OK\r\n\r\nbody", "WARC-Record-ID: <a>", "Content-Type: application/http"),
             rec("response", b"body", "warc-record-id: <b>"), rec("revisit", b"", "WARC-Record-ID: <c>", "WARC-Payload-Digest: sha1:UNKNOWN", "WARC-Refers-To: <z>")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    with scope(spark):
        out = new_folder(spark, "warc")
        warc.deduplicate(spark, str(tmp_path / "in"), out)
        rows = {r["record_id"]: (r["record_type"], r["refers_to_id"]) for r in warc.read_archives(spark, out).collect()}
    assert rows == {"<a>": ("revisit", "<b>"), "<b>": ("response", None), "<c>": ("revisit", "<z>")}
    cut = b"".join(parts)[:-12]
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parse(memoryview(cut[: cut.rindex(b"Content-Length")] + b"Content-Length: 9\r\n\r\nx"), "f"))
    with pytest.raises(ValueError, match="no record"):
        list(warc.parse(memoryview(b"<html>"), "f"))


# ---------------------------------------------------------------- 13
def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, fields=("doc_id", "source", "lang", "n_chars", "text")):
    return h("".join("-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in fields))


def plain_tree(leaves, arity):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][k : k + arity])) for k in range(0, len(levels[-1]), arity)])
    return levels


def plain_manifest(rows, arity=2):
    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g])], arity) for g in names}
    top = plain_tree([trees[g][-1][0] for g in names], arity)
    out = []
    for n, g in enumerate(names):
        for k, (known, key, leaf) in enumerate(sorted(groups[g])):
            others = []
            for tree, at in ((trees[g], k), (top, n)):
                for level in tree[:-1]:
                    run = at // arity * arity
                    others += [level[x] for x in range(run, min(run + arity, len(level))) if x != at]
                    at //= arity
            out.append(str((key if known else None, g, leaf, trees[g][-1][0], top[-1][0], h("".join(others)))))
    return sorted(out)


def doc_rows(n, langs):
    rng = random.Random(n)
    rows = [{"doc_id": k * 7 % 1009, "text": f"text {k} é", "lang": langs[int(rng.paretovariate(1)) % len(langs)], "source": None if k % 5 == 0 else "s", "n_chars": None if k % 11 == 0 else k} for k in range(n)]
    return rows + [{"doc_id": None, "text": None, "lang": None, "source": None, "n_chars": None}, {"doc_id": 3, "text": "", "lang": langs[0], "source": "-", "n_chars": 0}, {"doc_id": 3, "text": "", "lang": langs[0], "source": "-", "n_chars": 0}]


@pytest.mark.parametrize(("n", "arity", "depth", "langs"), [(0, 2, 9, ["a"]), (1, 2, 9, ["a"]), (200, 2, 9, ["en", "", "é", "Z"]), (200, 2, 1, ["en", "fr"]), (150, 2, 3, [f"l{k}" for k in range(40)]), (150, 3, 2, ["en", "fr"]), (64, 4, 1, ["en"])])
def test_manifest(spark, n, arity, depth, langs):
    rows = doc_rows(n, langs)
    df = clashing(spark.createDataFrame([tuple(r[c.split()[0]] for c in DOC.split(", ")) for r in rows], DOC)).repartition(3)
    out = merkle.manifest(df, arity=arity, depth=depth).withColumns({"proof": merkle.path_digest(F.col("path")), "folded": merkle.fold(F.col("leaf"), F.col("path"))}).collect()
    assert sorted(str((r["doc_id"], r["lang"], r["leaf"], r["subroot"], r["root"], r["proof"])) for r in out) == plain_manifest(rows, arity)
    assert all(r["folded"] == r["root"] for r in out)


def test_manifest_finds_changes(spark):
    rows = doc_rows(100, ["en", "fr"])
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in DOC.split(", ")) for r in rows], DOC)
    present = merkle.leaf_digest([F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("!"))).otherwise(F.col(f)) if f == "text" else F.col(f) for f in merkle.FIELDS])
    out = merkle.manifest(df, carry={"present": present}).withColumn("folded", merkle.fold(F.col("present"), F.col("path"))).collect()
    assert all((r["folded"] != r["root"]) == (r["doc_id"] is not None and r["doc_id"] % 9 == 0) for r in out)
    assert merkle.manifest(df.where("doc_id > 5000")).collect() == []


def test_long_text(spark):
    df = spark.createDataFrame([(1, "x" * 3_000_000, "en", "s", 1)], DOC)
    row = merkle.manifest(df).first()
    assert row["leaf"] == row["subroot"] == row["root"] == plain_leaf({"doc_id": 1, "text": "x" * 3_000_000, "lang": "en", "source": "s", "n_chars": 1}) and row["path"] == []


# ---------------------------------------------------------------- token files
@pytest.mark.parametrize("change", [{"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}, {"normalizer": {"type": "Lowercase"}}, {}])
def test_other_token_files_take_the_library(tmp_path, change):
    """A file that splits or normalises otherwise is never read by the faster encoder, whose ids would differ."""
    import json

    from tokenizers import Tokenizer

    from ohmgrid.llm import tokens

    with open(tokens.default_path(), encoding="utf-8") as f:
        held = json.load(f) | change
    path = str(tmp_path / "t.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(held, f)
    own, library = tokens.Encoder(path), Tokenizer.from_file(path)
    assert (own.fast is None) == bool(change)
    for text in ("Hello World  again", "", "é\n\n x <|endoftext|> y", "日本"):
        assert own.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids
