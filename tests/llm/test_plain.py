"""Plain Python versions of the keyed permutation, of token attribution and of scoring."""

from __future__ import annotations

import datetime
import hashlib
import random
import zlib
from collections import Counter

import pytest

from ohmgrid.llm import pii, token_counts, tokens, toxicity

DOC = "doc_id long, text string"


def plain_feistel(left, right, left_size, right_size, key, kind, block=0):
    def number(turn, half, modulus):
        return int(hashlib.sha256(f"{key}:{kind}:{block}:{turn}:{half}".encode()).hexdigest()[:15], 16) % modulus

    for turn in range(10):
        if turn % 2 == 0:
            left = (left + number(turn, right, left_size)) % left_size
        else:
            right = (right + number(turn, left, right_size)) % right_size
    return left, right


def plain_permute(values, radices, key, kind):
    def number(digits, own):
        n = 0
        for d, r in zip(digits, own, strict=True):
            n = n * r + d
        return n

    def size(own):
        n = 1
        for r in own:
            n *= r
        return n

    def digits(n, own):
        out = []
        for r in reversed(own):
            n, d = divmod(n, r)
            out.append(d)
        return out[::-1]

    k = (len(values) + 1) // 2
    a, b = plain_feistel(number(values[:k], radices[:k]), number(values[k:], radices[k:]), size(radices[:k]), size(radices[k:]), key, kind)
    return digits(a, radices[:k]) + digits(b, radices[k:])


def plain_symbols(text):
    return [(int(c), 10) if c.isdigit() else (ord(c.lower()) - 97, 26) for c in text if c.isalnum()]


def refill(template, values):
    left = iter(values)
    return "".join(str(next(left)) if c.isdigit() else chr(next(left) + (97 if c.islower() else 65)) if c.isalpha() else c for c in template)


def luhn_digit(payload):
    total = sum(d if k % 2 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(payload)))
    return -total % 10


def test_pseudonyms_equal_the_plain_permutation(spark):
    rng = random.Random(4)
    rows, expected = [], []
    for _ in range(25):
        octets = [rng.randrange(256) for _ in range(4)]
        rows.append(".".join(map(str, octets)))
        expected.append(".".join(map(str, plain_permute(octets, [256] * 4, "k", "ipv4"))))
        local = "".join(rng.choice("abcXYZ019._") for _ in range(rng.randrange(2, 12))) + "q"
        own = plain_symbols(local)
        rows.append(f"{local}@mail.example.com")
        expected.append(refill(local, plain_permute([v for v, _ in own], [r for _, r in own], "k", "email")) + "@mail.example.com")
        payload = [rng.choice([3, 4, 5, 6]), *[rng.randrange(10) for _ in range(14)]]
        rows.append("".join(map(str, [*payload, luhn_digit(payload)])))
        mixed = [payload[0], *plain_permute(payload[1:], [10] * 14, "k", "card")]
        expected.append("".join(map(str, [*mixed, luhn_digit(mixed)])))
        area, group, serial = rng.choice([5, 665, 667, 899]), rng.randrange(1, 100), rng.randrange(1, 10_000)
        rows.append(f"{area:03d}-{group:02d}-{serial:04d}")
        a, b, c = plain_permute([area - 1 - (area > 666), group - 1, serial - 1], [898, 99, 9999], "k", "ssn")
        expected.append(f"{a + 1 + (a >= 665):03d}-{b + 1:02d}-{c + 1:04d}")
        day = datetime.date(1900, 1, 1) + datetime.timedelta(rng.randrange(73_049))
        n = (day - datetime.date(1900, 1, 1)).days
        a, b = plain_feistel(n // 4297, n % 4297, 17, 4297, "k", "date")
        rows.append(day.isoformat())
        expected.append((datetime.date(1900, 1, 1) + datetime.timedelta(a * 4297 + b)).isoformat())
    df = spark.createDataFrame(list(enumerate(f"x {r} y" for r in rows)), DOC)
    assert [r["text"] for r in pii.pseudonymise(df, key="k").orderBy("doc_id").collect()] == [f"x {e} y" for e in expected]


def test_sections_equal_a_plain_attribution(spark):
    rng = random.Random(9)
    pieces = ["word", "\n", "\n\n", " ", "é", "日本", "\r\n", "tail  ", "x\n  y", "123"]
    texts = [None, "", "\n", "a\n", *["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 60))) for _ in range(60)]]
    got = {(r["doc_id"], r["section"]): r for r in token_counts.count_sections(spark.createDataFrame(list(enumerate(texts)), DOC)).collect()}
    encoder = tokens.encoder(tokens.default_path())
    seen, crossed = 0, 0
    for k, text in enumerate(texts):
        lines = (text or "").split("\n")
        lines = [line + "\n" for line in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 else [])
        owner = [s for s, line in enumerate(lines) for _ in line.encode()]
        count, crossing, at = Counter(), Counter(), 0
        for t in encoder.tokenizer.encode(text or "", add_special_tokens=False).ids:
            own = owner[at : at + int(encoder.n_bytes[t])]
            at += len(own)
            share = Counter(own)
            best = min(share, key=lambda s: (-share[s], s))
            count[best] += 1
            crossing[best] += len(share) > 1
        assert at == len(owner)
        start = 0
        for s, line in enumerate(lines):
            r = got[k, s]
            assert (r["start"], r["n_chars"], r["n_tokens"], r["n_crossing"]) == (start, len(line), count[s], crossing[s]), (k, s)
            start += len(line)
            seen, crossed = seen + 1, crossed + crossing[s]
    assert seen == len(got) and crossed > 0


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    plain = [" ".join(f"w{rng.choice('abcdefgh')}{rng.choice('stuvxyz')}{rng.choice('lmnop')}o" for _ in range(50)) for _ in range(240)]
    return toxicity.fit([t + " vilestword horridthing" for t in plain[:60]], plain[60:])


def test_scores_equal_a_plain_run(spark, model):
    texts = [None, "", "waslo vilestword", "wbtmo wcuno", "VILESTWORD " * 3, "x" * 900]
    scored = toxicity.score_texts(spark.createDataFrame(list(enumerate(texts)), DOC), model)
    assert [r["score"] for r in scored.orderBy("doc_id").collect()] == [model.score(t) for t in texts]

    def gain(word):
        import zstandard

        sizes = []
        for content in (model.ordinary, model.toxic):
            own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(toxicity.LEVEL, min_match=4, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(len(zstandard.ZstdCompressor(compression_params=how, dict_data=own).compress(f" {word} ".encode() + toxicity.ANCHOR)))
        return sizes[0] - sizes[1]

    assert all(model.gain(w) == gain(w) for w in ("waslo", "vilestword", "horridthing", "unseen"))
    assert model.score("waslo vilestword wbtmo") >= 0.5 > model.score("waslo wbtmo wcuno")


def test_learning_leaves_the_fold_out(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(f"w{rng.randrange(300)}" for _ in range(40)) + (" onlyheldout" if zlib.crc32(str(k).encode()) % 5 == 0 else "")) for k in range(200)]
    rows += [(7, "many texts of one id " + str(j)) for j in range(30)]
    labels = spark.createDataFrame([(k, int(zlib.crc32(str(k).encode()) % 5 == 0 or k % 5 == 1)) for k in range(200)], "doc_id long, toxic int")
    learned = toxicity.learn(spark.createDataFrame(rows, DOC), labels)
    assert b"onlyheldout" not in learned.toxic + learned.ordinary
