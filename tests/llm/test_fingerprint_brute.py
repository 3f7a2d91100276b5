"""Fingerprints against a naive parser, and pairs of neighbours over many buckets, with null and repeated ids."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import fingerprint as fp

MASK = (1 << 64) - 1
MIX = [int(x) for x in fp._MIX]
PLACE = [int(x) for x in fp._PLACE]


def mix(x):
    x = (x ^ x >> 30) * MIX[1] & MASK
    x = (x ^ x >> 27) * MIX[0] & MASK
    return x ^ x >> 31


def coin(before, symbol):
    """Twice the lowest bit that differs, plus that bit of the symbol."""
    differ = before ^ symbol
    k = (differ & -differ).bit_length() - 1
    return 2 * k + (symbol >> k & 1)


def naive_level(symbols):
    runs = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    y = [s if n == 1 else mix((s + n * MIX[0]) & MASK) for s, n in runs]
    label = [coin(y[i - 1] if i else y[i] ^ 1, y[i]) for i in range(len(y))]
    for _ in range(3):
        label = [coin(label[i - 1] if i else label[i] ^ 1, label[i]) for i in range(len(y))]
    names, phrase = [], []
    for i, s in enumerate(y):
        if i and i + 1 < len(y) and label[i - 1] < label[i] > label[i + 1]:
            names.append(phrase)
            phrase = []
        phrase.append(s)
    names.append(phrase)
    return [mix(sum(mix((s + MIX[0]) & MASK) * PLACE[min(k, 63)] for k, s in enumerate(p)) & MASK) for p in names]


def naive(text):
    symbols, names = [ord(c) for c in text or ""], set()
    for level in range(1, max(fp.LEVELS) + 1):
        symbols = naive_level(symbols) if symbols else []
        if level in fp.LEVELS:
            names |= {s >> 32 for s in symbols}
    return "".join(f"{n:08x}" for n in sorted(names)[: fp.KEPT])


def some_texts(rng):
    letters = "ab \nécд日😀"
    texts = ["", "a", "aaaaaa", "ab" * 300, "word " * 200]
    return texts + ["".join(rng.choice(letters[: rng.randrange(2, len(letters))]) for _ in range(rng.randrange(1, 900))) for _ in range(60)]


def test_naive_parser():
    texts = some_texts(random.Random(1))
    assert fp.fingerprints(texts) == [naive(t) for t in texts]


def rows_expected(rows):
    out = []
    for k, (i, t) in enumerate(rows):
        nxt, h = rows[(k + 1) % len(rows)][1], len(t) // 2
        edited = t[: len(t) - h] + nxt[:h]
        a, e, b = naive(t), naive(edited), naive(nxt)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, e, fp.likeness(a, e), fp.likeness(a, b)))
    return out


def test_pairs_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(fp, "BUCKET_ROWS", 4)
    rng = random.Random(2)
    rows = [(rng.randrange(-(10**6), 10**6), t) for t in some_texts(rng)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit("k"), "copy": F.lit(1), "bucket": F.lit("b")})
    found = [tuple(r) for r in fp.in_pairs(docs).orderBy(F.desc("doc_id")).collect()]
    assert found == rows_expected(sorted(rows, reverse=True))


@pytest.mark.parametrize("size", [4, 4096])
def test_null_and_repeated_ids(spark, monkeypatch, size):
    """Rows of one id, or of none, follow each other in some order: every row once, and each followed by one of the others."""
    monkeypatch.setattr(fp, "BUCKET_ROWS", size)
    rows = [(None, f"n{k} text") for k in range(20)] + [(5, f"r{k} more text") for k in range(20)] + [(5, "same")] * 6 + [(9, None), (2, "")]
    found = fp.in_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.fingerprint) for r in found) == sorted((str(i), naive(t)) for i, t in rows)
    halves = {hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest() for t in {t or "" for _, t in rows} for n in {t or "" for _, t in rows}}
    assert {r.edited_sha256 for r in found} <= halves
    assert fp.in_pairs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = fp.in_pairs(spark.createDataFrame([(None, "abcd")], "doc_id long, text string")).collect()
    assert [(r.n_chars, r.near_next) for r in one] == [(4, 1.0)]
