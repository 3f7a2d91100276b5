"""Tokens of sections against the library's offsets and a plain allocation."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    t.post_processor = None  # it trims offsets
    return t


def plain(offsets, sections):
    """(tokens, crossing tokens) by section, straight from the rule."""
    n, crossing = {}, {}
    for a, b in offsets:
        best, most = -1, 0
        for k in sorted(range(len(sections)), key=lambda k: (sections[k][0], k)):
            held = min(b, sections[k][1]) - max(a, sections[k][0])
            if held > most:
                best, most = k, held
        n[best] = n.get(best, 0) + 1
        if best >= 0 and (a < sections[best][0] or b > sections[best][1]):
            crossing[best] = crossing.get(best, 0) + 1
    return n, crossing


def some_text(rng):
    return "".join(rng.choice(["word ", "ö", "日本", "\n", "  ", "it's", "<|endoftext|>", "1234", "😀", "x"]) for _ in range(rng.randrange(60)))


def test_spans_are_the_library_s(library):
    rng, spans = random.Random(1), token_counts.TokenSpans(bpe.ByteBPE(bpe.read_spec(PATH)))
    for _ in range(300):
        text = some_text(rng)
        starts, ends = spans.of(text)
        assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == [tuple(x) for x in library.encode(text, add_special_tokens=False).offsets]


@pytest.mark.parametrize("kind", ["sorted", "any order", "overlapping"])
def test_allocation(kind):
    rng = random.Random(2)
    for _ in range(400):
        cuts = sorted(rng.randrange(40) for _ in range(rng.randrange(12) * 2))
        sections = [tuple(cuts[i : i + 2]) for i in range(0, len(cuts), 2)]
        if kind != "sorted":
            rng.shuffle(sections)
        if kind == "overlapping":
            sections = [(a, b + rng.randrange(9)) for a, b in sections]
        at, tokens = 0, []
        while at < 40:
            end = at + rng.randrange(1, 6)
            tokens += [(at, end)] * rng.choice([1, 1, 1, 2])  # parts of one character
            at = end
        found = token_counts.attribute(*np.array(tokens).T, *np.array(sections, np.int64).reshape(-1, 2).T)
        n, _ = plain(tokens, sections)
        assert {k: int((found == k).sum()) for k in set(found.tolist())} == n


def test_counts(spark, library):
    rng = random.Random(3)
    texts = [some_text(rng) for _ in range(80)] + ["", None, "ab " * 60_000]
    lines = {k: [(0, 0)] if not t else [] for k, t in enumerate(texts)}
    for k, t in enumerate(texts):
        at, lines[k] = 0, []
        for part in (t or "").split("\n"):
            lines[k].append((at, at + len(part) + 1))
            at += len(part) + 1
        lines[k][-1] = (lines[k][-1][0], at - 1)
    docs = spark.createDataFrame([(k, t, "own") for k, t in enumerate(texts)] + [(None, "a b", "own")], "doc_id long, text string, section string")
    found = {}
    for r in token_counts.count_tokens(docs, PATH).collect():
        found.setdefault(r.doc_id, {})[r.section] = (r.n_chars, r.n_tokens, r.n_crossing)
    for k, t in enumerate(texts):
        n, crossing = plain([tuple(x) for x in library.encode(t or "", add_special_tokens=False).offsets], lines[k]) if len(t or "") < 1000 else (None, None)
        if n is None:
            assert found[k][0][1] == len(library.encode(t, add_special_tokens=False).ids)
        else:
            assert found[k] == {s: (b - a, n.get(s, 0), crossing.get(s, 0)) for s, (a, b) in enumerate(lines[k])}
    assert found[None] == {0: (3, 2, 0)}
    assert token_counts.count_tokens(docs.limit(0), PATH).count() == 0


def test_given_sections(spark):
    rows = [("abc def", [(4, 7), (0, 3)]), ("abc def", [(0, 7), (0, 3)]), ("abc def", [(2, 2), None]), ("abc def", None), (None, [(0, 5)]), ("abc", [(2, 99), (-5, 1)])]
    docs = spark.createDataFrame([(k, t, s) for k, (t, s) in enumerate(rows)], "doc_id long, text string, parts array<struct<start: long, end: long>>")
    found = {}
    for r in token_counts.count_tokens(docs.withColumn("n_tokens", F.lit(1)), PATH, sections="parts").collect():
        found.setdefault(r.doc_id, {})[r.section] = r.n_tokens
    assert found == {0: {0: 1, 1: 1}, 1: {0: 2, 1: 0}, 2: {-1: 2, 0: 0, 1: 0}, 3: {-1: 2}, 4: {0: 0}, 5: {0: 0, 1: 1}}  # abc is one token, a part of both: a tie
