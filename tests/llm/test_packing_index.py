"""Complement indexes against all combinations, plans, the tables of places, and ids of words on random text."""

import itertools
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("most", [1, 2, 3])
def test_complements_under_falling_counts(most):
    rng = random.Random(most)
    for _ in range(150):
        cap = rng.randrange(6, 40)
        left = np.zeros(cap + 1, np.int64)
        for _ in range(rng.randrange(1, 9)):
            left[rng.randrange(1, cap)] += rng.randrange(1, 3)
        index = packing.Complements(left, most)
        for _ in range(30):
            gap = rng.randrange(1, cap)
            held = [x for x in range(1, cap) for _ in range(min(3, int(left[x])))]
            possible = any(sum(c) == gap for r in range(1, most + 1) for c in itertools.combinations(held, r))
            found = index.filling(gap)
            assert (found is not None) == possible
            assert not found or (sum(found) == gap and all(left[x] >= found.count(x) for x in found))
            if held and rng.random() < 0.6:
                left[rng.choice(held)] -= 1


def test_plans_use_every_length_once():
    rng = random.Random(1)
    for cap in (7, 30, 4096):
        for _ in range(8):
            histogram = {rng.randrange(1, cap + 1): rng.choice([1, 2, 7, 10**6]) for _ in range(rng.randrange(1, 60))}
            plan, _ = packing.plan_packing(histogram, cap)
            used = {}
            for runs, n in plan:
                assert n > 0 and sum(length * k for length, k in runs) <= cap
                for length, k in runs:
                    used[length] = used.get(length, 0) + n * k
            assert used == histogram
            assert sum(n for _, n in plan) >= packing.lower_bound(histogram, cap)


def test_a_third_length_completes():
    assert packing.plan_packing({60: 5, 30: 5, 10: 5}, 100) == ([(((60, 1), (30, 1), (10, 1)), 5)], 3)
    assert packing.plan_packing({1: 10**9, 4095: 5}, 4096)[0][0] == (((4095, 1), (1, 1)), 5)


def test_places(spark):
    """Every rank has its own place, gapless in each sequence, with one length in most rows and null and repeated ids."""
    rng = random.Random(2)
    rows = [(k if k % 7 else None, 0, 40 if k % 3 else rng.randrange(1, 101), "own") for k in range(900)] + [(5, 1, 40, "own")] * 3
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length long, rank string").withColumns({"offset": F.lit("x"), "cell": F.lit("y"), "Base": F.lit("z")})
    found = packing.place(pieces, 100).collect()
    assert {(r.rank, r.cell, r.Base) for r in found} == {("own", "y", "z")}
    assert len(found) == len(rows)
    ends = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0) and r.offset + r.length <= 100
        ends[r.sequence_id] = r.offset + r.length
    histogram = {}
    for r in rows:
        histogram[r[2]] = histogram.get(r[2], 0) + 1
    assert len(ends) == sum(n for _, n in packing.plan_packing(histogram, 100)[0])
    assert packing.place(pieces.limit(0), 100).count() == 0


def test_words_are_encoded_as_the_library_does():
    rng, library = random.Random(3), Tokenizer.from_file(PATH)
    coder = packing.WordCoder(bpe.read_spec(PATH))
    letters = [chr(c) for c in [*range(1, 0x250), *range(0x370, 0x590), *range(0x1E00, 0x2060), 0x2028, 0x3000, 0x4E2D, 0xFB01, 0xFF21, 0x1F600, 0x0130, 0x00AD, 0x200D]]
    common = list("abcdefghij  \n'.,!?;:-_ABCéüß0129") + ["'s", "'ll", "<|", "|>", "<|endoftext|>", "ing ", "the "]
    for k in range(3000):
        share = (0.0, 0.1, 0.9)[k % 3]
        texts = ["".join(rng.choice(letters if rng.random() < share else common) for _ in range(rng.randrange(40))) for _ in range(2)]
        for text, packed in zip(texts, coder.encode_all(texts), strict=True):
            assert np.frombuffer(packed, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
