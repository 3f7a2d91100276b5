"""Large groups dealt as blocks, chains that percolate, repeated ids, and clashing columns, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import dedup

WIDTH, PERCENT = 3, 85


def brute(rows):
    """Components of the exact links between ids, of an id's texts the one with most shingles."""
    sets = {}
    for i, t in rows:
        s = frozenset(dedup.shingles(t, WIDTH).tolist())
        if i is not None and len(s) > len(sets.get(i, ())):
            sets[i] = s
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= PERCENT * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {i: root(i) for i in parent}


def edited(words, share, rng):
    return [f"x{rng.random()}" if rng.random() < share else w for w in words]


@pytest.mark.parametrize(("block", "bucket", "cells"), [(6, 8, 8), (6, 8, 1), (512, 2048, 8)])
def test_percolating_groups(spark, block, bucket, cells):
    """A drifting chain, whose ends are unlike, a large group of near copies, and pairs below the threshold that share bands."""
    rng, rows = random.Random(3), []
    words = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    for _ in range(60):
        words = edited(words, 0.02, rng)
        rows.append((len(rows), " ".join(words)))
    base = [f"v{rng.randrange(10**6)}" for _ in range(120)]
    rows += [(len(rows) + k, " ".join(edited(base, 0.01 if k % 3 else 0.06, rng))) for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in dedup.near_duplicates(docs, WIDTH, PERCENT, block=block, bucket=bucket, most_cells=cells).collect()}
    expected = brute(rows)
    assert found == expected
    assert 2 < len(set(expected.values())) < len(rows) - 50


def test_many_copies_and_repeated_ids(spark):
    """More copies than a hot key takes, ids that repeat with the same and with other texts, null ids."""
    rng = random.Random(4)
    base = " ".join(f"w{k}" for k in range(50))
    rows = [(k, base) for k in range(700)] + [(900, base + " a b"), (901, "other words"), (901, base + " a b"), (902, "p q"), (902, "p q"), (None, base), (None, base), (903, None), (904, " ")]
    rng.shuffle(rows)
    found = dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), WIDTH, PERCENT).collect()
    expected = brute(rows)
    assert sorted((str(r.doc_id), r.n_shingles) for r in found) == sorted((str(i), len(dedup.shingles(t, WIDTH))) for i, t in rows)
    assert all(r.component_id == expected.get(r.doc_id) if r.doc_id is not None else r.component_id is None and r.kept for r in found)
    assert expected[901] == 0 and {r.component_id for r in found if r.doc_id == 901} == {0}


def test_stage_keeps_columns(spark):
    names = "kept component_id n_shingles sig bands n key group part".split()
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, None)], "doc_id long, text string")
    wide = docs.select("*", *(F.lit(k).alias(name) for k, name in enumerate(names)))
    found = dedup.dedup_stage(spark, wide, "")
    assert found.columns == wide.columns
    assert sorted(str(r.doc_id) for r in found.collect()) == ["1", "3", "None"]
    assert dedup.dedup_stage(spark, wide.limit(0), "").count() == 0


def test_passage_that_all_share(spark):
    """A passage of 40 of 50 words: hot bands, all pairs just below the threshold, few linked; the parts are divided by rare shingles."""
    rng = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(k, " ".join(f"o{rng.random()}" for _ in range(10)) + " " + passage) for k in range(250)]
    rows += [(1000 + k, rows[k][1] + " more") for k in range(0, 60, 2)] + [(2000 + k, f"first {rows[k][1]}") for k in range(0, 60, 3)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.component_id for r in dedup.near_duplicates(docs, WIDTH, PERCENT, block=8, bucket=16, most_cells=2).collect()}
    assert found == brute(rows)
    assert len(set(found.values())) == 250


@pytest.mark.parametrize("percent", [50, 80, 85, 100])
def test_rarest_shingles_meet(percent):
    """Whatever the counters hold, two linked sets share one of their rarest shingles."""
    rng = dedup.np.random.default_rng(percent)
    linked = 0
    for _ in range(2000):
        x = dedup.np.unique(rng.integers(0, 1 << 63, rng.integers(1, 40), dtype=dedup.np.uint64) * dedup.np.uint64(2))
        kept = x[rng.random(len(x)) < rng.uniform(percent / 100, 1)]
        y = dedup.np.union1d(kept, rng.integers(0, 1 << 63, rng.integers(0, 4), dtype=dedup.np.uint64))
        both = len(dedup.np.intersect1d(x, y))
        if both and 100 * both >= percent * (len(x) + len(y) - both):
            linked += 1
            counts = rng.integers(0, 5, 16)
            assert set(dedup.rarest(x, counts, percent)) & set(dedup.rarest(y, counts, percent))
    assert linked > 100
