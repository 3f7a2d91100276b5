"""Deep trees, cycles, deleted genres and orphans."""

import time

from tessera.operators import hierarchy as hi


def test_deep_tree_and_cycle(spark):
    deep = 40
    rows = [(f"g{i}", f"g{i - 1}" if i else "", "t") for i in range(deep)] + [("a", "b", "t"), ("b", "a", "t")]
    began = time.time()
    found = [(r.root, r.code, r.depth) for r in hi.closure(spark.createDataFrame(rows, "genre_code string, parent_code string, title string").coalesce(1)).collect()]
    expected = {(f"g{i}", f"g{j}", j - i) for i in range(deep) for j in range(i, deep)} | {("a", "a", 0), ("b", "b", 0), ("a", "b", 1), ("b", "a", 1)}
    assert len(found) == len(expected) and set(found) == expected
    assert time.time() - began < 120  # seconds on an idle machine


def test_wide_and_very_deep_trees(spark):
    """600,000 children of one root; a chain of 2000; both with the number of pairs and sums that they must have."""
    from pyspark.sql import functions as F

    sums = [F.count("*").alias("n"), F.sum("depth").alias("depth"), F.count_distinct("root", "code").alias("pairs"), F.max("depth").alias("most")]
    wide = spark.range(600_001).select(F.col("id").cast("string").alias("genre_code"), F.when(F.col("id") > 0, "0").otherwise("").alias("parent_code"))
    assert tuple(hi.closure(wide).agg(*sums).first()) == (1_200_001, 600_000, 1_200_001, 1)
    n = 2000
    chain = spark.range(n).select(F.col("id").cast("string").alias("genre_code"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent_code"))
    assert tuple(hi.closure(chain).agg(*sums).first()) == (n * (n + 1) // 2, (n - 1) * n * (n + 1) // 6, n * (n + 1) // 2, n - 1)


def test_odd_trees(spark, monkeypatch):
    """Cycles of several lengths with tails, two parents, repeated rows, null codes and parents; the same by shuffles."""
    edges = [("a", "c"), ("b", "a"), ("c", "b"), ("t1", "c"), ("t2", "t1"), ("s", "s"), ("x", "p"), ("x", "q"), ("q", "p"), ("p", ""), ("p", None), ("o", "absent"), (None, "p"), ("b", "a")]
    up = {}
    for code, parent in edges:
        if code:
            up.setdefault(code, set()).update({parent} & {c for c, _ in edges if c})
    expected = set()
    for code in up:
        depth, level, seen = 0, {code}, set()
        while level - seen:
            expected |= {(root, code, depth) for root in level - seen}
            seen |= level
            level, depth = {p for c in level for p in up[c]}, depth + 1
    df = spark.createDataFrame(edges, "genre_code string, parent_code string")
    for most in (hi.BROADCAST_PAIRS, 0):
        monkeypatch.setattr(hi, "BROADCAST_PAIRS", most)
        found = [tuple(r) for r in hi.closure(df).collect()]
        assert len(found) == len(expected) and set(found) == expected
    assert hi.closure(df.limit(0)).collect() == []


def test_paths_and_orphans(spark):
    rows = [("1", "", "B"), ("2", "1", "y"), ("3", "1", "x"), ("4", "3", "z"), ("5", "absent", "A")]
    found = [tuple(r) for r in hi.tree_paths(spark.createDataFrame(rows, "genre_code string, parent_code string, title string")).collect()]
    assert found == [("5", 0, True, "A"), ("1", 0, True, "B"), ("3", 1, False, "B / x"), ("4", 2, False, "B / x / z"), ("2", 1, False, "B / y")]
