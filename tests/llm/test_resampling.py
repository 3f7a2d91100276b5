"""Importance resampling: the table against a dictionary, hashes against the library, weights, scores and ranks against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import duckdb
import numpy as np
import xxhash
from pyspark.sql import functions as F

from tessera.llm import resampling as rs

SCHEMA = "doc_id long, text string"


def features(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def test_hashes_and_table():
    draw = random.Random(3)
    data = bytes(draw.choice(b"ab c") for _ in range(3000))
    start = np.arange(2900)
    size = np.array([draw.choice([1, 2, 3, 4, 7, 8, 9, 16, 31, 32, 33, 70]) for _ in start])
    slices = rs.Slices(data, start, size)
    texts = [data[a : a + n] for a, n in zip(start, size, strict=True)]
    assert [int(x) for x in slices.hashes()] == [xxhash.xxh64_intdigest(t) for t in texts]
    for keys in (None, np.zeros(len(start), np.uint64)[:] + np.uint64(5)):  # all keys equal: only the bytes part them
        some = slice(None) if keys is None else slice(0, 300)
        one = rs.Slices(data, start[some], size[some])
        table = rs.Table(one, None if keys is None else keys[some])
        slot = dict(zip(texts[some], table.slot_of.tolist(), strict=True))
        assert all(slot[t] == s for t, s in zip(texts[some], table.slot_of.tolist(), strict=True)) and len(set(slot.values())) == len(slot)
        assert all(table.count[slot[t]] == n and table.bucket[slot[t]] == crc32(t) % rs.BUCKETS for t, n in Counter(texts[some]).items())


def test_runs_of_words_count_every_feature_once():
    texts = ["One two, two\x00THREE é É", None, "", " - ", "x" * 100 + " y", "a b"]
    for most in (1, 2, 3, 1000):
        got = Counter()
        words = rs.words_of(texts)
        for table, doc in rs.runs(words, most):
            got.update(doc.tolist())
        assert got == {k: len(features(t)[1]) for k, t in enumerate(texts) if features(t)[1]}


def test_draw_equals_plain_python_and_sql(spark, tmp_path):
    draw = random.Random(5)
    word = lambda: draw.choice(["alpha", "Beta", "naïve", "x1", "ÉTÉ", "the", "of", "y" * 40])
    rows = [(k, " ".join(word() for _ in range(draw.choice([0, 3, 19, 20, 60])))) for k in range(150)]
    rows += [(7, rows[7][1])] * 2 + [(None, "the of alpha " * 9), (200, None), (201, ""), (202, "beta, " * 30000)]
    target = [(k, "alpha beta " * 5) for k in range(20)] + [(99, None)]
    spark.createDataFrame(rows, SCHEMA).withColumns({"n_words": F.lit(1), "rank": F.lit("r"), "part": F.lit(2), "at": F.lit(0)}).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(target, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = rs.op13_importance_resampling(spark, str(tmp_path))
    got = sorted((tuple(r) for r in found.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)
    s, t = (Counter(crc32(x.encode()) % rs.BUCKETS for _, text in part for x in features(text)[1]) for part in (rows, target))
    S, T = s.total() + rs.BUCKETS, t.total() + rs.BUCKETS
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * S / ((s[b] + 1) * T)))
    scored = []
    for k, text in rows:
        words, each = features(text)
        weight = sum(gain(crc32(x.encode()) % rs.BUCKETS) for x in each) // len(each) if each else 0
        h = int(hashlib.sha256(f"7:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        scored.append((k, len(words), len(each), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in scored if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    drawn = [(k, f, w, sc, place) for place, (k, _, f, w, sc) in enumerate(able, 1) if place <= 25 * len(able) // 100]
    rest = [(k, f, w, sc, None) for k, _, f, w, sc in able[len(drawn) :]] + [(k, f, w, sc, None) for k, n, f, w, sc in scored if n < 20]
    assert got == sorted(drawn + rest, key=repr)
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    assert got == sorted(con.sql(f"select doc_id, n_features, weight, score, rank from ({rs.ORACLE_SQL})").fetchall(), key=repr)


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a b")], SCHEMA)
    assert rs.resample(none, one).collect() == []
    assert [r.rank for r in rs.resample(one, none).collect()] == [None]
