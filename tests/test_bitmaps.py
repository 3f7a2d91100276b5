"""Facets from bitmaps equal those from joins, over trees of all kinds, sparse and negative ids, and empty catalogs."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import bitmaps as bm
from tessera.operators import facets as fc
from tessera.operators.hierarchy import closure
from tessera.operators.predicates import match
from tessera.sources.catalog import orders_catalog, stored
from tessera.sources.storage import written

LANGS = {"term": "lang", "values": ["1-URGENT", "2-HIGH"]}
TREES = [
    None,
    {"and": [LANGS, {"term": "ext", "values": ["o", ".f"]}, {"ids": "author", "values": [1, 2, 3, 999999]}]},
    {"and": [{"or": [LANGS, {"number": "seq", "op": "gte", "value": 5}]}, {"not": {"term": "genre", "values": ["R0", "N7"], "children": True}}]},
    {"and": [{"flag": "deleted", "value": True}, {"range": "year", "from": 1994, "to": 1996}]},
    {"or": [{"flag": "read", "value": False}, {"ids": "group", "values": [2]}]},
    {"term": "lang", "values": ["", "1-URGENT"]},
]


@pytest.fixture(scope="module")
def cat(spark):
    found = orders_catalog(spark, "/root/testdata/sf0.001")
    found.below = closure(found.genres)
    found = stored(spark, lambda: found, ["/root/testdata/sf0.001/orders.parquet"])
    far = lambda df: df.withColumn("book_id", F.when(F.col("book_id") % 3 == 0, -F.col("book_id")).otherwise(F.col("book_id") * 1_000_003))
    for name in ("books", "author_links", "series_links", "genre_links", "user_data"):
        setattr(found, name, far(getattr(found, name)).cache())
    found.members = far(fc.match(found, None).limit(0).select(F.lit(2).cast("long").alias("group_id"), "book_id")).unionByName(found.books.filter("year = 1995").select(F.lit(2).cast("long").alias("group_id"), "book_id"))
    return found


@pytest.fixture(scope="module")
def index(cat):
    return written(bm.bitmap_rows(cat), "bits")


@pytest.mark.parametrize("k", range(len(TREES)))
def test_equal_to_joins(spark, cat, index, k):
    fields = list(fc.FIELDS)
    assert sorted(map(str, bm.facets(cat, index, TREES[k], fields).collect())) == sorted(map(str, fc.facets(cat, TREES[k], fields).collect()))
    assert bm.total(cat, index, TREES[k]).first().total == match(cat, TREES[k]).count()


def test_words(spark):
    ids = [None, 0, 1, 63, 64, -1, -64, -65, (1 << 62) + 5]
    rows = bm.in_words(spark.createDataFrame([(i,) for i in ids + [63]], "book_id long")).collect()
    assert sorted((r.word << 6) + b for r in rows for b in range(64) if r.bits >> b & 1) == sorted(i for i in ids if i is not None)


def test_shuffled_and_empty(spark, cat, index, monkeypatch):
    broadcast = sorted(map(str, bm.facets(cat, index, LANGS, ["author", "lang"]).collect()))
    monkeypatch.setattr(bm, "BROADCAST_WORDS", 0)
    assert sorted(map(str, bm.facets(cat, index, LANGS, ["author", "lang"]).collect())) == broadcast
    none = index.limit(0)
    assert [(r.value, r.n) for r in bm.facets(cat, none, {"and": [LANGS]}, ["lang"]).collect()] == [("1-URGENT", 0), ("2-HIGH", 0)]
    assert bm.facets(cat, none, None, ["author"]).isEmpty() and bm.total(cat, none, LANGS).first().total == 0


def test_one_scan(spark, tmp_path):
    """A request without other leaves reads no table of books or links: bitmaps only."""
    found = orders_catalog(spark, "/root/testdata/sf0.001")
    path = str(tmp_path / "bits")
    bm.bitmap_rows(found).write.parquet(path)
    words, conditions = bm.sets_of(found, spark.read.parquet(path), [LANGS, {"not": {"ids": "author", "values": [1]}}])
    plan = words.filter(conditions[0] != 0)._jdf.queryExecution().optimizedPlan().toString()
    assert "orders" not in plan and "lineitem" not in plan and plan.count("Relation [") == 3  # the universe and two leaves
