"""Pages far behind: by ranges of the key, with ties, both directions, ends and empty pages; next keys of full and short pages."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import paging as pg


@pytest.mark.parametrize("descending", [False, True])
def test_deep_pages_equal_sorted_rows(spark, monkeypatch, descending):
    keyed = spark.range(500).select(F.col("id").alias("book_id"), (F.col("id") % 7).alias("sort_key"), F.lit("t").alias("title")).repartition(6)
    wanted = sorted(((k % 7, k) for k in range(500)), reverse=descending)
    monkeypatch.setattr(pg, "DEEP_OFFSET", 1)
    for offset in (1, 71, 250, 480, 499, 500, 900):
        found = [(r.sort_key, r.book_id) for r in pg.page(keyed, limit=40, descending=descending, offset=offset).collect()]
        assert found == wanted[offset : offset + 40]
    after = wanted[99]
    assert [(r.sort_key, r.book_id) for r in pg.page(keyed, limit=5, descending=descending, after=after, offset=20).collect()] == wanted[120:125]


def test_next_keys(spark):
    rows = spark.createDataFrame([(3, "b"), (1, "a"), (2, "b")], "book_id long, sort_key string")
    assert tuple(pg.next_key(rows, 3).first()) == ("b", 3) and tuple(pg.next_key(rows, 3, descending=True).first()) == ("a", 1)
    assert tuple(pg.next_key(rows, 4).first()) == (None, None) and tuple(pg.next_key(rows.limit(0), 4).first()) == (None, None)
