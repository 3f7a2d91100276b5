"""What near-dedup costs beside its rows: files of narrow tables, and rounds of components, where Spark joins no partitions."""

import random
from pathlib import Path

import pytest

from tessera.llm import components as cc
from tessera.llm import dedup, runtime


@pytest.fixture
def many_partitions(spark):
    put = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in put}
    for k, v in put.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def roots(links):
    parent = {x: x for link in links for x in link}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    return {x: root(x) for x in parent}


def test_narrow_tables_have_few_files(many_partitions):
    spark, rng = many_partitions, random.Random(6)
    links = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(2500)]
    shared = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    before = set(shared.iterdir())
    found = {r.node: r.component for r in cc.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert found == {x: y for x, y in roots(links).items() if x != y}
    files = [len(list(table.glob("part-*"))) for new in set(shared.iterdir()) - before for table in new.iterdir()]
    assert len(files) > 4
    assert max(files) <= max(runtime.NARROW_LEAST, runtime.NARROW_FILES * spark.sparkContext.defaultParallelism) < 40


def test_stars_connect_the_same():
    rng = random.Random(7)
    for n in (1, 5, 60, 400):
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(n)]
        got = dedup.stars(links)
        assert roots([*got, *((x, x) for link in links for x in link)]) == roots(links)
        assert len(got) <= len({x for link in links for x in link}) and {b for _, b in got}.isdisjoint(a for a, _ in got)
    chain = [(k + 1, k) for k in range(50_000)]
    assert dedup.stars(chain) == [(k, 0) for k in range(1, 50_001)]
    assert dedup.stars([]) == []
