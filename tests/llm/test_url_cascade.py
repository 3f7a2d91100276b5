"""The cascade over universes far larger than the list, lists split in parts, and edge rows."""

import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import url_filter as uf


@pytest.mark.parametrize("one_in", [2, 500])
def test_exact_over_the_universe(spark, one_in):
    keys = spark.range(6000).selectExpr("concat('h', id) as key")
    chosen = F.pmod(F.xxhash64("key"), F.lit(one_in)) == 0
    levels = uf.build_cascade(keys.filter(chosen), keys)
    assert keys.filter(uf.in_cascade(F.col("key"), levels) != chosen).isEmpty()
    assert all(len(x.data) <= 16 + len(levels[0].data) for x in levels[1:])


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    fits = [(len(h + p), h + p, v) for h, p, v in uf.RULES if (lowered == h or lowered.endswith("." + h)) and path.startswith(p)]
    return lowered, path, max(fits) if fits else None


@pytest.mark.parametrize("max_bytes", [uf.MAX_LEVEL_BYTES, 8])
def test_rows(spark, max_bytes):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7?x=1#y", "x://example.com/en/8", "https://b.net/de/9", "https://example.net/de/8", "ftp://É.org/es/", "http://listed.it/a", "http://listed.it/a", "a://b://c/d", "http://h\nx/p", "http://q.io?u=http://listed.it/"]
    urls += [f"http://h{k}.it/p" for k in range(60)] + ["http://long.it/" + "x" * 200_000]
    pages = spark.createDataFrame([(k if k % 5 else None, u, "own") for k, u in enumerate(urls)], "page_id long, url string, verdict string")
    listed = spark.createDataFrame([("listed.it",), ("h7.it",), ("elsewhere.it",), (None,)] + [(f"h{k}.it",) for k in range(20, 60)], "key string")
    found = uf.filter_urls(pages, listed, keep=("page_id", "verdict"), max_level_bytes=max_bytes)
    assert found.columns == ["page_id", "host", "path", "rule", "verdict"]
    on_list, expected = {r.key for r in listed.collect()}, []
    for k, u in enumerate(urls):
        host, path, rule = plain(u)
        expected.append((str(k if k % 5 else None), host, path, rule and rule[1], rule[2] if rule else "block" if host in on_list else "allow"))
    assert sorted(map(str, [(str(r.page_id), *r[1:]) for r in found.collect()])) == sorted(map(str, expected))
    assert uf.filter_urls(pages.limit(0), listed, max_level_bytes=max_bytes).count() == 0


@pytest.mark.parametrize("max_bytes", [uf.MAX_LEVEL_BYTES, 64])
def test_listed_pages(spark, max_bytes):
    """Keys of host and path: the list comes from contents, and the page's other addresses and their neighbours stay."""
    junk = "a### b%%% c*** d$$$ " * 3
    rows = [(k, f"HTTP://Site{k % 7}.it/p/{k % 500}{'?q=1' if k % 2 else '#top'}", junk if k % 500 < 90 else "a###" if k % 3 else None) for k in range(1500)]
    rows += [(2000, None, junk), (2001, "no scheme", junk), (2002, "http://casino.it/fine", "plain"), (2003, "http://site1.it", None), (2004, "http://site1.it", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    listed = uf.junk_pages(pages)
    address = lambda u: "".join(plain(u)[:2])
    bad = {address(u) for _, u, h in rows if len(re.findall(uf.JUNK_RUN, h or "")) >= uf.JUNK_RUNS or "casino" in (u or "")} - {""}
    assert {r.key for r in listed.collect()} == bad and len(bad) > 200
    found = {r.page_id: r.verdict for r in uf.filter_urls(pages, listed, of="page", max_level_bytes=max_bytes).collect()}
    assert found == {i: "block" if address(u) in bad else "allow" for i, u, _ in rows}
    levels = uf.build_cascade(listed, pages.select(F.concat(*uf.url_parts(F.col("url"))).alias("key")))
    assert len(levels) > 1
    assert uf.junk_pages(pages.limit(0)).isEmpty()
