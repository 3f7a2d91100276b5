"""URL filters: host and path rules, and a Bloom filter cascade for exact membership of listed hosts or pages, without joins.

A cascade encodes the listed keys in its first level, the false positives of that level in the second, the listed keys
that the second level wrongly takes in the third, and so on until a level has no false positive. Over the key universe
it was built from, a lookup is exact. The first level has so many hash functions that it takes fewer wrong keys than there
are listed ones, however large the universe is, so that all levels are bounded by the list. A longer list than one task
should carry is split by a hash of the key: each part has its own cascade, and the urls of each part are judged by it.

Null urls and urls without `://` have empty host and path and are looked up as ''. Repeated rows are judged each; an empty
table gives none; of equally long rules that fit the last by host and path counts (the contract's have no such tie). Very
long urls are read whole. Input columns of a result's name are replaced where they are to be kept. A list made from contents
(`junk_pages`) reads each page's html once; null contents list nothing, and an empty address is never listed.
"""

from __future__ import annotations

import math
import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import cut, new_folder

#: The rules of the contract, as (host, path prefix, verdict).
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: Words that mark a host of the default block list, as a whole part between dots and hyphens.
LISTED_WORDS = ("adult", "bet", "bets", "casino", "porn", "spam", "xxx")
#: Symbol runs of junk, and how many of them mark a page's content as junk.
JUNK_RUN, JUNK_RUNS = r"###|%%%|\*\*\*|\$\$\$", 10
#: Hash functions of a level at least, and of the first at most; bits for each key and hash function.
HASHES, MOST_HASHES, BITS = 3, 30, 1.4427
#: Bytes of a level that travel in a plan; a list that needs more is split.
MAX_LEVEL_BYTES = 4 << 20


class Level(NamedTuple):
    seed: int
    hashes: int
    bits: int
    data: bytes


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both '' for null or where `://` is missing."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null where none fits."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is tried first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _positions(key: Column, level: Level) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level.seed * MOST_HASHES + j)), F.lit(level.bits).cast("long")) for j in range(level.hashes)]


def _level(keys: DataFrame, level: Level) -> Level:
    """One Bloom filter, built by bitmap aggregation on the executors; the driver receives its bits only."""
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), level))).alias("at")).select((F.col("at") + 1).alias("at"))
    parts = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    data = bytearray(-(-level.bits // 32768) * 4096)
    for row in parts.toLocalIterator():
        data[(row.bucket - 1) * 4096 : row.bucket * 4096] = row.bits
    return level._replace(data=bytes(data[: level.bits // 8]))


def level_test(key: Column, level: Level) -> Column:
    """True where all bits of the key are set."""

    def all_set(data: Column) -> Column:
        hit = F.lit(True)
        for at in _positions(key, level):
            byte = F.conv(F.hex(F.substring(data, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            hit = hit & (F.lit(1) == F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)))
        return hit

    return F.transform(F.array(F.lit(bytearray(level.data))), all_set)[0]  # bound once: one copy of the bits in the plan


def _hashes(listed: int, others: int) -> int:
    """Of the first level: enough that it wrongly takes about half as many keys as are listed."""
    return min(MOST_HASHES, max(HASHES, math.ceil(math.log2(2 * max(1, others) / max(1, listed)))))


def build_cascade(listed: DataFrame, universe: DataFrame, max_levels: int = 40) -> list[Level]:
    """Levels over two frames with a column key. Null keys are ignored. Listed keys outside the universe are encoded too."""
    wanted = cut(listed.select("key").dropna().distinct(), "listed")
    others = cut(universe.select("key").dropna().distinct().join(wanted, "key", "left_anti"), "others")
    levels: list[Level] = []
    while len(levels) < max_levels:
        count = wanted.count()
        if levels and not count:
            return levels
        hashes = HASHES if levels else _hashes(count, others.count())
        bits = max(64, math.ceil(count * hashes * BITS / 8) * 8)
        levels.append(_level(wanted, Level(len(levels), hashes, bits, b"")))
        taken = cut(others.filter(level_test(F.col("key"), levels[-1])), f"taken{len(levels)}")
        wanted, others = taken, wanted
    raise RuntimeError("the cascade did not end; raise BITS")


def in_cascade(key: Column, levels: list[Level]) -> Column:
    """Exact membership in the listed keys, for keys of the universe."""
    member = F.lit(len(levels) % 2 == 1)
    for depth in range(len(levels) - 1, -1, -1):  # the first level that refuses a key decides
        member = F.when(~level_test(key, levels[depth]), F.lit(depth % 2 == 1)).otherwise(member)
    return F.coalesce(member, F.lit(False))


def bad_host(host: Column) -> Column:
    """Whether a host holds one of LISTED_WORDS."""
    return host.rlike(r"(^|[.\-])(" + "|".join(LISTED_WORDS) + r")($|[.\-])")


def junk_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """key (host and path): addresses on a bad host, or with a page whose content is junk. Null contents aren't; pages without an address are left out."""
    host, path = url_parts(F.col(url))
    junk = F.coalesce(F.regexp_count(html, F.lit(JUNK_RUN)) >= JUNK_RUNS, F.lit(False))
    return pages.filter(bad_host(host) | junk).select(F.concat(host, path).alias("key")).filter("key <> ''").distinct()


def filter_urls(pages: DataFrame, listed: DataFrame | None = None, url: str = "url", keep: tuple[str, ...] = ("page_id",), rules=RULES, max_level_bytes: int = MAX_LEVEL_BYTES, of: str = "host") -> DataFrame:
    """keep, host, path, rule and verdict for each row. listed: keys to block, column key; by default the bad hosts.

    of: what a key is, the host, or the page (host and path together, without what follows the path).
    """
    keep = tuple(k for k in keep if k not in ("host", "path", "rule", "verdict"))
    host, path = url_parts(F.col(url))
    parts = pages.select(*keep, host.alias("host"), path.alias("path"))
    key = F.concat("host", "path") if of == "page" else F.col("host")
    keys = cut(parts.select(key.alias("key")).distinct(), "keys")
    if listed is None:
        listed = keys.filter(bad_host(F.regexp_extract("key", "^[^/]*", 0)))
    listed = cut(listed.select("key").dropna().distinct(), "listed")
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)

    def judged(rows: DataFrame, levels: list[Level]) -> DataFrame:
        return rows.select(*keep, "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(in_cascade(key, levels), "block").otherwise("allow")).alias("verdict"))

    n_listed = listed.count()
    need = n_listed * _hashes(n_listed, keys.count()) * BITS / 8
    splits = math.ceil(need / max_level_bytes)
    if splits <= 1:
        return judged(parts, build_cascade(listed, keys))

    def split_of(of_key: Column) -> Column:
        return F.pmod(F.xxhash64(of_key, F.lit(-1)), F.lit(splits))

    dealt, out = new_folder(pages.sparkSession, "dealt"), new_folder(pages.sparkSession, "judged")
    marked = parts.withColumn("split_", split_of(key).cast("int"))
    marked.write.partitionBy("split_").parquet(dealt)
    written = pages.sparkSession.read.schema(marked.schema).parquet(dealt)
    for k in range(splits):  # each plan carries the levels of one part of the list
        levels = build_cascade(listed.filter(split_of(F.col("key")) == k), keys.filter(split_of(F.col("key")) == k))
        part = judged(written.filter(F.col("split_") == k), levels)
        part.write.mode("append").parquet(out)
    return pages.sparkSession.read.schema(part.schema).parquet(out)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(pages, junk_pages(pages), of="page")


ORACLE_SQL = rf"""
with r as (select page_id, html, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, html, lower(regexp_extract(coalesce(rest, ''), '^[^/?#]*')) as host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from r),
u as (select *, case
   when (host = 'example.com' or suffix(host, '.example.com')) and starts_with(path, '/en/7') then 'example.com/en/7'
   when (host = 'example.net' or suffix(host, '.example.net')) and starts_with(path, '/de/8') then 'example.net/de/8'
   when (host = 'com' or suffix(host, '.com')) and starts_with(path, '/en/') then 'com/en/'
   when (host = 'net' or suffix(host, '.net')) and starts_with(path, '/de/') then 'net/de/'
   when (host = 'org' or suffix(host, '.org')) and starts_with(path, '/es/') then 'org/es/' end as rule from p),
b as (select distinct host || path as key from p where regexp_matches(host, '(^|[.\-])({"|".join(LISTED_WORDS)})($|[.\-])') or len(regexp_extract_all(html, '{JUNK_RUN}')) >= {JUNK_RUNS})
select page_id, host, path, rule, case
   when rule in ('example.com/en/7', 'net/de/') then 'allow' when rule is not null then 'block'
   when host || path <> '' and host || path in (select key from b) then 'block' else 'allow' end as verdict from u
"""
