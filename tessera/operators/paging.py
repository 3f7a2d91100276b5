"""Sort keys, keyset and offset pages, page rows with their relations, and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.catalog import Catalog, author_name
from tessera.sources.storage import written

#: Offset from which a page is sought by ranges of the key, and not by one sort of all that comes before it.
DEEP_OFFSET = 2000
_COLUMN_KEYS = {"title": ("search_title", ""), "year": ("year", 0), "lib_rate": ("lib_rate", 0), "size": ("size", 0), "added_at": ("update_id", 0)}


def with_sort_key(cat: Catalog, matched: DataFrame, key: str, user: int = 1) -> DataFrame:
    """matched with sort_key, never null. author and series: the name at the first position; seq: the smallest."""
    if key in _COLUMN_KEYS:
        column, missing = _COLUMN_KEYS[key]
        return matched.withColumn("sort_key", F.coalesce(F.col(column), F.lit(missing)))
    if key == "user_rate":
        side, missing = cat.user_data.filter(F.col("user_id") == user).select("book_id", F.col("rate").alias("k")), 0
    elif key == "seq":
        side, missing = cat.series_links.groupBy("book_id").agg(F.min("seq").alias("k")), 0
    elif key == "author":
        named = cat.author_links.join(cat.authors, "author_id")
        side, missing = named.groupBy("book_id").agg(F.min_by(F.upper("last_name"), F.struct("ord", "author_id")).alias("k")), ""
    elif key == "series":
        named = cat.series_links.join(cat.series, "series_id")
        side, missing = named.groupBy("book_id").agg(F.min_by(F.upper("series_title"), F.struct("ord", "series_id")).alias("k")), ""
    else:
        raise ValueError(f"unknown sort key {key}")
    return matched.join(side, "book_id", "left").withColumn("sort_key", F.coalesce("k", F.lit(missing))).drop("k")


def _order(descending: bool) -> list[Column]:
    return [F.desc("sort_key"), F.desc("book_id")] if descending else [F.asc("sort_key"), F.asc("book_id")]


def page(keyed: DataFrame, limit: int = 50, descending: bool = False, after: tuple | None = None, offset: int = 0) -> DataFrame:
    """A page by (sort_key, book_id), both in one direction; after: the (key, id) of the last row seen. limit: 1 to 200."""
    limit, offset = max(1, min(limit, 200)), min(offset, 5_000_000)
    if after is not None:
        key, last = F.lit(after[0]), F.lit(after[1])
        k, i = F.col("sort_key"), F.col("book_id")
        keyed = keyed.filter((k <= key) & ((k < key) | (i < last)) if descending else (k >= key) & ((k > key) | (i > last)))
    if offset >= DEEP_OFFSET:
        return _deep_page(keyed, limit, descending, offset)
    ordered = keyed.orderBy(*_order(descending))
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def _deep_page(keyed: DataFrame, limit: int, descending: bool, offset: int) -> DataFrame:
    """A page far behind: keys are dealt in ranges and written, the ranges' sizes tell which of them hold the page, and only
    those are sorted. The other columns are joined to the rows of the page."""
    ranges = keyed.select("sort_key", "book_id").repartitionByRange(*_order(descending)).withColumn("part", F.spark_partition_id())
    keys = written(ranges, "keys")
    held, before, skipped = [], 0, 0
    for part, n in sorted((r.part, r.n) for r in keys.groupBy("part").agg(F.count("*").alias("n")).collect()):  # a row for each range
        if before + n <= offset:
            skipped = before + n
        elif before < offset + limit:
            held.append(part)
        before += n
    rows = keys.filter(F.col("part").isin(held)).orderBy(*_order(descending)).offset(offset - skipped).limit(limit).select("book_id")
    return keyed.join(F.broadcast(written(rows, "page")), "book_id", "left_semi").orderBy(*_order(descending))  # 200 rows at most


def page_rows(cat: Catalog, rows: DataFrame, user: int = 1) -> DataFrame:
    """The page columns: of the book, of its primary series (least position; one row for each book) and of the user."""
    primary = cat.series_links.filter("ord = 0").join(rows.select("book_id"), "book_id", "left_semi").groupBy("book_id").agg(F.min_by(F.struct("series_id", "seq"), F.col("series_id")).alias("s"))
    primary = primary.select("book_id", "s.series_id", "s.seq").join(cat.series, "series_id")
    mine = cat.user_data.filter(F.col("user_id") == user).select("book_id", F.col("rate").alias("user_rate"), (F.col("favorite") == 1).alias("favorite"), (F.col("read") == 1).alias("is_read"))
    joined = rows.join(primary, "book_id", "left").join(mine, "book_id", "left")
    return joined.select(
        "book_id", "title", "year", "lang", F.regexp_replace("ext", r"^\.", "").alias("ext"), "size", "lib_rate", "series_id", "series_title", F.col("seq").alias("seq_number"), "sort_key",
        F.coalesce("user_rate", F.lit(0)).alias("user_rate"), F.coalesce("favorite", F.lit(False)).alias("favorite"), F.coalesce("is_read", F.lit(False)).alias("is_read"),
    )


def relations(cat: Catalog, rows: DataFrame) -> DataFrame:
    """book_id with its authors, genres and keywords in link order, each an array of (id, label), null where there is none.

    rows: a written page or a frame of books. Only links of these rows meet their dictionaries.
    """
    ids = rows.select("book_id")

    def ordered(links: DataFrame, dictionary: DataFrame | None, key: str, label: Column, name: str) -> DataFrame:
        of_page = links.join(ids, "book_id", "left_semi")
        named = of_page.join(dictionary, key) if dictionary is not None else of_page.filter(F.col(key).isNotNull())
        items = named.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.col(key).alias("id"), label.alias("label")))).alias("items"))
        return items.select("book_id", F.transform("items", lambda x: F.struct(x["id"].alias("id"), x["label"].alias("label"))).alias(name))

    authors = ordered(cat.author_links, cat.authors, "author_id", author_name(), "authors")
    genres = ordered(cat.genre_links, cat.genres.select("genre_code", "title"), "genre_code", F.col("title"), "genres")
    keywords = ordered(cat.keyword_links, None, "keyword_id", F.col("keyword_id"), "keywords")
    return ids.join(authors, "book_id", "left").join(genres, "book_id", "left").join(keywords, "book_id", "left")


def page_response(cat: Catalog, matched: DataFrame, key: str, user: int = 1, with_total: bool = False, with_next: bool = False, limit: int = 50, descending: bool = False, **paging) -> DataFrame:
    """The rows of a page with their relations, and on request the total, and next_key and next_id: after which row the next
    page begins. The page itself is found once, and written (200 rows at most)."""
    keyed = with_sort_key(cat, matched, key, user)
    rows = F.broadcast(written(page(keyed, limit=limit, descending=descending, **paging), "page"))
    out = page_rows(cat, rows, user).join(relations(cat, rows), "book_id", "left")
    out = out.crossJoin(next_key(rows, limit, descending)) if with_next else out  # one row
    return out.crossJoin(total(matched)) if with_total else out  # one row


def next_key(rows: DataFrame, limit: int, descending: bool = False) -> DataFrame:
    """One row, next_key and next_id: of the last row of a full page, else null. rows: a page, 200 at most."""
    key = F.struct("sort_key", "book_id")
    last = rows.agg(F.count("*").alias("n"), (F.min(key) if descending else F.max(key)).alias("last"))
    full = F.col("n") == max(1, min(limit, 200))
    return last.select(F.when(full, F.col("last.sort_key")).alias("next_key"), F.when(full, F.col("last.book_id")).alias("next_id"))


def total(matched: DataFrame) -> DataFrame:
    return matched.agg(F.count("*").alias("total"))
