"""Catalog reports: summary, author list, languages, suggestions, book cards and neighbours in a series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.index import TextIndex
from tessera.operators.paging import relations
from tessera.operators.search_text import bm25
from tessera.sources.catalog import Catalog, author_name


def collection_summary(cat: Catalog, index_state: dict | None = None) -> DataFrame:
    """One row: visible books, all authors and series, languages (of deleted books too), plausible year bounds, annotated books, and the books, mark and time of the index, where its state is given."""
    sane = F.when(F.col("year").between(1400, 2200), F.col("year"))
    seen = ~F.col("deleted")
    books = cat.books.agg(F.sum(seen.cast("long")).alias("books"), F.count_distinct("lang").alias("languages"), F.min(F.when(seen, sane)).alias("year_from"), F.max(F.when(seen, sane)).alias("year_to"))
    one = lambda df, name: df.agg(F.count("*").alias(name))
    rows = books.crossJoin(one(cat.authors, "authors")).crossJoin(one(cat.series, "series")).crossJoin(one(cat.annotated, "annotations"))  # one row each
    return rows if index_state is None else rows.select("*", F.lit(index_state["books"]).alias("indexed_books"), F.lit(index_state["mark"]).alias("index_mark"), F.lit(index_state["indexed_at"]).alias("indexed_at"))


def author_list(cat: Catalog, text: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """Authors with a link whose surname holds the text or of whom any name part begins with it; prefixes of the surname first.

    Columns author_id, name, books (visible ones) and total, the number of authors found over all pages.
    """
    wanted = text.upper()
    last = F.upper(F.coalesce("last_name", F.lit("")))
    begins = F.exists(F.split(F.upper(author_name("list")), r"[^\p{L}\p{N}]+"), lambda x: x.startswith(wanted))
    seen = cat.author_links.join(cat.books.filter("not deleted").select("book_id"), "book_id", "left_semi").groupBy("author_id").agg(F.count("*").alias("books"))
    authors = cat.authors.filter(last.contains(wanted) | begins).join(cat.author_links, "author_id", "left_semi")
    found = authors.join(seen, "author_id", "left")
    rows = found.select("author_id", author_name("list").alias("name"), F.coalesce("books", F.lit(0)).alias("books"), F.when(last.startswith(wanted), 0).otherwise(1).alias("later"), last.alias("key"))
    ordered = rows.orderBy("later", "key", "author_id")
    count = authors.agg(F.count("*").alias("total"))
    return (ordered.offset(offset) if offset else ordered).limit(limit).select("author_id", "name", "books").crossJoin(count)  # one row


def languages(cat: Catalog) -> DataFrame:
    return cat.books.filter("not deleted and lang is not null").groupBy("lang").agg(F.count("*").alias("books")).orderBy(F.desc("books"), "lang")


def suggest(cat: Catalog, kind: str, prefix: str, limit: int = 10) -> DataFrame:
    """author, series or keyword: distinct visible books by prefix; title: by prefix of the title, no count. Top `limit`."""
    seen = cat.books.filter("not deleted")
    if kind == "title":
        return seen.filter(F.col("search_title").startswith(prefix.upper())).orderBy("search_title", "book_id").limit(limit).select("book_id", "title")
    named, links, key = {
        "author": (cat.authors.select("author_id", author_name("list").alias("label")), cat.author_links, "author_id"),
        "series": (cat.series.select("series_id", F.col("series_title").alias("label")), cat.series_links, "series_id"),
        "keyword": (cat.keyword_links.select("keyword_id", F.col("keyword_id").alias("label")).distinct(), cat.keyword_links, "keyword_id"),
    }[kind]
    hits = named.filter(F.upper("label").startswith(prefix.upper())).join(links, key).join(seen.select("book_id"), "book_id", "left_semi")
    return hits.groupBy(F.col(key).alias("id"), "label").agg(F.count_distinct("book_id").alias("books")).orderBy(F.desc("books"), "id").limit(limit)


def suggest_title(index: TextIndex, books: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """Titles from the index: visible books (book_id, title) with words that begin as those of prefix, best first; no count."""
    scored = bm25(index, prefix, "title", "prefix")
    return scored.join(books.select("book_id", "title"), "book_id").orderBy(F.desc(F.round("score", 6)), "book_id").limit(limit).select("book_id", "title")


def book_cards(cat: Catalog, ids: DataFrame | None = None) -> DataFrame:
    """Cards of the visible books, all or those of ids: fields, archive, first series, annotation, relations."""
    books = cat.books.filter("not deleted")
    books = books if ids is None else books.join(ids, "book_id", "left_semi")
    first = cat.series_links.groupBy("book_id").agg(F.min_by(F.struct("series_id", "seq"), F.struct("ord", "series_id")).alias("s")).select("book_id", "s.series_id", "s.seq").join(cat.series, "series_id")
    card = books.join(first, "book_id", "left").join(cat.annotated, "book_id", "left").join(relations(cat, books), "book_id", "left")
    return card.select("book_id", "title", "year", "lang", "size", "archive", F.concat(F.regexp_replace("ext", r"^\.", ""), F.lit("+zip")).alias("formats"), "file_name", "annotation", "series_title", F.col("seq").alias("seq_number"), "authors", "genres", "keywords")


def series_neighbours(cat: Catalog) -> DataFrame:
    """The books before and after each visible book in each of its series, by (position, id)."""
    seen = cat.series_links.join(cat.books.filter("not deleted").select("book_id"), "book_id", "left_semi")
    order = Window.partitionBy("series_id").orderBy("seq", "book_id")
    return seen.select("series_id", "book_id", "seq", F.lag("book_id").over(order).alias("previous"), F.lead("book_id").over(order).alias("following"))
