"""Book files and reviews as jobs: files by name, metadata of FB2 files, and normalised review lists."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tessera.functions.text import strip_tags, volume

#: A tag may have any namespace prefix; its letters may be of either case.
_TAG = r"(?:\w+:)?"


def _decoded(data: bytes | None) -> str:
    """Text by the charset of the XML declaration; UTF-8 where it is unknown."""
    data = data or b""
    named = re.search(rb"""encoding\s*=\s*["']([\w-]+)["']""", data[:256], re.IGNORECASE)
    try:
        return data.decode(named[1].decode() if named else "utf-8", "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


@F.pandas_udf(StringType())
def decode_file(data: pd.Series) -> pd.Series:
    return data.map(_decoded)


def _file(part: int) -> Column:
    """The folder (1) or the name (2) of the file that a row comes from."""
    return F.url_decode(F.regexp_replace(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)/([^/]*)$", part), r"\+", "%2B"))


def read_book_files(spark: SparkSession, folder: str, books: DataFrame) -> DataFrame:
    """book_id and content of the files below folder whose names are those of books (book_id, file_name)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(_file(2).alias("file_name"), "content").join(books.select("book_id", "file_name"), "file_name").select("book_id", "content")


def read_reviews(spark: SparkSession, folder: str, books: DataFrame) -> DataFrame:
    """book_id, name, time, text and place of all reviews below folder: a file's locator is its folder's title, #, and its name.

    books: book_id, archive (the folder's title), file_name. Files that no book names are left out; books without one have no row.
    """
    files = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True).select(F.concat(_file(1), F.lit("#"), _file(2)).alias("locator"), F.col("value").alias("data"))
    located = books.select("book_id", F.concat("archive", F.lit("#"), "file_name").alias("locator"))
    return normalise_reviews(files.join(located, "locator"), "book_id", "data")


def _inner(xml: Column, tag: str) -> Column:
    """What the first element of a name holds, any namespace prefix, in any case; null where there is none."""
    return F.nullif(F.regexp_extract(xml, rf"(?si)<{_TAG}{tag}(?:\s[^>]*)?>(.*?)</{_TAG}{tag}\s*>", 1), F.lit(""))


def _all(xml: Column, tag: str) -> Column:
    return F.regexp_extract_all(F.coalesce(xml, F.lit("")), F.lit(rf"(?si)<{_TAG}{tag}(?:\s[^>]*)?>(.*?)</{_TAG}{tag}\s*>"), F.lit(1))


def _text(xml: Column) -> Column:
    return F.nullif(strip_tags(xml), F.lit(""))


def _person(xml: Column) -> Column:
    parts = F.array_join(F.filter(F.array(*(_text(_inner(xml, t)) for t in ("last-name", "first-name", "middle-name"))), lambda x: x.isNotNull()), " ")
    return F.coalesce(F.nullif(parts, F.lit("")), _text(_inner(xml, "nickname")))


_SECTION = re.compile(rf"<(/?){_TAG}section(?:\s[^>]*?)?(/?)>", re.IGNORECASE | re.ASCII)
_NESTED = re.compile(rf"<{_TAG}section[\s>]", re.IGNORECASE | re.ASCII)
_TITLE = re.compile(rf"<{_TAG}title(?:\s[^>]*)?>(.*?)</{_TAG}title\s*>", re.IGNORECASE | re.ASCII | re.DOTALL)


def _chapters(bodies: pd.Series) -> pd.Series:
    """What the titles of the outermost sections hold, in order: a section's is its first title before its first nested section.

    A scan over section tags, so broken files stay readable.
    """

    def titles(body: str | None) -> list[str]:
        depth, found, body = 0, [], body or ""
        for m in _SECTION.finditer(body):
            if m[1]:
                depth -= 1
            elif not m[2]:
                if depth == 0:
                    nested = _NESTED.search(body, m.end())
                    title = _TITLE.search(body, m.end(), nested.start() if nested else len(body))
                    found += [title[1]] if title else []
                depth += 1
        return found

    return bodies.map(titles)


chapters = F.pandas_udf(_chapters, ArrayType(StringType()))


def book_metadata(files: DataFrame, key: str = "book_id", data: str = "content") -> DataFrame:
    """key, annotation, publisher, publish_year, publish_city, isbn, src_lang, translators, chapters, letters, words, pages."""
    xml = files.select(key, decode_file(data).alias("xml"))
    parts = xml.select(key, "xml", _inner(F.col("xml"), "title-info").alias("ti"), _inner(F.col("xml"), "publish-info").alias("pi"), F.coalesce(_inner(F.col("xml"), "body"), F.lit("")).alias("body"))
    note = _inner(F.col("ti"), "annotation")
    lines = F.array_join(F.filter(F.transform(_all(note, "p"), strip_tags), lambda x: x != ""), "\n")
    year = _text(_inner(F.col("pi"), "year"))
    plain = parts.select(
        key, F.when(note.isNotNull(), F.coalesce(F.nullif(lines, F.lit("")), _text(note))).alias("annotation"), _text(_inner(F.col("pi"), "publisher")).alias("publisher"),
        F.when(year.rlike(r"^\d{3,4}$"), year.cast("int")).alias("publish_year"), _text(_inner(F.col("pi"), "city")).alias("publish_city"), _text(_inner(F.col("pi"), "isbn")).alias("isbn"),
        _text(_inner(F.col("ti"), "src-lang")).alias("src_lang"), F.filter(F.transform(_all(F.col("ti"), "translator"), _person), lambda x: x.isNotNull()).alias("translators"),
        F.filter(F.transform(chapters("body"), strip_tags), lambda x: x != "").alias("chapters"), strip_tags(F.col("body")).alias("plain"),
    )
    return plain.select("*", *volume(F.col("plain"))).drop("plain")


#: The keys that review files use, in order of preference, and the name of an unsigned review.
REVIEW_KEYS = {"name": ("name", "nick", "nickname", "user", "author"), "time": ("time", "date", "datetime"), "text": ("text", "body", "review")}
ANONYMOUS = "Аноним"


def normalise_reviews(files: DataFrame, key: str, data: str) -> DataFrame:
    """key, name, time, text and place (from 1, by time) for each review with a text; bad JSON has none."""
    items = F.from_json(data, "array<map<string,string>>")
    rows = files.select(key, F.posexplode(items).alias("at", "item")).filter("item is not null").select(key, "at", F.map_from_entries(F.array_distinct(F.transform(F.map_entries("item"), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))).alias("item"))

    def pick(name: str) -> Column:
        return F.coalesce(*(F.nullif(F.element_at("item", k), F.lit("")) for k in REVIEW_KEYS[name]), F.lit(ANONYMOUS if name == "name" else ""))

    text = F.regexp_replace(F.regexp_replace(pick("text"), r"(?i)<br\s*/?>", "\n"), r"^\s+|\s+$", "")
    picked = rows.select(key, "at", pick("name").alias("name"), pick("time").alias("time"), text.alias("text")).filter("text <> ''")
    ordered = picked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("time", "at", "name", "text"))).alias("all"))
    return ordered.select(key, F.posexplode("all").alias("i", "r")).select(key, "r.name", "r.time", "r.text", (F.col("i") + 1).alias("place"))
