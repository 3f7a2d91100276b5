"""Catalog roles bound to tables: items, their links, dictionaries, a category tree and user data.

Bindings are lazy frames over explicit columns; links are unique for each (book, key) and carry their position.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.storage import kept


@dataclass
class Catalog:
    """One frame for each role. books: book_id, title, search_title, year, size, lib_rate, lang, ext, file_name, archive, deleted, update_id, source_rate."""

    books: DataFrame
    author_links: DataFrame  # book_id, author_id, ord
    authors: DataFrame  # author_id, last_name, first_name, middle_name
    series_links: DataFrame  # book_id, series_id, seq, ord
    series: DataFrame  # series_id, series_title
    keyword_links: DataFrame  # book_id, keyword_id, ord
    genre_links: DataFrame  # book_id, genre_code, ord
    genres: DataFrame  # genre_code, parent_code, title (its label), deleted
    user_data: DataFrame  # user_id, book_id, favorite, read, rate
    groups: DataFrame  # group_id, object_id (text: of any kind)
    reviewed: DataFrame  # book_id
    annotated: DataFrame  # book_id, annotation
    members: DataFrame | None = None  # group_id, book_id: the groups resolved
    below: DataFrame | None = None  # root, code, depth: the closure of genres
    resolve: Callable[[], DataFrame] | None = None  # how members are had where they are first asked for


#: Columns that the bindings need of each table.
NEEDED = {
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority", "customer": "c_custkey c_nationkey c_mktsegment",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_returnflag", "part": "p_partkey p_name p_brand p_type p_size", "supplier": "s_suppkey s_name",
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text", "pages": "page_id html", "conversations": "conv_id turn role text", "benchmark": "item_id text",
}


#: Columns of NEEDED that must be whole numbers; the names of dates and amounts end as given. All others are texts or taken as they are.
_WHOLE = ("key", "_id", "linenumber", "_size", "turn")


def _wrong_types(found: DataFrame, names: list[str]) -> list[str]:
    types = dict(found.dtypes)
    whole = [c for c in names if c.endswith(_WHOLE) and types[c] not in ("tinyint", "smallint", "int", "bigint")]
    dates = [c for c in names if c.endswith("date") and types[c] not in ("date", "timestamp", "timestamp_ntz")]
    texts = [c for c in names if c.endswith(("name", "text", "html", "role", "props", "_type", "status", "priority", "segment", "flag", "brand")) and types[c] != "string"]
    return [f"{c} is {types[c]}" for c in whole + dates + texts]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with the columns that the bindings need, and others; a missing one, or one of another kind, is an error here."""
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if missing := set(NEEDED.get(name, "").split()) - set(found.columns):
        raise ValueError(f"{name} lacks {', '.join(sorted(missing))}")
    if wrong := _wrong_types(found, NEEDED.get(name, "").split()):
        raise ValueError(f"{name}: {', '.join(wrong)}")
    return found


def effective(books: DataFrame, overrides: DataFrame) -> DataFrame:
    """books as the user sees them: an override's deleted flag wins where it is set, its rate is user_rate, and the file's name has its extension.

    books has base_name; overrides one row for each book at most: book_id, deleted, rate.
    """
    given = overrides.select("book_id", F.col("deleted").alias("deleted_"), F.col("rate").alias("source_rate"))
    joined = books.join(given, "book_id", "left").withColumn("deleted", F.coalesce("deleted_", "deleted"))
    return joined.withColumn("file_name", F.concat("base_name", "ext")).drop("deleted_")


def genre_label(title, alias, code):
    """The first of title and alias that isn't blank, else the code."""
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(alias, F.lit("")), code)


def _positions(links: DataFrame, key: str) -> DataFrame:
    """Unique links with ord = rank by (smallest line, key) - 1."""
    once = links.groupBy("book_id", key).agg(F.min("line").alias("seq"))
    return once.withColumn("ord", F.row_number().over(Window.partitionBy("book_id").orderBy("seq", key)) - 1)


def orders_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """Orders as items, parts as authors, suppliers as series, part types as keywords, nations under regions as genres."""
    t = lambda name: table(spark, sf_dir, name)
    title = F.concat_ws(" ", "o_orderpriority", F.col("o_orderkey").cast("string"))
    customers = t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey")
    orders = t("orders").join(customers, "o_custkey", "left")
    books = orders.select(
        F.col("o_orderkey").alias("book_id"), title.alias("title"), F.upper(title).alias("search_title"),
        F.year("o_orderdate").alias("year"), F.floor("o_totalprice").cast("long").alias("size"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("lib_rate"), F.col("o_orderpriority").alias("lang"),
        F.concat(F.lit("."), F.lower("o_orderstatus")).alias("ext"), F.col("c_mktsegment").alias("archive"),
        F.concat(F.lit("b"), F.col("o_orderkey").cast("string")).alias("base_name"),
        (F.col("o_orderstatus") == "P").alias("deleted"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("update_id"),
    )
    lines = t("lineitem").select(F.col("l_orderkey").alias("book_id"), "l_partkey", "l_suppkey", F.col("l_linenumber").alias("line"), "l_returnflag")
    parts = F.split("p_name", " ")
    types = t("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("keyword_id"))
    events = t("events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("book_id"), "event_type", "value", "ts", "event_id")
    overrides = events.filter("event_type = 'error' and book_id is not null").groupBy("book_id").agg(
        F.max_by(F.col("value") >= 50, F.struct("ts", "event_id")).alias("deleted"), (F.count("*") % 5 + 1).alias("rate"))
    number = F.col("n_nationkey")
    genres = t("region").select(F.concat(F.lit("R"), "r_regionkey").alias("genre_code"), F.lit("").alias("parent_code"), F.col("r_name").alias("title"), F.lit(False).alias("deleted")).unionByName(
        t("nation").select(
            F.concat(F.lit("N"), "n_nationkey").alias("genre_code"), F.concat(F.lit("R"), "n_regionkey").alias("parent_code"),
            genre_label(F.when(number % 3 > 0, F.col("n_name")).otherwise(""), F.when(number % 2 > 0, F.lower("n_name")), F.concat(F.lit("N"), number)).alias("title"), (number == 17).alias("deleted"))
    )
    return Catalog(
        books=effective(books, overrides),
        author_links=_positions(lines.select("book_id", F.col("l_partkey").alias("author_id"), "line"), "author_id").select("book_id", "author_id", "ord"),
        authors=t("part").select(F.col("p_partkey").alias("author_id"), F.get(parts, 1).alias("last_name"), F.get(parts, 0).alias("first_name"), F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).alias("middle_name")),
        series_links=_positions(lines.select("book_id", F.col("l_suppkey").alias("series_id"), "line"), "series_id").select("book_id", "series_id", "seq", "ord"),
        series=t("supplier").select(F.col("s_suppkey").alias("series_id"), F.col("s_name").alias("series_title")),
        keyword_links=_positions(lines.join(types, "l_partkey").select("book_id", "keyword_id", "line"), "keyword_id").select("book_id", "keyword_id", "ord"),
        genre_links=orders.filter(F.col("c_nationkey").isNotNull()).select(F.col("o_orderkey").alias("book_id"), F.concat(F.lit("N"), "c_nationkey").alias("genre_code"), F.lit(0).alias("ord")),
        genres=genres,
        user_data=events.filter("book_id is not null").groupBy("user_id", "book_id").agg(F.max((F.col("event_type") == "purchase").cast("int")).alias("favorite"), F.max((F.col("event_type") == "view").cast("int")).alias("read"), (F.max_by(F.floor("value"), F.struct("ts", "event_id")).cast("long") % 5 + 1).alias("rate")),
        groups=t("nation").select(F.col("n_regionkey").cast("long").alias("group_id"), F.col("n_nationkey").cast("string").alias("object_id")).unionByName(t("part").select((F.length("p_type") % 5).cast("long").alias("group_id"), F.col("p_type").alias("object_id")).distinct()),
        reviewed=lines.filter("l_returnflag = 'R'").select("book_id").distinct(),
        annotated=lines.groupBy("book_id").count().filter("count > 3").select("book_id", F.concat(F.lit("a book of "), F.col("count").cast("string"), F.lit(" lines")).alias("annotation")),
    )


#: The tables of a stored catalog that are dealt in ranges, so that a filter on their first column prunes.
RANGED = {"user_data": ["user_id", "book_id"], "members": ["group_id", "book_id"]}


def stored(spark: SparkSession, bind: Callable[[], Catalog], paths: list[str]) -> Catalog:
    """A catalog as written tables: overrides applied, links placed, once for each state of the files at paths; groups are
    resolved, from the written links, when a query first asks for them."""

    def frames() -> dict[str, tuple[DataFrame, list[str]]]:
        cat = bind()
        tables = {f.name: getattr(cat, f.name) for f in fields(cat) if f.name not in ("members", "resolve")}
        return {name: (df, RANGED.get(name, [])) for name, df in tables.items() if df is not None}

    cat = Catalog(**kept(spark, "catalog-tables", frames, paths))
    bare = replace(cat)
    cat.resolve = lambda: kept(spark, "catalog-members", lambda: {"members": (group_members(bare), RANGED["members"])}, paths)["members"]
    return cat


def group_members(cat: Catalog) -> DataFrame:
    """group_id, book_id: a group's objects are books, authors, series or keywords at once (ids carry no kind)."""
    if cat.members is None and cat.resolve is not None:
        cat.members = cat.resolve()
    if cat.members is not None:
        return cat.members
    kinds = (cat.books.select(F.col("book_id").alias("id"), "book_id"), *(links.select(F.col(key).alias("id"), "book_id") for links, key in ((cat.author_links, "author_id"), (cat.series_links, "series_id"), (cat.keyword_links, "keyword_id"))))
    each = (cat.groups.join(k.select(F.col("id").cast("string").alias("object_id"), "book_id"), "object_id").select("group_id", "book_id") for k in kinds)
    return reduce(DataFrame.unionByName, each).distinct()


#: Names that stand for no author.
UNKNOWN_NAMES = ("unknown", "unknown author", "unknown authors")


def author_name(style: str = "page"):
    """page: parts joined, blanks skipped; facet: parts concatenated and trimmed, no surname no name; list: as facet, blank surname. All name the unknown author."""
    parts = [F.col(c) for c in ("last_name", "first_name", "middle_name")]
    if style == "page":
        name = F.concat_ws(" ", *(F.when(F.trim(p) != "", p) for p in parts))
    else:
        last = parts[0] if style == "facet" else F.coalesce(parts[0], F.lit(""))
        name = F.trim(F.concat(last, F.lit(" "), F.coalesce(parts[1], F.lit("")), F.lit(" "), F.coalesce(parts[2], F.lit(""))))
    blank = (F.trim(F.coalesce(name, F.lit(""))) == "") | F.lower(F.trim(name)).isin(*UNKNOWN_NAMES)
    return F.when(blank, F.lit("Unknown author")).otherwise(F.trim(name))
