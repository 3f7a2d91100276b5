"""Facet counts from bitmaps: an index of the books of each value, in words of 64 books, counted by AND and population count.

Books are numbered by their ids: word = id div 64, bit = id mod 64. The index holds a row (field, value, word, bits) for each
word with a book of the value, so common values take a 64th of their links and rare ones no more than their links; a word
is one long, and Spark's own bit functions do the rest. Ids need not be dense: sparse ones only fill their words less.

A request is lowered to bits: each leaf gives a column of bits over words (languages, categories, authors and series from
the index, any other leaf from its books), the tree becomes one bit expression over them, and every facet's set is a column
of the same row, a 64th of the books in number. The index is then read once, for all facets together.

Null ids are in no word. Ids are unique, and so are links; repeated rows of an id count once here, more often in `facets`.
Negative ids have words of their own. An empty catalog gives no rows but those of selected values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.facets import _field, shown
from tessera.operators.predicates import Tree, children, link_rows, mentions_deleted, scalar
from tessera.sources.catalog import Catalog
from tessera.sources.storage import kept, written

#: The field of the sets that aren't values: all books, and those that aren't deleted.
SETS = "_set"
#: Words of a request's set that are broadcast to the index; 64 MB with eight columns. More are joined by shuffle.
BROADCAST_WORDS = 1_000_000


def in_words(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, word and bits of rows with keys and book_id; each task sends a row for each word at most."""
    numbered = rows.filter("book_id is not null").select(*keys, F.expr("shiftright(cast(book_id as bigint), 6)").alias("word"), F.expr("shiftleft(1L, cast(book_id & 63 as int))").alias("bit"))
    return numbered.groupBy(*keys, "word").agg(F.bit_or("bit").alias("bits"))


def bitmap_rows(cat: Catalog) -> DataFrame:
    """field, value, word and bits of all facet fields and of the two sets."""

    def pair(field: str, value: Column) -> Column:
        return F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"))

    of_book = F.array(
        pair(SETS, F.lit("all")), pair(SETS, F.when(F.coalesce(~F.col("deleted"), F.lit(True)), "visible")), pair("lang", F.expr("nullif(lang, '')")), pair("ext", F.expr("nullif(ltrim('.', ext), '')")),
        pair("year", F.when(F.col("year") > 0, F.col("year"))), pair("lib_rate", F.when(F.col("lib_rate") > 0, F.col("lib_rate"))),
    )
    scalars = cat.books.select("book_id", F.explode(of_book).alias("x")).select("book_id", "x.field", "x.value")
    links = [links.select("book_id", F.lit(field).alias("field"), F.col(key).cast("string").alias("value")) for field, links, key in (("genre", cat.genre_links, "genre_code"), ("author", cat.author_links, "author_id"), ("series", cat.series_links, "series_id"))]
    return in_words(reduce(DataFrame.unionByName, links, scalars).filter("value is not null"), "field", "value")


def bitmap_index(spark: SparkSession, cat: Catalog, paths: list[str]) -> DataFrame:
    """bitmap_rows as a table sorted by field, value and word, made once for each state of the files at paths."""
    return kept(spark, "bitmaps", lambda: {"bits": (bitmap_rows(cat), ["field", "value", "word"])}, paths)["bits"]


def _from_index(cat: Catalog, index: DataFrame, leaf: Tree) -> DataFrame | None:
    """word and bits (several rows a word) of a leaf whose values the index holds as they are, else None."""
    field, values = leaf.get("term") or leaf.get("ids"), [str(v) for v in leaf.get("values", [])]
    if field not in ("lang", "genre", "author", "series") or "" in values:
        return None
    rows = index.filter(F.col("field") == field)
    if not leaf.get("children"):
        return rows.filter(F.col("value").isin(values)).select("word", "bits")
    if cat.below is None:
        return None
    codes = cat.below.filter(F.col("root").isin(values)).select(F.col("code").alias("value")).distinct()
    return rows.join(codes, "value", "left_semi").select("word", "bits")


def sets_of(cat: Catalog, index: DataFrame, trees: list[Tree], user: int = 1, deleted: bool = False) -> tuple[DataFrame, list[Column]]:
    """Rows of word and columns of bits, one for each word with a book, and each tree as a bit expression over them.

    Deleted books are outside every tree unless asked for.
    """
    universe = index.filter((F.col("field") == SETS) & (F.col("value") == ("all" if deleted else "visible")))
    leaves: list[DataFrame] = [universe.select("word", "bits")]
    everything = F.col("bits_0")

    def lower(tree: Tree) -> Column:
        if "and" in tree or "or" in tree:
            return reduce(Column.bitwiseAND if "and" in tree else Column.bitwiseOR, [lower(x) for x in children(tree)])
        if "not" in tree:
            return F.bitwise_not(lower(tree["not"])).bitwiseAND(everything)
        rows, others = _from_index(cat, index, tree), False
        if rows is None:
            if (condition := scalar(tree)) is not None:
                books = cat.books.filter(condition)
            else:
                _, links, condition, others = link_rows(cat, tree, user)
                books = links.filter(condition)
            rows = in_words(books.select("book_id")).select("word", "bits")
        leaves.append(rows)
        bits = F.col(f"bits_{len(leaves) - 1}")
        return (F.bitwise_not(bits) if others else bits).bitwiseAND(everything)

    conditions = [lower(t) for t in trees]
    every = reduce(DataFrame.unionByName, (rows.withColumn("leaf", F.lit(k)) for k, rows in enumerate(leaves)))
    bits = [F.coalesce(F.bit_or(F.when(F.col("leaf") == k, F.col("bits"))), F.lit(0).cast("long")).alias(f"bits_{k}") for k in range(len(leaves))]
    return every.groupBy("word").agg(*bits).filter("bits_0 <> 0"), conditions


def total(cat: Catalog, index: DataFrame, tree: Tree | None, user: int = 1) -> DataFrame:
    """One row: how many books match, as `total`."""
    words, conditions = sets_of(cat, index, [tree] if tree else [], user, bool(tree) and mentions_deleted(tree))
    return words.agg(F.coalesce(F.sum(F.bit_count(conditions[0] if tree else F.col("bits_0"))), F.lit(0)).cast("long").alias("total"))


def facets(cat: Catalog, index: DataFrame, tree: Tree | None, fields: list[str], user: int = 1, zero_rows: bool = True) -> DataFrame:
    """As `facets.facets`, from one scan of the bitmaps of all fields."""
    conjuncts = (tree["and"] if "and" in tree else [tree]) if tree else []
    words, conditions = sets_of(cat, index, conjuncts, user, bool(tree) and mentions_deleted(tree))

    def counted_in(field: str) -> Column:
        wanted = [c for c, node in zip(conditions, conjuncts, strict=True) if field == "genre" or _field(node) != field]
        return reduce(Column.bitwiseAND, wanted, F.col("bits_0"))

    hits = words.select("word", *(counted_in(f).alias(f"in_{f}") for f in fields))
    hits = written(hits.filter(reduce(Column.__or__, [F.col(f"in_{f}") != 0 for f in fields])), "hits")
    n = hits.count()
    of_field = reduce(lambda c, f: c.when(F.col("field") == f, F.col(f"in_{f}")), fields[1:], F.when(F.col("field") == fields[0], F.col(f"in_{fields[0]}")))
    asked = index.filter(F.col("field").isin(fields))
    both = asked.join(F.broadcast(hits) if n <= BROADCAST_WORDS else hits, "word")
    counts = both.groupBy("field", "value").agg(F.sum(F.bit_count(F.col("bits").bitwiseAND(of_field))).cast("long").alias("n")).filter("n > 0")
    if len(fields) > 1:
        counts = written(counts, "counts")  # the bitmaps are read once, whatever follows
    known = [d.select(F.lit(f).alias("field"), F.col(key).cast("string").alias("value")) for f, d, key in (("author", cat.authors, "author_id"), ("series", cat.series, "series_id")) if f in fields]
    if known:  # a key that the dictionary lacks isn't shown
        named = F.col("field").isin("author", "series")
        counts = counts.filter(~named).unionByName(counts.filter(named).join(reduce(DataFrame.unionByName, known), ["field", "value"], "left_semi"))
    return shown(cat, counts, conjuncts, fields, zero_rows)
