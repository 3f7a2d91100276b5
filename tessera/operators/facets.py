"""Facet counts over the matches of a tree: self-excluding, top-n, with pinned values and zero rows, in one pass.

A facet leaves out the conjuncts on its own field, where the root is an AND or that predicate alone; inside OR and NOT
they stay. The genre facet keeps its own conjuncts. Facets over the same request share one materialised set of books with
one column for each facet that tells whether the book counts in it; link facets join it with one link table each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.predicates import Tree, match, mentions_deleted, with_flags
from tessera.sources.catalog import Catalog, author_name
from tessera.sources.storage import written

#: Field: rows shown, order by value instead of by count.
FIELDS = {"lang": (20, False), "ext": (20, False), "genre": (20, False), "year": (200, True), "lib_rate": (200, True), "author": (20, False), "series": (20, False)}

SALTS = 64


def _field(leaf: Tree) -> str | None:
    return leaf.get("term") or leaf.get("ids") or leaf.get("number") or leaf.get("range") or leaf.get("flag")


def facets(cat: Catalog, tree: Tree | None, fields: list[str], user: int = 1, zero_rows: bool = True) -> DataFrame:
    """field, value, label, n, place (from 1), truncated."""
    conjuncts = (tree["and"] if "and" in tree else [tree]) if tree else []
    flagged, conditions = with_flags(cat, cat.books, conjuncts, user)
    if not (tree and mentions_deleted(tree)):
        flagged = flagged.filter(F.coalesce(~F.col("deleted"), F.lit(True)))
    # A facet of its own conjuncts' field needs the others only.
    ok = {f: reduce(Column.__and__, [c for c, node in zip(conditions, conjuncts, strict=True) if f == "genre" or _field(node) != f], F.lit(True)) for f in fields}
    scalar_value = {
        "lang": F.expr("nullif(lang, '')"), "ext": F.expr("nullif(ltrim('.', ext), '')"),
        "year": F.when(F.col("year") > 0, F.col("year").cast("string")), "lib_rate": F.when(F.col("lib_rate") > 0, F.col("lib_rate").cast("string")),
    }
    scalars = [f for f in fields if f in scalar_value]
    # The shared set: what any facet counts, and for which.
    values = [F.when(ok[f], scalar_value[f]).alias(f"value_{f}") for f in scalars]
    in_facet = [ok[f].alias(f"in_{f}") for f in fields if f not in scalar_value]
    hits = flagged.filter(reduce(Column.__or__, ok.values())).select("book_id", *values, *in_facet)
    if len(in_facet) + bool(scalars) > 1:
        hits = written(hits, "hits")
    parts = []
    if scalars:
        each = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"value_{f}").alias("value")) for f in scalars))
        parts.append(hits.select(F.explode(each).alias("x")).select("x.field", "x.value").filter("value is not null"))
    keys = {"genre": (cat.genre_links, "genre_code", None), "author": (cat.author_links, "author_id", cat.authors), "series": (cat.series_links, "series_id", cat.series)}
    for f in (f for f in fields if f in keys):
        links, key, dictionary = keys[f]
        rows = hits.filter(F.col(f"in_{f}")).select("book_id").join(links.select("book_id", key), "book_id")
        counted = rows.groupBy(key).agg(F.count("*").alias("n"))
        if dictionary is not None:  # a key that the dictionary lacks isn't shown
            counted = counted.join(dictionary.select(key), key, "left_semi")
        parts.append(counted.select(F.lit(f).alias("field"), F.col(key).cast("string").alias("value"), "n"))
    if scalars:
        parts[0] = parts[0].groupBy("field", "value").agg(F.count("*").alias("n"))
    counts = reduce(DataFrame.unionByName, parts)
    if len(fields) > 1:
        counts = written(counts, "counts")  # a row for each value, read by every limit
    return shown(cat, counts, conjuncts, fields, zero_rows)


def shown(cat: Catalog, counts: DataFrame, conjuncts: list[Tree], fields: list[str], zero_rows: bool = True) -> DataFrame:
    """The rows of each facet's answer, of counts (field, value, n): labels, pins, limits, zero rows and places."""
    labels = reduce(DataFrame.unionByName, (
        cat.genres.select(F.lit("genre").alias("field"), F.col("genre_code").alias("value"), F.col("title").alias("label")),
        cat.authors.select(F.lit("author").alias("field"), F.col("author_id").cast("string").alias("value"), author_name("facet").alias("label")),
        cat.series.select(F.lit("series").alias("field"), F.col("series_id").cast("string").alias("value"), F.col("series_title").alias("label")),
    ))
    pins = [(f, str(v)) for node in conjuncts for f in [_field(node)] if f in fields and f != "genre" and ("term" in node or "ids" in node) for v in node["values"]]
    pinned = reduce(Column.__or__, [(F.col("field") == f) & (F.col("value") == v) for f, v in pins], F.lit(False))
    rows = counts.withColumn("pin", F.when(pinned, 0).otherwise(1)).join(labels, ["field", "value"], "left")
    tie = F.coalesce("label", "value")
    by_count = Window.partitionBy("field").orderBy("pin", F.desc("n"), tie, "value")
    size = Window.partitionBy("field")
    # First ranked within hashed salts of a field, so that no task sorts a whole dictionary; the limits are literals, which prune early.
    by_salt = Window.partitionBy("field", "salt").orderBy("pin", F.desc("n"), tie, "value")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(SALTS)))

    def top_of(most: int) -> DataFrame:
        of_limit = rows.filter(F.col("field").isin([f for f in fields if FIELDS[f][0] == most]))
        few = of_limit.withColumn("rank", F.row_number().over(by_salt)).filter(F.col("rank") <= most + 1).drop("salt", "rank")
        ranked = few.withColumn("rank", F.row_number().over(by_count)).filter(F.col("rank") <= most + 1)
        return ranked.withColumn("truncated", F.max("rank").over(size) > most).filter(F.col("rank") <= most)

    top = reduce(DataFrame.unionByName, map(top_of, sorted({FIELDS[f][0] for f in fields})))
    if zero_rows and pins:
        asked = cat.books.sparkSession.createDataFrame(pins, "field string, value string")  # the selected values of one query
        missing = asked.join(top, ["field", "value"], "left_anti").join(labels, ["field", "value"], "left")
        top = top.unionByName(missing.select("field", "value", F.lit(0).cast("long").alias("n"), F.lit(-1).alias("pin"), "label", F.lit(0).alias("rank"), F.lit(False).alias("truncated")))
        top = top.withColumn("truncated", F.max("truncated").over(size))
    by_value = reduce(Column.__or__, [F.col("field") == f for f in fields if FIELDS[f][1]], F.lit(False))
    shown = Window.partitionBy("field").orderBy(F.when(by_value, -F.col("value").cast("long")), "pin", F.desc("n"), tie, "value")
    return top.withColumn("place", F.row_number().over(shown)).select("field", "value", F.when(F.col("label") != F.col("value"), F.col("label")).alias("label"), "n", "place", "truncated")


def facet_response(cat: Catalog, tree: Tree | None, fields: list[str], user: int = 1) -> DataFrame:
    """The facets in the order asked for (facet_no from 1), and the total as a row of its own (field total, facet_no 0)."""
    found = facets(cat, tree, fields, user)
    number = reduce(lambda c, f: F.when(F.col("field") == f[1], f[0]).otherwise(c), enumerate(fields, 1), F.lit(None))
    count = match(cat, tree, user).agg(F.count("*").alias("n"))
    null = F.lit(None).cast("string")
    total = count.select(F.lit(0).alias("facet_no"), F.lit("total").alias("field"), null.alias("value"), null.alias("label"), "n", F.lit(1).alias("place"), F.lit(False).alias("truncated"))
    return found.withColumn("facet_no", number).unionByName(total).orderBy("facet_no", "place")
