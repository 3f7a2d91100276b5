"""Predicate trees over a catalog, lowered to filters, semi joins and boolean membership flags.

A tree is {"and": [..]}, {"or": [..]}, {"not": node} or a leaf:
  {"term": lang|ext|archive|genre, "values": [..], "children": bool}
  {"number": year|lib_rate|size|seq|user_rate, "op": eq|gte|lte|gt|lt, "value": n}
  {"range": same fields, "from": n, "to": n}            inclusive, either end optional
  {"ids": author|series|keyword|group, "values": [..]}
  {"flag": favorite|read|has_annotation|has_review|deleted, "value": bool}
  {"books": DataFrame of book_id}                          the matches of a text query
Every leaf is two-valued: a null field is outside it, and so inside its negation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.hierarchy import closure
from tessera.sources.catalog import Catalog, group_members

Tree = dict
SCALARS = {"year", "lib_rate", "size", "lang", "ext", "archive"}


def _compare(column: Column, leaf: Tree) -> Column:
    if "number" in leaf:
        return {"eq": column == leaf["value"], "gte": column >= leaf["value"], "lte": column <= leaf["value"], "gt": column > leaf["value"], "lt": column < leaf["value"]}[leaf["op"]]
    ends = [column >= leaf["from"]] if leaf.get("from") is not None else []
    ends += [column <= leaf["to"]] if leaf.get("to") is not None else []
    if not ends:
        raise ValueError("a range needs a bound")
    return reduce(Column.__and__, ends)


def scalar(leaf: Tree) -> Column | None:
    """The condition of a leaf on the books themselves, or None for a leaf over links."""
    field = leaf.get("term") or leaf.get("number") or leaf.get("range")
    if field in SCALARS:
        if "term" in leaf:
            values = [v if field != "ext" or v.startswith(".") else f".{v}" for v in leaf["values"]]
            return F.coalesce(F.col(field).isin(values), F.lit(False))
        return F.coalesce(_compare(F.col(field), leaf), F.lit(False))
    if leaf.get("flag") == "deleted":
        return F.coalesce(F.col("deleted") == leaf["value"], F.lit(False))
    return None


def link_rows(cat: Catalog, leaf: Tree, user: int = 1) -> tuple[str, DataFrame, Column, bool]:
    """Of a link leaf: a name of its table, the table (with book_id), the condition on its rows, and whether it means all other books."""
    true = F.lit(True)
    if "books" in leaf:
        return f"books{id(leaf['books'])}", leaf["books"], true, False
    if leaf.get("term") == "genre":
        if not leaf.get("children"):
            return "genre", cat.genre_links, F.col("genre_code").isin(leaf["values"]), False
        below = closure(cat.genres) if cat.below is None else cat.below
        codes = below.filter(F.col("root").isin(leaf["values"])).select(F.col("code").alias("genre_code")).distinct()
        return f"genres below {leaf['values']}", cat.genre_links.join(codes, "genre_code", "left_semi"), true, False
    if "ids" in leaf:
        kind = leaf["ids"]
        links = {"author": cat.author_links, "series": cat.series_links, "keyword": cat.keyword_links}.get(kind)
        links = group_members(cat) if kind == "group" else links
        return kind, links, F.col(f"{kind}_id").isin(leaf["values"]), False
    mine = cat.user_data.filter(F.col("user_id") == user)
    if "flag" in leaf:
        name = leaf["flag"]
        if name in ("favorite", "read"):
            return "user", mine, F.col(name) == 1, not leaf["value"]
        return name, {"has_annotation": cat.annotated, "has_review": cat.reviewed}[name], true, not leaf["value"]
    field = leaf.get("number") or leaf.get("range")
    if field == "seq":
        return "series", cat.series_links, _compare(F.col("seq"), leaf), False
    if field == "user_rate":
        return "user", mine, _compare(F.col("rate"), leaf), False
    raise ValueError(f"unknown predicate {leaf}")


def linked(cat: Catalog, leaf: Tree, user: int = 1) -> tuple[DataFrame, bool]:
    """The books that a link leaf selects (distinct by use in semi joins), and whether it means all others."""
    _, rows, condition, others = link_rows(cat, leaf, user)
    return rows.filter(condition).select("book_id"), others


def children(tree: Tree) -> list[Tree]:
    return tree.get("and") or tree.get("or") or ([tree["not"]] if "not" in tree else [])


def mentions_deleted(tree: Tree) -> bool:
    return tree.get("flag") == "deleted" or any(map(mentions_deleted, children(tree)))


def with_flags(cat: Catalog, books: DataFrame, trees: list[Tree], user: int = 1) -> tuple[DataFrame, list[Column]]:
    """books with a membership column for each link leaf of the trees, and each tree as one boolean expression over them.

    One aggregate and one join for each link table, whatever the number of leaves over it.
    """
    tables: dict[str, tuple[DataFrame, list[tuple[str, Column]]]] = {}
    count = 0

    def lower(tree: Tree) -> Column:
        nonlocal count
        if "and" in tree or "or" in tree:
            return reduce(Column.__and__ if "and" in tree else Column.__or__, [lower(x) for x in children(tree)])
        if "not" in tree:
            return ~lower(tree["not"])
        if (condition := scalar(tree)) is not None:
            return condition
        table, rows, condition, others = link_rows(cat, tree, user)
        flag = f"flag_{count}_"
        count += 1
        tables.setdefault(table, (rows, []))[1].append((flag, condition))
        member = F.coalesce(F.col(flag), F.lit(False))
        return ~member if others else member

    conditions = [lower(t) for t in trees]
    for rows, flags in tables.values():
        wanted = rows.filter(reduce(Column.__or__, [c for _, c in flags]))
        books = books.join(wanted.groupBy("book_id").agg(*(F.max(F.coalesce(c, F.lit(False))).alias(f) for f, c in flags)), "book_id", "left")
    return books, conditions


def match(cat: Catalog, tree: Tree | None, user: int = 1, hide_deleted: bool = True) -> DataFrame:
    """The books that match, each once. Leaves under a top AND become filters, semi and anti joins; the rest becomes flags."""
    books = cat.books
    if hide_deleted and not (tree and mentions_deleted(tree)):
        books = books.filter(F.coalesce(~F.col("deleted"), F.lit(True)))
    late: list[Tree] = []
    for node in (tree["and"] if "and" in tree else [tree]) if tree else []:
        leaf, negated = (node["not"], True) if "not" in node else (node, False)
        if {"and", "or", "not"} & set(leaf):
            late.append(node)
        elif (condition := scalar(leaf)) is not None:
            books = books.filter(~condition if negated else condition)
        else:
            ids, others = linked(cat, leaf, user)
            books = books.join(ids, "book_id", "left_anti" if others != negated else "left_semi")
    if late:
        names = books.columns
        flagged, conditions = with_flags(cat, books, late, user)
        books = flagged.filter(reduce(Column.__and__, conditions)).select(*names)
    return books
