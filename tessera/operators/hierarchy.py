"""Category trees: downward closure, subtree counts, tree paths, and selections without absorbed descendants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.catalog import Catalog
from tessera.sources.storage import written

#: Pairs up to which one side of a doubling step is broadcast.
BROADCAST_PAIRS = 500_000


def _within(pairs: DataFrame, n: int) -> DataFrame:
    return F.broadcast(pairs) if n <= BROADCAST_PAIRS else pairs


def closure(genres: DataFrame) -> DataFrame:
    """(root, code, depth): every code with itself and all its descendants, each pair once at its least depth.

    By pointer doubling: jumps lead 2^k levels up, and a round joins each jump with the ancestors found so far of where it
    ends, so trees of n levels take log n rounds and every pair is made once. Cycles end, as a round without a new pair is
    the last. A row with a parent that is absent, or without one, is a root; rows of one code with several parents are all
    followed. Each round is a written table; those of up to BROADCAST_PAIRS rows are broadcast, so a parent of very many
    children is no hot key, and beyond that skewed joins are split by the adaptive plan.
    """
    own = genres.select("genre_code", "parent_code").filter("genre_code is not null").distinct()
    codes = own.select("genre_code").distinct()
    # (code, mid): mid is 2^k levels above code. found: (root, code, depth) of all depths below 2^k.
    jumps = written(own.join(codes.select(F.col("genre_code").alias("mid")), F.col("parent_code") == F.col("mid")).select(F.col("genre_code").alias("code"), "mid"), "jumps")
    parts = [written(codes.select(F.col("genre_code").alias("root"), F.col("genre_code").alias("code"), F.lit(0).alias("depth")), "pairs")]
    found, n_found, n_jumps, step = parts[0], parts[0].count(), jumps.count(), 1
    while n_jumps:
        above = _within(found.withColumnRenamed("code", "mid"), n_found) if n_found <= n_jumps or n_jumps > BROADCAST_PAIRS else found.withColumnRenamed("code", "mid")
        near = jumps if n_jumps > BROADCAST_PAIRS or n_found <= n_jumps else F.broadcast(jumps)
        reached = near.join(above, "mid").groupBy("root", "code").agg((F.min("depth") + step).alias("depth"))
        new = written(reached.join(found.select("root", "code"), ["root", "code"], "left_anti"), "pairs")
        if not (n_new := new.count()):
            break
        parts.append(new)
        found, n_found = found.unionByName(new), n_found + n_new
        ends = jumps.select(F.col("code").alias("end"), "mid")
        further = jumps.withColumnRenamed("mid", "end").join(_within(ends, n_jumps), "end").select("code", "mid").distinct()
        jumps = written(further, "jumps")
        n_jumps, step = jumps.count(), 2 * step
    return found


def subtree_counts(cat: Catalog) -> DataFrame:
    """code, parent_code, title, books (each book once in the subtree) and own_books, over visible books; zero rows stay, deleted genres don't."""
    genres = cat.genres.filter("not deleted")
    links = cat.genre_links.join(cat.books.filter("not deleted").select("book_id"), "book_id").select(F.col("genre_code").alias("code"), "book_id")
    counts = closure(genres).join(links, "code").groupBy("root").agg(F.count_distinct("book_id").alias("books"), F.count_distinct(F.when(F.col("root") == F.col("code"), F.col("book_id"))).alias("own_books"))
    rows = genres.join(counts.withColumnRenamed("root", "genre_code"), "genre_code", "left")
    return rows.select(F.col("genre_code").alias("code"), F.expr("nullif(parent_code, '')").alias("parent_code"), "title", F.coalesce("books", F.lit(0)).alias("books"), F.coalesce("own_books", F.lit(0)).alias("own_books"))


def tree_paths(genres: DataFrame) -> DataFrame:
    """code, depth, is_root and path (titles from the root down, by " / "), in the order of a walk by titles.

    A row whose parent is absent becomes a root.
    """
    above = closure(genres).join(genres.select(F.col("genre_code").alias("root"), "title"), "root")
    way = F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("up"), "title", "root")))
    paths = above.groupBy(F.col("code").alias("genre_code")).agg(F.max("depth").alias("depth"), way.alias("way"))
    rows = paths.select(
        F.col("genre_code").alias("code"), "depth", (F.col("depth") == 0).alias("is_root"),
        F.array_join(F.transform("way", lambda s: s["title"]), " / ").alias("path"), F.transform("way", lambda s: F.struct(s["title"], s["root"])).alias("key"),
    )
    return rows.orderBy("key").select("code", "depth", "is_root", "path")


def topmost(selection: DataFrame, genres: DataFrame) -> DataFrame:
    """(book_id, code) without codes that have a selected strict ancestor in the same book."""
    below = closure(genres).filter("depth > 0").select(F.col("root").alias("genre_code"), "code")
    absorbed = selection.withColumnRenamed("code", "genre_code").join(below, "genre_code").select("book_id", "code")
    return selection.distinct().join(absorbed, ["book_id", "code"], "left_anti")
