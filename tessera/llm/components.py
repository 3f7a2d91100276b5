"""Connected components of an edge table, by alternating large-star and small-star steps (join and aggregate only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut_narrow, join_sized


def _is_star_forest(edges: DataFrame) -> bool:
    """Each child has one parent, and no parent is a child."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
    roles = ends.groupBy("n").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
    return roles.filter((F.col("child") > 1) | ((F.col("child") > 0) & (F.col("parent") > 0))).isEmpty()


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Columns node and component (the smallest reachable id) for every id that has an edge to another, the smallest itself excepted.

    Edges with a null end and loops are ignored; repeated edges count once. Each round is cut, so a lost executor repeats
    one round at most. A node with very many edges is aggregated before its rows meet, and its minimum is sent to where
    they lie. An error is raised where the rounds don't end, which halve the longest path each.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    e = cut_narrow(e, "edges")
    for _ in range(max_rounds):
        if _is_star_forest(e):
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut_narrow(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least")
        large = cut_narrow(join_sized(both, least, "u", "n").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        parent = cut_narrow(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "parent")
        small = join_sized(large, parent, "u", "n").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut_narrow(small.unionByName(parent.select("u", F.col("m").alias("v"))).distinct(), "edges")
    raise RuntimeError(f"no star forest after {max_rounds} rounds")
