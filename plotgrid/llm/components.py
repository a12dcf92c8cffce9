"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotgrid.session import cut_lineage


def _mark(edges: DataFrame) -> tuple:
    """Row count and an order-free sum that tell whether two edge sets differ."""
    row = edges.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1)))
    ).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.where(F.col("v") > F.col("u")).join(least, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root): every node that has a link, with the least node it can reach.

    Both star steps keep an edge set as connected as it was and never larger than it was, and
    the number of rounds grows with the logarithm of the longest path. Minima are combined
    before the shuffle, so a node with very many links costs one row per task. Each
    round is written to the shared folder, which a lost executor does not take along.
    Links to oneself and nulls are ignored; no links give no rows.
    """
    edges = cut_lineage(
        links.where(F.col(left) != F.col(right))
        .select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).distinct(), "edges"
    )
    before = _mark(edges)
    while True:
        edges = cut_lineage(_small_star(_large_star(edges)), "edges")
        now = _mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select("v", "v").distinct()
    )
