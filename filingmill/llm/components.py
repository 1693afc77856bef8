"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _print(edges: DataFrame):
    row = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31))).alias("h")).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node sends its larger neighbours to the smallest of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node sends its smaller neighbours, and itself, to the smallest of them."""
    down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    own = least.select(F.col("m").alias("a"), F.col("u").alias("b"))
    return moved.unionByName(own).where("a < b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b) links, a < b -> (node, root) for every node but the roots: the smallest node that it reaches.

    Every round's edges are written to the checkpoint folder; nothing but a count and a checksum reaches the driver.
    The rounds grow with the logarithm of the longest chain. Hubs are met by grouped minima, which combine before the
    shuffle, and by joins that adaptive execution can split. No links: no rows.
    """
    edges = staged(links.select("a", "b").where("a < b").distinct())
    seen = _print(edges)
    while seen[0]:
        edges = staged(_small_star(_large_star(edges)))
        now = _print(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
