"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import cut


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component) for every node of ``links`` (u, v); component is the smallest node reachable.

    Each round is two aggregations and joins over the links, written to the shared checkpoint folder; the number
    of links never grows, and rounds grow as the logarithm of the longest path.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        """pairs (u, v): v is a neighbour of u.  Links neighbours to the smallest one."""
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = pairs.join(least, "u")
        moved = out.filter("v > u" if large else "v < u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not large:
            moved = moved.union(least.select("u", F.col("m").alias("v")))
        return moved.filter("u <> v").distinct()

    edges = cut(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        grown = star(both, True)
        down = grown.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        edges = cut(star(down, False))
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
