"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.util import cut, drop_cut


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the smallest node of each node's component, for all nodes in ``links`` (longs, not null).

    Each round groups by node, with minima combined before the shuffle; the number of rounds grows with the
    logarithm of the largest component, and there is none if the links are stars about their smallest nodes
    already. Rounds are cut by written tables.
    """
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "links")
    while _not_stars(edges):
        # large star: every neighbour above a node goes to the node's smallest neighbour
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: what lies at or below a node meets at its smallest neighbour
        large = cut(large.where("u > v").distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        after = cut(small.where("u > v").distinct(), "links")
        drop_cut(large)
        drop_cut(edges)
        edges = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _not_stars(edges: DataFrame) -> bool:
    """Whether some node has two links downwards, or links both ways."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("down")))).alias("e")).select("e.*")
    return bool(ends.groupBy("node").agg(F.sum("down").alias("down"), F.count(F.lit(1)).alias("all")).where("down > 1 OR (down = 1 AND all > 1)").limit(1).count())
