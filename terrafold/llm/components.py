"""Connected components by alternating star contractions on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.plans.session import written


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (a, b) with b < a."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    # the smallest neighbour takes all others, and the node itself
    small = large.join(low, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.union(low.select("a", F.col("m").alias("b"))).filter("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of ``edges`` (a, b, both bigint): root is the smallest node reachable.

    Each round is written, so lineage stays short and a lost executor costs one round at most. It ends when
    the edges are stars: every child has one parent and no parent is a child. A logarithmic number of rounds.
    """
    at = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        n, children = at.agg(F.count(F.lit(1)), F.count_distinct("a")).first()
        if n == children and at.join(at.select(F.col("b").alias("p")), F.col("a") == F.col("p"), "left_semi").limit(1).count() == 0:
            break
        at = written(_stars(at), "links")
    return at.select(F.col("a").alias("node"), F.col("b").alias("root")).union(at.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
