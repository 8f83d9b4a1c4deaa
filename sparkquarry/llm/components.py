"""Connected components of a link table by alternating large-star and small-star rounds.

Edge cases: links that repeat, in either direction, count once; an empty table gives
an empty result. Nodes are integers, never null, and no link joins a node to itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round: every node hands the smallest node it sees to its larger (large-star) or smaller (small-star) neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    met = both.join(least, "a")
    out = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, component): for every node of ``edges`` (columns a, b; a <> b) the smallest node reachable from it.

    Each round is written to the shared folder, so a round that is lost is read
    again and not recomputed. The rounds end when the links form stars whose
    centres are the smallest nodes, which is the fixed point.
    """
    spark = edges.sparkSession
    now, path = scratch.cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    for _ in range(max_rounds):
        # stars with the smallest node as centre: no node is both a centre and a leaf, and no leaf has two centres
        leaves = now.groupBy("a").agg(F.count("*").alias("n"))
        if leaves.filter("n > 1").isEmpty() and now.select("b").distinct().join(leaves, F.col("b") == leaves["a"], "left_semi").isEmpty():
            centres = now.select("b").distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(centres.select(F.col("b").alias("node"), F.col("b").alias("component")))
        new, new_path = scratch.cut(_stars(_stars(now, large=True), large=False).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
        scratch.drop(spark, path)
        now, path = new, new_path
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
