"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_table, drop


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a long, b long); root is the component's least node.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each round
    every edge is replaced by one to a smaller node, in O(log^2 n) rounds for any
    shape.  A round ends in a written table.  Both steps aggregate a node's least
    neighbour before they join it back, so a hub's edges spread over tasks.  Null
    ends and edges from a node to itself are no edges, repeated ones count once;
    without edges there are no nodes.
    """
    now = as_table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        sign = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if not sign["n"] or sign == seen:
            break
        seen = sign
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        before, now = now, as_table(small, "edges")
        drop(before)
    roots = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
