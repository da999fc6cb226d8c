"""Connected components by alternating large and small stars, on DataFrames.

Each round takes two joins on a vertex; the side that may be hot (a vertex with many neighbours) meets one row for
each vertex, so a sort-merge join whose hot partitions Spark splits is enough. The rounds grow with the logarithm
of the longest path. Edges stay distributed; the driver sees a count and a sum for each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.llm.common import Workspace


def _stars(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    lowest = large.groupBy("a").agg(F.min("b").alias("m"))
    joined = large.join(lowest, "a")
    return joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a > b").distinct()


def components(space: Workspace, edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node of the component. edges: a, b (long). Nodes without edges are left out."""
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before, now, k = None, space.write(edges, "edges-0"), 0
    while True:
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if state == before or not state[0]:
            break
        before, k = state, k + 1
        now = space.write(_stars(now), f"edges-{k}")
        space.drop(f"edges-{k - 1}")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
