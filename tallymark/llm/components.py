"""Connected components of a graph that no machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v): component is the smallest node that it reaches.

    Alternates large-star and small-star steps.  Each is one aggregation with
    partial sums and one join, so a node with very many edges is no hot group;
    edges never outnumber those of the input, and only two sums reach the driver.
    """
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    state, edges = None, materialise(edges, "edges")
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written first, so that a join of a hub's edges is plain and can be split.
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        edges = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        edges = materialise(edges, "edges")
        least = materialise(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
        linked = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(linked.filter("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
