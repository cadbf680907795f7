"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: longs); nodes have one root if and only if they are connected.

    In each round every node points to its least neighbour by a hashed order, pointers are doubled once, and edges
    move to where their ends point. Nodes that stay are a fraction of those before whatever the shape of the graph, so
    rounds grow with the logarithm of the longest path. Each round is written to the shared folder; the driver sees
    only whether edges are left. Counts are combined before they are exchanged, and Spark splits the joins of hubs."""
    found = None
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    edges = cut(edges.where("a <> b").select("a", "b"), "edges")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        own = best.select(F.col("a").alias("node"), F.least(rank("a"), F.col("m"))["id"].alias("up"))
        above = own.select(F.col("node").alias("up"), F.col("up").alias("upper"))
        step = cut(own.join(above, "up").select("node", F.col("upper").alias("root")), "edges-step")
        if found is None:
            found = step
        else:
            later = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            found = found.join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
            found = cut(found, "edges-found")
        ends = edges.join(step.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(step.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        edges = cut(ends.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    return found if found is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
