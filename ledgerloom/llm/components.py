"""Connected components of a distributed edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.store import scratch, written


def _star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours linked to the least of its neighbourhood, then its smaller ones and itself to their least."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a")
    small = small.select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e")).select("e.a", F.col("e.m").alias("b"))
    return small.where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b: two numbers) as (node, root): each node that has an edge, but for roots, with the least node it reaches.

    Nothing is collected; each round is written, so its lineage is short. Rounds grow with the logarithm of the longest path.
    """
    with scratch(edges.sparkSession) as keep:
        now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        before = None
        while True:
            state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 998_244_353)).first())
            if state == before:
                return keep(now.select(F.col("a").alias("node"), F.col("b").alias("root")), "components")
            before, now = state, written(_star(now), "edges")


def merged(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """roots as components gives them, of the edges before and the new ones (a, b): only the components that new edges touch are worked out."""
    for side in ("a", "b"):
        known = roots.select(F.col("node").alias(side), "root")
        edges = edges.join(known, side, "left").withColumn(side, F.coalesce("root", side)).drop("root")
    above = components(edges.select("a", "b"))
    deeper = above.select(F.col("node").alias("root"), F.col("root").alias("top"))
    old = roots.join(deeper, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return written(old.unionByName(above), "components")
