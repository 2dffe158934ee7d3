"""Connected components of a table of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.lineage import cut, drop


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (a, b); a component is its least node.

    Each round replaces a node's links by links to its least neighbour: first for the
    larger neighbours, then for the smaller ones.  Both are a minimum per node (which
    combines before the shuffle), written and joined back: Spark can split a node with very
    many links in a join of two tables, not in one with an aggregate on the same key.
    Rounds grow with the logarithm of the longest path.
    """
    now = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        before = state
        both = now.union(now.select("v", "u"))
        nearest = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "nearest")
        large = both.filter("v > u").join(nearest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = cut(large, "large")
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").filter("u <> v").distinct()
        after = cut(small, "links")
        for done in (now, nearest, large, least):
            drop(done)
        now = after
