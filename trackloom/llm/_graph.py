"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm._shared import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node that links reach.

    Each round hangs every node's root under the smallest root next to it, then shortens all paths twice, so that the
    number of rounds grows with the logarithm of the longest path.  Only links that still join two roots go on.
    """
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    roots = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("root", F.col("node"))
    roots, k = scratch.save(roots, f"{name}-roots-0"), 0
    links = scratch.save(links.distinct(), f"{name}-links-0")
    while not links.isEmpty():
        k += 1
        # The links join roots: each root takes its smallest neighbour below it.
        parent = links.groupBy("a").agg(F.min("b").alias("b"))
        for i in range(2):
            up = parent.select(F.col("a").alias("b"), F.col("b").alias("c"))
            parent = parent.join(up, "b", "left").select("a", F.coalesce("c", "b").alias("b"))
            parent = scratch.save(parent, f"{name}-parent-{k}-{i}")
        roots = roots.join(parent.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("b", "root").alias("root"))
        roots = scratch.save(roots, f"{name}-roots-{k}")
        links = links.join(parent.withColumnRenamed("b", "a2"), "a", "left").select(F.coalesce("a2", "a").alias("a"), "b")
        links = links.join(parent.select(F.col("a").alias("b"), F.col("b").alias("b2")), "b", "left").select("a", F.coalesce("b2", "b").alias("b"))
        # A path too long to be shortened to its end leaves its last step as a link.
        steps = parent.join(parent.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select(F.col("b").alias("a"), F.col("c").alias("b"))
        links = links.unionByName(steps).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        links = scratch.save(links, f"{name}-links-{k}")
        scratch.drop(f"{name}-roots-{k - 1}", f"{name}-links-{k - 1}", f"{name}-parent-{k}-0")
    return roots
