"""Connected components of links, all on the executors: alternating large-star and small-star steps (Kiveris et al., 2014).

Each step is a hash partitioning by node, and its result is written to the shared folder, so a lost executor repeats one
step at most. Smallest neighbours are partial sums before the shuffle, and a node with a very large neighbourhood is a
skewed join that adaptive execution splits; nothing is collected. The number of steps is logarithmic in the size of the largest component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_durable, durable


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node of each node's component, for every node that has a link to another."""
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, old = durable(pairs, "links"), None
    while True:
        # Large star: every larger neighbour links to the smallest of the neighbourhood, the node itself included.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: every smaller neighbour, and the node, link to the smallest.
        large = durable(large, "links")
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        new = durable(small, "links")
        sums = [x.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first() for x in (edges, new)]
        drop_durable(large)
        if old is not None:
            drop_durable(old)
        old, edges = edges, new
        if sums[0] == sums[1]:
            drop_durable(old)
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
