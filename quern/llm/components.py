"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.blocks import durable


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (the least node of each component) for all nodes that have an edge.

    Each round maps edges to the least neighbour of their end, first among all neighbours (large star), then
    among smaller ones (small star); the number of rounds grows with the logarithm of the longest path. A round
    is aggregates with map-side combination and joins that can be split; nothing is collected but two numbers.
    """
    e = durable(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    last = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        e = durable(small)
        now = e.agg(F.count(F.lit(1)), F.sum(F.expr("cast(pmod(xxhash64(u, v), 1000000007) as long)"))).first()
        if now == last:
            break
        last = now
    found = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
