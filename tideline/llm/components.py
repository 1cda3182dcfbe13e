"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.storage import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id in a link; component is the smallest id reachable.

    links: two columns of longs, in any order, with repeats or self-links; nulls
    are ignored. A node's neighbours are never gathered: each round needs only
    their minimum (a map-side aggregate) and a join of the links to it.
    """
    edges = stored(links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi > lo").distinct())
    before = None
    while True:
        # Large star: every larger neighbour of a node is linked to the node's smallest neighbour (or itself).
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.explode(F.array(F.struct("hi", "m"), F.struct(F.col("lo").alias("hi"), "m"))).alias("x")).select("x.hi", F.col("x.m").alias("lo")).where("hi > lo").distinct()
        edges = stored(small)
        # Unchanged if every node has one link left and those links are the same as before.
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")).first()
        if now == before or not now["n"]:
            break
        before = now
    return edges.groupBy("hi").agg(F.min("lo").alias("component")).select(F.col("hi").alias("id"), "component").union(edges.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())
