"""Connected components of an undirected link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import materialize


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``id, component`` for every id that has a link; a component is named by its smallest id.

    Alternating large-star and small-star steps: every node is linked to the smallest
    node of its neighbourhood until nothing changes, in a number of rounds that grows with
    the logarithm of the longest chain; there is no other end. No component is ever gathered in one task: each
    step is a grouped minimum (combined map-side) and a join. Self-links and null ids are
    ignored; an empty input gives an empty result.
    """
    edges = links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    edges, mark = materialize(edges, "cc"), None
    while True:
        # large star: each larger neighbour of a node goes to the node's smallest neighbour
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        # small star: each smaller neighbour of a node, and the node, go to the smallest of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("m"), F.explode(F.array("u", "v")).alias("x")).where("m <> x")
        edges = materialize(small.select(F.col("m").alias("u"), F.col("x").alias("v")).distinct(), "cc")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    return edges.select(F.col("v").alias("id"), F.col("u").alias("component")).unionByName(
        edges.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct()
    )
