"""Connected components of a distributed link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stash, stash


def connected_components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node that has a link; root is the component's smallest node.

    ``links`` has two columns of one orderable type. Each step is one
    aggregate (min neighbour, combined map-side) and one join, so a node with
    very many links is never gathered in one row, and every step is written
    to the shared folder. Steps are taken until nothing changes. Self links and
    repeated links are harmless; an empty table gives an empty result.
    """
    a, b = links.columns
    edges = stash(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), f"{name}-links"
    )
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: larger neighbours of u move to u's smallest neighbour (u included).
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # Small star: u and its smaller neighbours move to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        after = stash(small.select("e.*").where("u != v").distinct(), f"{name}-step")
        drop_stash(edges)
        edges = after
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
