"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from methmix.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour, or to the node itself."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is tied to its smallest neighbour."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    smallest = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(smallest, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of `edges` (u, v: bigint): the smallest node that it can reach.

    Rounds end when nothing changes; each round is written, so a lost executor costs one round. Edges
    to itself and repeated edges are allowed. No edges give no rows.
    """
    edges = stored(edges.select("u", "v").filter("u <> v"), "edges")
    state = None
    while True:
        edges = stored(_small_star(_large_star(edges)), "edges")
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    leaves = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return leaves.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
