"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemart.operators.keys import per_key
from tidemart.session import settle


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node of its component, for every node of ``edges`` (u, v) that is not a root.

    Alternating large-star and small-star steps: neighbours above a node are hung on its least neighbour, then those
    below. The edges never grow in number, and a node with very many of them is folded before each shuffle and joined as
    a hot key that Spark can cut. Each round is written to the shared folder.
    """
    least: Column = F.least("u", "v")
    edges = settle(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), least.alias("v")).distinct(), "cc-edges")
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = per_key(both, "u", F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), least.alias("v"))
        low = per_key(down, "u", F.min("v").alias("m"))
        met = down.join(low, "u")
        small = met.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = settle(small.distinct(), "cc-edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
