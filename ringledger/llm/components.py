"""Connected components of a table of links, by stars around the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringledger.functions.workspace import cut


def _smallest(pairs: DataFrame) -> DataFrame:
    """``pairs`` (u, v) with ``m``, the smallest of u and its v."""
    low = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return pairs.join(low, "u")


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) for every node of a link between different nodes.

    Two steps alternate until the links stay as they are: every node's larger neighbours are linked
    to its smallest one, then its smaller ones. Each step is one aggregation and one join by node,
    both with partial sums or skew splits for a hot node, and is written out, so that the plan does
    not grow. Repeated links and loops do no harm.
    """
    a, b = F.col(left), F.col(right)
    edges = cut(links.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        before = tuple(state)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _smallest(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = cut(large, "links")
        small = _smallest(large)
        edges = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").filter("u != v").distinct()
        edges = cut(edges, "links")
