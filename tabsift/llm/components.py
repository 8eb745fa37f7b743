"""Connected components of a large set of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsift.llm.common import written
from tabsift.operators.joins import keyed_join


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: every linked node and the smallest node it reaches.

    Alternating large and small stars: each round hangs a node's larger neighbours, then its
    smaller ones, on the smallest, until every component is one star. A round joins links with one
    row per node, and a node with a third of all links is split between tasks; no component meets
    in one task, and each round goes through a table in the shared folder.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    edges = links.filter(F.col(a) != F.col(b)).select(high.alias("u"), low.alias("v")).distinct()
    edges = written(edges, "links")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("_u")).agg(F.least("_u", F.min("v")).alias("_m"))
        large = keyed_join(both, least, {"u": "_u"}).filter(F.col("v") > F.col("u")).select(
            F.col("v").alias("u"), F.col("_m").alias("v")).distinct()
        large = written(large, "stars")
        least = large.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_m"))
        hung = keyed_join(large, least, {"u": "_u"})
        small = hung.filter(F.col("v") != F.col("_m")).select(F.col("v").alias("u"), F.col("_m").alias("v"))
        small = small.unionByName(least.select(F.col("_u").alias("u"), F.col("_m").alias("v"))).distinct()
        edges = written(small, "links")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one other, and on one that hangs on none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    nodes = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return nodes.filter("hangs > 1 or (hangs = 1 and holds = 1)").isEmpty()
