"""Connected components of an edge table by alternating large and small stars.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Every step is
a grouped minimum, which combines before the shuffle, and a join of two saved tables,
which AQE may split where a vertex has very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge and leads to a node that has none."""
    n, own = edges.agg(F.count("*"), F.countDistinct("a")).first()
    return n == own and edges.select(F.col("b").alias("a")).distinct().join(edges, "a", "left_semi").isEmpty()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of *edges* (a, b) that is not the smallest of its component."""
    edges = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _stars(edges):
        both = edges.union(edges.select("b", "a"))
        least = scratch.save(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "large-min")
        large = scratch.save(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        least2 = scratch.save(large.groupBy("a").agg(F.min("b").alias("m")), "small-min")
        small = large.join(least2, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
        after = scratch.save(small.where("a <> b").distinct(), "edges")
        scratch.drop(edges, least, large, least2)
        edges = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
