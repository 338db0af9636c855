"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def _starred(edges: DataFrame) -> DataFrame:
    """A large-star and a small-star step; edges have v < u."""
    flipped = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    least = edges.union(flipped).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # one exchange for what follows: its aggregate and its join are by u
    large = flipped.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).repartition("u")
    hung = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
    return hung.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _ended(edges: DataFrame) -> bool:
    """Whether no node has edges to several smaller ones, or to smaller and to larger ones."""
    ends = edges.select("u", "v", F.lit(False).alias("root")).union(edges.select("v", F.lit(None), F.lit(True)))
    nodes = ends.groupBy("u").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.max("root").alias("root"))
    return nodes.where("a != b or (root and a is not null)").isEmpty()


def stars(edges: DataFrame) -> DataFrame:
    """(u, v) of every node u of the undirected edges (u, v) but the components' smallest nodes v.

    Each step moves edges towards roots by aggregates and joins, so no component meets in a task, and the number of
    steps is logarithmic in a component's size. The driver sees at most one row a step.
    """
    now = staged(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _ended(now):
        before = now
        now = staged(_starred(now), "stars")
        discard(before)
    return now


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected edges (u, v); root is the component's smallest node."""
    now = stars(edges)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
