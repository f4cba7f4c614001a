"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def _smallest(both: DataFrame) -> DataFrame:
    """Each node's smallest neighbour or itself; minima are combined before the shuffle."""
    return both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the node's smallest one."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.join(_smallest(both), F.col("a") == F.col("u")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Links each smaller neighbour of a node, and the node, to its smallest one."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    joined = down.join(_smallest(down), F.col("a") == F.col("u"))
    ends = joined.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return ends.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of each node with a link: root is the smallest node of its component. links: (a, b), longs.

    Links of a node to itself, nulls and repeated links don't matter. Each round is checkpointed; rounds grow as the logarithm
    of the longest path. The driver sees a count and a hash of each round's links.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    before = None
    while True:
        edges = checkpoint(small_star(large_star(edges)))
        state = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == before or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = state
