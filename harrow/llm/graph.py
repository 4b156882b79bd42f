"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """For each node with an edge: the least of itself and its neighbours. Written out, so that
    the join with it is between two plain exchanges, whose hot partitions can be split."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")).select(F.col("u").alias("node"), "m"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (u, v) -> node, root: the least node that can be reached, for every node of an edge.

    Self loops, repeated and reversed edges do no harm. Each round is a pair of joins on the
    node; a node with very many neighbours is aggregated before the shuffle, and its rows in the
    join are split by adaptive execution. Stops when a round changes nothing (the logarithm
    of the longest path, not its length); raises if max_rounds did not do.
    """
    e = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        # large star: each larger neighbour of a node is linked to the least of the neighbourhood
        least = _least_neighbour(e)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least, F.col("u") == F.col("node")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct())
        # small star: node and its smaller neighbours are linked to the least of them
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "node"))
        small = large.join(least, F.col("u") == F.col("node")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = materialize(small.union(least.select(F.col("node").alias("u"), F.col("m").alias("v"))).distinct())
        # done when it is a forest of stars: every node has one edge, and no root has one
        done = new.count() == new.select("u").distinct().count() and new.join(new.select(F.col("v").alias("r")).distinct(), F.col("u") == F.col("r"), "left_semi").isEmpty()
        e = new
        if done:
            roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
    raise RuntimeError(f"components: not settled after {max_rounds} rounds")
