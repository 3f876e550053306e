"""Connected components of an edge table by alternating star contractions; neither edges nor labels come to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Workspace


def components(edges: DataFrame, space: Workspace) -> DataFrame:
    """node and root (the least node of its component) of every node of the edges a, b, but for the roots themselves.

    Large stars hang each node's larger neighbours, small stars its smaller ones, to the least node nearby,
    until all edges are stars: every node has one root, and no root is a node. Then every edge joins a node to
    its root. Rounds grow with the logarithm of the number of nodes. Each round is written out; minima are taken
    before the shuffle.
    """
    now = space.save(edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).where("node <> root").distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.min("root").alias("m")).select("node", F.least("node", "m").alias("m"))
        large = both.where("root > node").join(least, "node").select(F.col("root").alias("node"), F.col("m").alias("root")).where("node <> root").distinct()
        down = large.groupBy("node").agg(F.min("root").alias("m"))
        small = large.join(down, "node").select(F.explode(F.array(F.struct("node", F.col("m").alias("root")), F.struct(F.col("root").alias("node"), F.col("m").alias("root")))).alias("e")).select("e.*").where("node <> root").distinct()
        after = space.save(small, "stars")
        space.drop(now)
        now = after
        if are_stars(now):
            return now


def are_stars(edges: DataFrame) -> bool:
    """Whether every node of the edges node, root has one root, and no root is a node; node and root differ."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("node").alias("at"), F.lit(1).alias("roots"), F.lit(0).alias("nodes")), F.struct(F.col("root").alias("at"), F.lit(0).alias("roots"), F.lit(1).alias("nodes")))).alias("e")).select("e.*")
    return ends.groupBy("at").agg(F.sum("roots").alias("roots"), F.max("nodes").alias("nodes")).where("roots + nodes > 1").isEmpty()
