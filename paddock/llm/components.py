"""Connected components of a distributed edge table.

Nodes are of any type that can be ordered. The edges of a hot node are spread over SALTS parts, and
minima are combined before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.common import checkpointed

SALTS = 8


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges with the least node m of their node a."""
    parts = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    return edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(parts, ["a", "salt"]).drop("salt")


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node go to the least node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return _with_least(both, least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the least of them; edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    smaller = _with_least(edges, least).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return smaller.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _stars_only(edges: DataFrame) -> bool:
    """Whether every node has one edge at most and no root has any."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("root")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("root").alias("root")).where("out + root > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is its smallest node.

    Alternates large-star and small-star until the edges are stars. Minima are combined before
    the shuffle, each round is written to the checkpoint folder, and only a yes or no comes
    to the driver. No edges give no rows; loops and nulls are left out.
    """
    edges = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    edges = checkpointed(_small_star(edges))
    while not _stars_only(edges):
        edges = checkpointed(_small_star(_large_star(edges)))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
