"""Connected components by alternating stars, on edges only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import settle


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least node around it instead."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    tied = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return tied.union(own).where("u <> v").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every edge leads down, no node has two and none leads on: then the edges are the answer."""
    start = F.struct(F.col("u").alias("node"), F.when(F.col("u") < F.col("v"), 2).otherwise(1).alias("n"))
    end = F.struct(F.col("v").alias("node"), F.lit(0).alias("n"))
    ends = edges.select(F.inline(F.array(start, end))).groupBy("node").agg(F.sum("n").alias("n"), F.min("n").alias("least"))
    return ends.where("n > 1 or n > least").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each component, for the nodes other than roots.

    ``edges`` has integer columns ``u`` and ``v``. A round ties nodes to the least around them; the number
    of rounds grows with the logarithm of the longest chain. Each round's edges, never more than before,
    go to the shared folder.
    """
    edges = settle(edges.where("u <> v").select("u", "v").distinct(), "edges")
    while not _are_stars(edges):
        edges = settle(_small_star(_large_star(edges)), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
