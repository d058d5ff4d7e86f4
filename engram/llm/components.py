"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, write_out


def _both_ways(e: DataFrame) -> DataFrame:
    return e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(e: DataFrame, least: DataFrame) -> DataFrame:
    return _both_ways(e).where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(down: DataFrame, least: DataFrame) -> DataFrame:
    return down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))


def _all_stars(e: DataFrame) -> bool:
    """Whether every edge leads from a node with no other edge down to a node that no edge leaves: then each v is its component's smallest node."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(e.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return nodes.where("out > 1 or (out = 1 and into = 1)").isEmpty()


def components(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """(node, root) of every node that has an edge to another; root is the component's smallest node.

    Nodes can be of any orderable type. Edges that are null or loops are ignored. Every round is
    cut off by a table written to the shared folder, and the tables of the round before are deleted; a component of diameter d takes about
    log d rounds. So are the least neighbours, which are found by a partial aggregate: the join with them then starts from a shuffle of its
    own, whose partitions adaptive execution can split where a hub has many edges. Rounds end when all edges form stars.
    """
    spark = edges.sparkSession
    e, at = write_out(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _all_stars(e):
        least, at_least = write_out(_both_ways(e).groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        large, at_large = write_out(_large_star(e, least).where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        low, at_low = write_out(large.groupBy("u").agg(F.min("v").alias("m")))
        e, at_next = write_out(_small_star(large, low).where("u != v").distinct())
        for path in (at, at_least, at_large, at_low):
            remove(spark, path)
        at = at_next
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
