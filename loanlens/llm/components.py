"""Connected components of a link table, as alternating star rounds on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import drop_written, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands the smallest of its neighbours and itself to its larger neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands its smallest neighbour to itself and its other smaller neighbours."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    down = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return down.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node with an edge down has one, to a node that has none."""
    down = edges.groupBy("u").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    chained = edges.select("v").join(down.select(F.col("u").alias("v")), "v", "left_semi")
    return down.where("lo <> hi").isEmpty() and chained.isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (node, label) with the smallest node of each component as its label.

    Two aggregates and two joins a round; the number of rounds grows with the logarithm of the
    longest path. Every round is written; the round before is dropped.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges, path = written(edges)
    while not _stars(edges):
        new, new_path = written(_small_star(_large_star(edges)))
        drop_written(spark, path)
        edges, path = new, new_path
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
