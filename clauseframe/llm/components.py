"""Connected components of a DataFrame of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseframe.llm.textcore import in_few_files, written


def _star(both: DataFrame, small: bool) -> DataFrame:
    """both: each link (u, v); the links of every u go to its smallest neighbour."""
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if small:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
    else:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether all links form stars: no node has two links to smaller nodes, or one of those and another to a larger node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down")).union(edges.select("v", F.lit(0)))
    return not ends.groupBy("node").agg(F.sum("down").alias("down"), F.count("*").alias("c")).where("down > 0 AND c > 1").agg(F.count("*")).first()[0]


def connected_components(spark: SparkSession, links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """links (u long, v long) -> (node, component): the smallest node reachable from each linked node.

    A node without a link is absent. Minima are pre-aggregated, so a node with very many links does
    not gather them in one task; the number of rounds grows with the logarithm of the longest path, and there is none
    for links that are stars already. Both steps of a round are written, so that the driver plans each by itself.
    """
    edges = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), spark)
    rounds, rows = 0, edges.count()
    while not _settled(edges):
        if rounds == most_rounds:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        edges = written(in_few_files(_star(both, small=False), rows), spark)
        edges = written(in_few_files(_star(edges, small=True), rows), spark)
        rounds += 1
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
