"""Connected components of a table of links, by alternating large-star and small-star steps in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstack.llm.text import stash


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b); root is the least node of its component.

    Each step groups the links by a node and keeps its least neighbour, partially aggregated; a node with very
    many links is only joined with its own least neighbour. Steps are written to the shared folder. Ends when
    every node is either a root or tied to one. Joins are merged, so that no small step makes the driver build a
    broadcast table. No links: no rows. Links from a node to itself and repeated links do no harm.
    """
    edges = stash(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        # large star: every larger neighbour of a node is tied to the least of the node and its neighbours
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: a node and its smaller neighbours are tied to the least of them
        large = stash(large.where("u != v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = stash(small.where("u != v").distinct())
        ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("ties"), F.lit(0).alias("root")).union(edges.select("v", F.lit(0), F.lit(1)))
        open_ = ends.groupBy("n").agg(F.sum("ties").alias("ties"), F.max("root").alias("root")).where("ties + root > 1")
        if not open_.agg(F.count("*")).first()[0]:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
