"""Connected components of links, by alternating large and small stars.

Each round links every node to the least of its neighbours, first among the larger ones, then among the smaller ones; the
rounds (of the order of the logarithm of the nodes) end when all links are (member, root). Links stay spread over the cluster and each
round is a written table, so a lost executor costs no earlier round. The least neighbour is a partial aggregate; it goes back
to the links of a hub by broadcast, to all others by a shuffle that hubs take no part in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkarray.llm.common import drop_table, joined, written


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long, null-free). Gives id, root (the least id of its component) for each id that a link names."""
    spark = links.sparkSession
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges, path = written(edges, "links")
    while not _is_forest_of_stars(edges):
        # Large star: the larger neighbours of a node go to its least neighbour (itself included).
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = joined(both, least, ["a"], "n").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large, large_path = written(large, "links")
        # Small star: a node and its smaller neighbours go to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = joined(large, least, ["a"], "n")
        least = least.drop("n")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        new, new_path = written(small, "links")
        drop_table(spark, large_path)
        drop_table(spark, path)
        edges, path = new, new_path
    # Every link is now (member, root).
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(roots)


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every larger end has one link and is no smaller end."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    bad = ends.groupBy("id").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).filter("up > 1 or (up > 0 and down > 0)")
    return not bad.limit(1).count()
