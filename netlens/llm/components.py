"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import discard, saved


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node
    reachable. Null ends and links of a node with itself are left out.

    Large-star and small-star rounds: every node hands its smallest neighbour to the
    others, so a chain halves per round and a hub is an aggregate that combines before
    its shuffle. Ends when every node has one link, to a root.
    """
    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Larger neighbours go to the least one, the node itself through its smaller ones.
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = saved(large.distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        after = saved(small.where("u <> v").distinct())
        discard(edges, large)
        edges = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _settled(edges: DataFrame) -> bool:
    ends = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0), F.lit(1)).toDF("u", "up", "down"))
    each = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return each.where("up > 1 or (up > 0 and down > 0)").isEmpty()
