"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, component`` (its smallest node) for every node of ``links`` (u, v: longs).

    Each round joins nodes to their smallest neighbour; the edge list never
    grows, and a hub costs a partial aggregate and a join that splits. Rounds end
    when every node hangs on one root.
    """
    edges = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = cut(large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        n, nodes = edges.agg(F.count("*"), F.countDistinct("u")).first()
        if n == nodes and edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
