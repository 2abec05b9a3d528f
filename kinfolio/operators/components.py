"""Connected components by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import remove, written


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): each node of ``edges`` with the smallest node it reaches. A node with an edge to itself alone is left out.

    Large star: every larger neighbour of a node goes to the smallest of its neighbourhood. Small star: every smaller one
    does. The edges become stars around the components' smallest nodes in a few rounds, each of which is written; the
    driver learns only whether stars are reached. A node may have very many neighbours, so each one's smallest neighbour
    is written too: the join with it is between plain tables then and is split at run time where it is skewed.
    """
    now = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    while not now.isEmpty():
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # after a large star a node has few smaller neighbours
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        then = written(small, "edges")
        for used in (least, now):
            remove(used)
        now = then
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(now.select(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        if ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 OR below + above > 1").isEmpty():
            break
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return written(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components")
