"""Names and sizes of clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parse import present

NOISE = -1
#: Seeded identities that are shown by name; the rest are counted.
SEEDED_NAMES = 20


def majority_names(rows: DataFrame) -> DataFrame:
    """cluster_id, name: the commonest person_name of a cluster; of equals, the first in (photo_id, face_idx) order."""
    named = rows.where((F.col("cluster_id") >= 0) & present(F.col("person_name")))
    counts = named.groupBy("cluster_id", "person_name").agg(F.count("*").alias("n"), F.min(F.struct("photo_id", "face_idx")).alias("first"))
    order = F.struct((-F.col("n")).alias("n"), "first")
    return counts.groupBy("cluster_id").agg(F.min_by("person_name", order).alias("name"))


def seed_names(seeds: DataFrame, identities: DataFrame) -> DataFrame:
    """cluster_id, name of the only seed in a cluster; two seeds in one cluster name nothing."""
    alone = seeds.where(F.col("cluster_id") >= 0).groupBy("cluster_id").agg(F.count("*").alias("n"), F.min("identity_id").alias("identity_id")).where("n = 1")
    return alone.join(identities.select(F.col("id").alias("identity_id"), "name"), "identity_id").where(present(F.col("name"))).select("cluster_id", "name")


def seeded_names(centroids: DataFrame, identities: DataFrame, n: int = SEEDED_NAMES) -> DataFrame:
    """identity_id, name of the first ``n`` identities with a centroid, by id; an identity without a name shows its id."""
    names = identities.select(F.col("id").alias("identity_id"), "name")
    return centroids.select("identity_id").join(names, "identity_id", "left").orderBy("identity_id").limit(n).select("identity_id", F.coalesce("name", F.col("identity_id").cast("string")).alias("name"))


def named(rows: DataFrame, majority: DataFrame, seeded: DataFrame | None = None) -> DataFrame:
    """Adds ``predicted_name`` (majority, else seed) and ``confidence`` (1 in a cluster, 0 in noise)."""
    out = rows.join(majority.withColumnRenamed("name", "_vote"), "cluster_id", "left")
    if seeded is not None:
        out = out.join(seeded.withColumnRenamed("name", "_seed"), "cluster_id", "left")
    else:
        out = out.withColumn("_seed", F.lit(None).cast("string"))
    real = F.col("cluster_id") >= 0
    return out.withColumn("predicted_name", F.when(real, F.coalesce("_vote", "_seed"))).withColumn("confidence", F.when(real, 1.0).otherwise(0.0)).drop("_vote", "_seed")


def sizes(rows: DataFrame) -> DataFrame:
    """cluster_id, faces, first (photo_id, face_idx), predicted_name: the first that is there, in that order."""
    key = F.struct("photo_id", "face_idx")
    return rows.groupBy("cluster_id").agg(F.count("*").alias("faces"), F.min(key).alias("first"), F.min_by("predicted_name", F.when(present(F.col("predicted_name")), key)).alias("predicted_name"))


def summary(rows: DataFrame) -> DataFrame:
    """cluster_id, faces, assigned_name; noise is -1 and has —, nameless clusters are unknown."""
    name = F.when(F.col("cluster_id") == NOISE, F.lit("—")).otherwise(F.coalesce("predicted_name", F.lit("unknown")))
    return sizes(rows).select("cluster_id", "faces", name.alias("assigned_name"))


def breakdown(rows: DataFrame, names: list[str]) -> DataFrame:
    """Per asked name: clusters, faces in them, and the ten largest distinct cluster sizes as a string."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(n,) for n in names], "name string")  # as many rows as arguments
    per = rows.where(F.col("predicted_name").isNotNull()).groupBy(F.col("predicted_name").alias("name"), "cluster_id").agg(F.count("*").alias("own"))
    per = per.join(F.broadcast(wanted), "name").join(sizes(rows).select("cluster_id", "faces"), "cluster_id")
    top = F.slice(F.sort_array(F.collect_set("faces"), asc=False), 1, 10)
    found = per.groupBy("name").agg(F.count_if(F.col("cluster_id") >= 0).alias("clusters"), F.sum(F.when(F.col("cluster_id") >= 0, F.col("own"))).alias("faces"), F.array_join(top.cast("array<string>"), ",").alias("top_sizes"))
    return wanted.join(found, "name", "left").select("name", F.coalesce("clusters", F.lit(0)).cast("long").alias("clusters"), F.coalesce("faces", F.lit(0)).cast("long").alias("faces"), F.coalesce("top_sizes", F.lit("")).alias("top_sizes"))
