"""Counts over a library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parse import present


def database_summary(photos: DataFrame, faces: DataFrame, identities: DataFrame) -> DataFrame:
    """metric, value: photos(id, album_path), faces(photo_id, person_name), identities(id, vectors: how many each has)."""
    p = photos.agg(F.count("*").alias("total_photos"), F.count_distinct("album_path").alias("albums"))
    f = faces.agg(F.count_distinct("photo_id").alias("photos_with_faces"), F.count("*").alias("face_regions"), F.count_if(present(F.col("person_name"))).alias("tagged_regions"))
    i = identities.agg(F.count("*").alias("known_identities"), F.coalesce(F.sum("vectors"), F.lit(0)).alias("identity_vectors"))
    one = p.crossJoin(F.broadcast(f)).crossJoin(F.broadcast(i))  # one row each
    return one.unpivot([], [c for c in one.columns], "metric", "value").select("metric", F.col("value").cast("long").alias("value"))


def top_people(faces: DataFrame, n: int = 10) -> DataFrame:
    """person_name, faces of the ``n`` most tagged people; of equals, the first met in (photo_ord, face_idx) order."""
    counts = faces.where(present(F.col("person_name"))).groupBy("person_name").agg(F.count("*").alias("faces"), F.min(F.struct("photo_ord", "face_idx")).alias("first"))
    return counts.orderBy(F.desc("faces"), "first").limit(n).select("person_name", "faces")
