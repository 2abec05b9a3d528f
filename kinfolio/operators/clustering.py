"""Faces grouped by identity: features, seeds, density clusters, names."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written
from . import hdbscan, naming, similarity
from .ordinal import with_ordinal


def clustered(
    photos: DataFrame,
    faces: DataFrame,
    embeddings: DataFrame,
    identities: DataFrame,
    centroids: DataFrame | None = None,
    *,
    temporal_sigma: float = 30.0,
    temporal_weight: float = 0.15,
    min_cluster_size: int = 3,
    min_samples: int = 2,
    pca_dims: int = 0,
    epsilon: float = 0.0,
    cut: float = math.inf,
    labelled: bool = False,
) -> DataFrame:
    """photo_id, face_idx, person_name, cluster_id, predicted_name, confidence of each embedded face of ``photos``.

    ``photos(id, corrected_date)``, ``faces(photo_id, face_idx, person_name)``, ``embeddings(photo_id, face_idx, embedding)``,
    ``identities(id, name)``. ``centroids(identity_id, centroid)`` join the points as seeds: they draw near faces into one
    cluster and name it if no tag does and no second seed is in it. Seeds take no part in the principal components and are
    not returned. Vectors of photos that are not listed form clusters too, but are not returned. ``labelled`` keeps seeds of
    two identities out of one cluster, which is split, so that each seed names its own.
    """
    named = faces.select("photo_id", "face_idx", "person_name").join(photos.select(F.col("id").alias("photo_id")), "photo_id", "left_semi")
    dated = similarity.with_days(embeddings.select("photo_id", "face_idx", "embedding"), photos)
    no_id = F.lit(None).cast("long")
    points = similarity.feature_matrix(dated, temporal_weight, temporal_sigma).select("photo_id", "face_idx", no_id.alias("identity_id"), "features")
    if centroids is not None:
        days = similarity.with_days(named, photos).select("person_name", "days")
        seeds = similarity.seed_rows(centroids, identities, days, dated, temporal_weight, temporal_sigma)
        points = points.unionByName(seeds.select(no_id.alias("photo_id"), F.lit(None).cast("int").alias("face_idx"), "identity_id", "features"))
    points = similarity.pca(points, pca_dims, F.col("identity_id").isNull())
    points = written(with_ordinal(points, [F.col("photo_id").asc_nulls_last(), F.col("face_idx"), F.col("identity_id")], "point"), "points")
    labels = hdbscan.cluster(points.select("point", "features", F.col("identity_id").alias("identity")), cut=cut, min_cluster_size=min_cluster_size, min_samples=min_samples, epsilon=epsilon, labelled=labelled)
    found = written(points.drop("features").join(labels, "point"), "clusters")
    real = found.where("identity_id IS NULL").select("photo_id", "face_idx", "cluster_id").join(named, ["photo_id", "face_idx"])
    seeded = naming.seed_names(found.where("identity_id IS NOT NULL"), identities) if centroids is not None else None
    return naming.named(real, naming.majority_names(real), seeded)
