"""Similarities, features and centroids of face vectors.

Faces are rows of (photo_id, face_idx, embedding); centroids of (identity_id, centroid).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, vectors
from ..storage import written

#: Centroids that are sent to every task, one row each of a vector: beyond, they are dealt to tasks in blocks.
BROADCAST_CENTROIDS = 10_000
#: Faces and centroids that meet in a task beyond that.
BLOCK = 4096
#: Rows of each side whose pairs one task makes, where all pairs are asked for.
PAIR_BLOCK = 1024


def mean_vector(rows: DataFrame, key: str, vector: str = "embedding", *, unit: bool = False) -> DataFrame:
    """key, centroid: the mean of a key's vectors by position, to unit length if asked. No group is collected."""
    parts = rows.select(key, F.posexplode(vectors.doubles(F.col(vector))).alias("pos", "x")).groupBy(key, "pos").agg(F.avg("x").alias("x"))
    whole = parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"))
    return whole.withColumn("centroid", vectors.l2_normalize(F.col("centroid"))) if unit else whole


def first_per_identity(rows: DataFrame, key: str, order: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each key: the cap on the crops that make a centroid."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")


def identity_centroids(rows: DataFrame, key: str, order: list[str], max_per_identity: int = 20) -> DataFrame:
    """Unit centroids of at most ``max_per_identity`` vectors each. The cap comes before unusable (null) vectors go."""
    capped = first_per_identity(rows, key, order, max_per_identity).where(F.col("embedding").isNotNull())
    return mean_vector(capped, key, unit=True)


def met_in_blocks(a: DataFrame, b: DataFrame, sigma: float | None, least: float | None) -> DataFrame:
    """i, j, similarity of a(i, va[, ta]) and b(j, vb[, tb]): blocks of both sides meet in a task each, as matrices.

    A block is ``PAIR_BLOCK`` rows, so a task holds that many pairs squared; with ``least`` only pairs that reach it leave it.
    A null vector or time gives a null similarity.
    """
    lots, cuts = max(1, math.ceil(a.count() / PAIR_BLOCK)), max(1, math.ceil(b.count() / PAIR_BLOCK))
    a = a.withColumn("_lot", F.pmod(F.xxhash64("i"), F.lit(lots)).cast("int")).withColumn("_cut", F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))))
    b = b.withColumn("_cut", F.pmod(F.xxhash64("j"), F.lit(cuts)).cast("int")).withColumn("_lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
    kinds = {c: (a if c == "i" else b).schema[c].dataType.simpleString() for c in ("i", "j")}

    def matrix(s: pd.Series) -> np.ndarray:
        width = max((len(v) for v in s if v is not None), default=0)
        return np.stack([np.full(width, np.nan) if v is None else np.asarray(v, float) for v in s])

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"i": x["i"].iloc[:0], "j": y["j"].iloc[:0], "similarity": []})
        found = matrix(x["va"]) @ matrix(y["vb"]).T
        if sigma is not None:
            gap = x["ta"].to_numpy(float)[:, None] - y["tb"].to_numpy(float)[None, :]
            found *= np.exp(-(gap * gap) / (2.0 * sigma * sigma))
        p, q = np.indices(found.shape).reshape(2, -1) if least is None else np.nonzero(found >= least)
        return pd.DataFrame({"i": x["i"].to_numpy()[p], "j": y["j"].to_numpy()[q], "similarity": found[p, q]})

    key = ("_lot", "_cut")
    return a.groupBy(*key).cogroup(b.groupBy(*key)).applyInPandas(meet, f"i {kinds['i']}, j {kinds['j']}, similarity double")


def pairwise(a: DataFrame, b: DataFrame, sigma: float | None, least: float | None) -> DataFrame:
    """i, j, similarity for each row of ``a`` with each of ``b``: the operator's result is that table, or its pairs that reach
    ``least``. ``b`` is counted: up to BROADCAST_CENTROIDS of its rows are sent to every task, more meet ``a`` in blocks."""
    if b.count() > BROADCAST_CENTROIDS:
        return met_in_blocks(a, b, sigma, least)
    value = vectors.dot(F.col("va"), F.col("vb"))
    value = value if sigma is None else vectors.fused(value, F.col("ta"), F.col("tb"), sigma)
    met = a.crossJoin(F.broadcast(b)).select("i", "j", value.alias("similarity"))
    return met if least is None else met.where(F.col("similarity") >= least)


def pairwise_cosine(a: DataFrame, b: DataFrame, least: float | None = None) -> DataFrame:
    """a(i, va) and b(j, vb): i, j, similarity."""
    x = a.select("i", vectors.l2_normalize(F.col("va")).alias("va"))
    y = b.select("j", vectors.l2_normalize(F.col("vb")).alias("vb"))
    return pairwise(x, y, None, least)


def fused_similarity(a: DataFrame, b: DataFrame, temporal_sigma: float = 30.0, least: float | None = None) -> DataFrame:
    """a(i, va, ta) and b(j, vb, tb), times in days: i, j, cosine fading with distance in time."""
    x = a.select("i", vectors.l2_normalize(F.col("va")).alias("va"), F.col("ta").cast("double").alias("ta"))
    y = b.select("j", vectors.l2_normalize(F.col("vb")).alias("vb"), F.col("tb").cast("double").alias("tb"))
    return pairwise(x, y, temporal_sigma, least)


def with_days(faces: DataFrame, photos: DataFrame) -> DataFrame:
    """Adds ``days`` of the photo's corrected date; a face without photo or date counts as day 0."""
    when = photos.select(F.col("id").alias("photo_id"), F.col("corrected_date").alias("_date"))
    return faces.join(when, "photo_id", "left").withColumn("days", dates.days_since_2000(F.col("_date"))).drop("_date")


def days_mean(faces: DataFrame) -> DataFrame:
    """One row: the mean of ``days`` over all faces."""
    return faces.agg(F.avg("days").alias("days_mean"))


def time_feature(days: Column, mean: Column, sigma: float, weight: float) -> Column:
    return (days - mean) / F.lit(sigma) * F.lit(weight)


def feature_matrix(faces: DataFrame, temporal_weight: float = 0.15, temporal_sigma: float = 30.0) -> DataFrame:
    """Adds ``features``: the unit vector, and the weighed time if ``temporal_sigma`` > 0. ``faces`` has ``days``."""
    unit = vectors.l2_normalize(F.col("embedding"))
    if temporal_sigma <= 0:
        return faces.withColumn("features", unit)
    rows = faces.crossJoin(F.broadcast(days_mean(faces)))  # one row
    return rows.withColumn("features", F.concat(unit, F.array(time_feature(F.col("days"), F.col("days_mean"), temporal_sigma, temporal_weight)))).drop("days_mean")


def seed_rows(centroids: DataFrame, identities: DataFrame, named_days: DataFrame, faces: DataFrame, temporal_weight: float = 0.15, temporal_sigma: float = 30.0) -> DataFrame:
    """identity_id, features of each centroid, in the space of :func:`feature_matrix` of ``faces``.

    Its time is the mean of ``named_days(person_name, days)`` over the faces of its name, else the mean of all.
    """
    unit = vectors.l2_normalize(F.col("centroid"))
    rows = centroids.join(identities.select(F.col("id").alias("identity_id"), "name"), "identity_id", "left")
    if temporal_sigma <= 0:
        return rows.select("identity_id", unit.alias("features"))
    means = named_days.where(F.coalesce("person_name", F.lit("")) != "").groupBy("person_name").agg(F.avg("days").alias("person_days"))
    rows = rows.join(means, rows.name == means.person_name, "left").crossJoin(F.broadcast(days_mean(faces)))  # one row
    time = time_feature(F.coalesce("person_days", "days_mean"), F.col("days_mean"), temporal_sigma, temporal_weight)
    return rows.select("identity_id", F.concat(unit, F.array(time)).alias("features"))


def pca(rows: DataFrame, dims: int, fit_on: Column | None = None) -> DataFrame:
    """``features`` on the first ``dims`` principal components of the rows where ``fit_on`` holds (all, by default).

    Unchanged unless 0 < dims < length. Components are not centred, which moves all points alike.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    head = rows.select(F.size("features").alias("n")).first()
    if head is None or not 0 < dims < head.n:
        return rows
    ready = rows.withColumn("_v", array_to_vector(vectors.doubles(F.col("features"))))
    model = PCA(k=dims, inputCol="_v", outputCol="_p").fit(ready.where(fit_on) if fit_on is not None else ready)
    return model.transform(ready).withColumn("features", vector_to_array("_p")).drop("_v", "_p")


def nearest(faces: DataFrame, centroids: DataFrame) -> DataFrame:
    """Adds ``identity_id`` and ``similarity`` of the nearest centroid, ties to the smaller id.

    Few centroids (the count is checked) go to every task as a matrix; of more, blocks of BLOCK meet lots of as many faces and
    each face keeps its best.
    """
    centroids = written(centroids, "centroids")
    n = centroids.count()
    kept = [c for c in faces.columns if c not in ("identity_id", "similarity")]
    unit = faces.select(*kept, vectors.l2_normalize(F.col("embedding")).alias("_u"))
    if n <= BROADCAST_CENTROIDS:
        rows = centroids.select("identity_id", vectors.l2_normalize(F.col("centroid")).alias("c")).toPandas().sort_values("identity_id")  # at most BROADCAST_CENTROIDS
        if not len(rows):
            return unit.drop("_u").withColumn("identity_id", F.lit(None).cast("long")).withColumn("similarity", F.lit(None).cast("double"))
        sent = faces.sparkSession.sparkContext.broadcast((rows["identity_id"].to_numpy(), np.stack([np.asarray(c, float) for c in rows["c"]])))

        @F.pandas_udf("struct<identity_id: long, similarity: double>")
        def best(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            ids, c = sent.value
            for s in batches:
                x = np.stack([np.asarray(v, float) for v in s]) if len(s) else np.zeros((0, c.shape[1]))
                sims = x @ c.T
                k = sims.argmax(axis=1) if len(s) else np.zeros(0, int)
                yield pd.DataFrame({"identity_id": ids[k], "similarity": sims[np.arange(len(k)), k]})

        return unit.withColumn("_b", best("_u")).select(*kept, "_b.identity_id", "_b.similarity")
    blocks, lots = max(1, math.ceil(n / BLOCK)), max(1, math.ceil(faces.count() / BLOCK))
    mine = unit.select("photo_id", "face_idx", "_u").withColumn("_lot", F.pmod(F.xxhash64("photo_id", "face_idx"), F.lit(lots)).cast("int")).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    theirs = centroids.select("identity_id", vectors.l2_normalize(F.col("centroid")).alias("_c")).withColumn("_block", F.pmod(F.xxhash64("identity_id"), F.lit(blocks)).cast("int")).withColumn("_lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))

    def meet(x: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(c):
            return pd.DataFrame({"photo_id": [], "face_idx": [], "identity_id": [], "similarity": []})
        c = c.sort_values("identity_id")
        sims = np.stack([np.asarray(v, float) for v in x["_u"]]) @ np.stack([np.asarray(v, float) for v in c["_c"]]).T
        k = sims.argmax(axis=1)
        return pd.DataFrame({"photo_id": x["photo_id"].to_numpy(), "face_idx": x["face_idx"].to_numpy(), "identity_id": c["identity_id"].to_numpy()[k], "similarity": sims[np.arange(len(k)), k]})

    met = mine.groupBy("_lot", "_block").cogroup(theirs.groupBy("_lot", "_block")).applyInPandas(meet, "photo_id long, face_idx int, identity_id long, similarity double")
    top = met.groupBy("photo_id", "face_idx").agg(F.max(F.struct("similarity", (-F.col("identity_id")).alias("_i"))).alias("_b"))
    return faces.join(top, ["photo_id", "face_idx"]).select(*kept, (-F.col("_b._i")).alias("identity_id"), "_b.similarity")
