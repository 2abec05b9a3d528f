"""Command line: ``python -m kinfolio.cli inspect-db|detect-datestamps|cluster``."""

from __future__ import annotations

import argparse
import importlib
import math
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import assign, clustering, datestamps, gallery, naming, photos, reports, similarity
from .session import session
from .sources import exif, images, sqlite
from .storage import written


def library(spark: SparkSession, path: str, root: str | None) -> tuple[DataFrame, DataFrame]:
    """Photos with their place in the listing, and faces."""
    t = lambda name: sqlite.read_table(spark, path, name)
    rows = photos.photos(t("Images"), t("Albums"), t("ImageInformation"), t("ImageMetadata"), photos.album_root(t("AlbumRoots"), root))
    return rows, photos.faces(t("ImageTagProperties"), t("Tags"))


def identities(spark: SparkSession, path: str) -> DataFrame:
    return photos.identities(sqlite.read_table(spark, path, "IdentityAttributes"), sqlite.read_table(spark, path, "FaceMatrices"))


def inspect_db(spark: SparkSession, args: argparse.Namespace) -> None:
    from .operators.ordinal import with_ordinal

    rows, faces = library(spark, args.db, args.photo_root)
    counted = photos.vector_counts(sqlite.read_table(spark, args.recognition_db, "IdentityAttributes"), sqlite.read_table(spark, args.recognition_db, "FaceMatrices"))
    reports.database_summary(rows, faces, counted).show(truncate=False)
    placed = faces.join(with_ordinal(rows.select("id", "album_path", "filename"), photos.listing_order(), "photo_ord").select(F.col("id").alias("photo_id"), "photo_ord"), "photo_id")
    reports.top_people(placed).show(truncate=False)


def detect_datestamps(spark: SparkSession, args: argparse.Namespace) -> None:
    rows, _ = library(spark, args.db, args.photo_root)
    rows = photos.first_photos(rows, args.limit)
    if args.photo_root:
        rows = photos.fill_exif(rows, exif.read_exif(rows.select("full_path")))
    rows = written(datestamps.annotated(rows), "annotated")
    rows.agg(F.count_if(F.size("datestamp_flags") > 0).alias("flagged"), F.count("*").alias("photos")).show()
    datestamps.report(rows, show_clean=args.show_clean).show(100, truncate=30)


def loaded(name: str) -> Any:
    """``module:attribute``, imported: codecs and models are the caller's."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def cluster(spark: SparkSession, args: argparse.Namespace) -> None:
    rows, faces = library(spark, args.db, args.photo_root)
    rows = written(datestamps.annotated(photos.first_photos(rows, args.limit)), "annotated")
    known = identities(spark, args.recognition_db)
    compute, cut = None, None
    if args.codec and args.embedder:
        codec, load = loaded(args.codec), loaded(args.embedder)
        t = lambda name: sqlite.read_table(spark, args.thumbnails_db, name)
        thumbnails = photos.thumbnails(t("UniqueHashes"), t("Thumbnails")) if args.thumbnails_db else None
        compute = (None, thumbnails, codec, load)
    if args.load_embeddings:
        embeddings = spark.read.parquet(args.load_embeddings)
    elif compute:
        cut = written(images.crops(faces, rows, None, thumbnails, codec), "crops")
        embeddings = written(assign.embed(cut, load), "embeddings")
    else:
        raise SystemExit("cluster needs --load-embeddings, or --codec and --embedder")
    if args.save_embeddings:
        embeddings.write.mode("overwrite").parquet(args.save_embeddings)
    centroids = None
    if args.semi_supervised:
        if compute:
            every, _ = library(spark, args.db, args.photo_root)
            centroids = assign.crop_centroids(faces, known, every, *compute, max_per_identity=args.max_seeds)
        else:
            tagged = assign.tagged_faces(faces.join(embeddings, ["photo_id", "face_idx"], "left"), known)
            centroids = similarity.identity_centroids(tagged, "identity_id", ["photo_id", "face_idx"], args.max_seeds)
        centroids = written(centroids, "centroids")
        naming.seeded_names(centroids, known).show(truncate=False)
        more = centroids.count() - naming.SEEDED_NAMES
        if more > 0:
            print(f"(+{more} more)")
    if args.nearest_centroid:
        if centroids is None:
            raise SystemExit("--nearest-centroid requires --semi-supervised")
        named = faces.select("photo_id", "face_idx", "person_name").join(rows.select(F.col("id").alias("photo_id")), "photo_id", "left_semi")
        found = assign.nearest_centroid(embeddings, known, centroids, named, args.min_similarity)
    else:
        found = clustering.clustered(rows, faces, embeddings, known, centroids, temporal_sigma=args.temporal_sigma, min_cluster_size=args.min_cluster, pca_dims=args.pca_dims, epsilon=args.cluster_epsilon, cut=args.cut_distance, labelled=args.labelled_seeds)
    found = written(found, "results")
    # a line a cluster, as many as there are; fetched a partition at a time
    print("cluster_id\tfaces\tassigned_name")
    for r in naming.summary(found).orderBy("cluster_id").toLocalIterator():
        print(r.cluster_id, r.faces, r.assigned_name, sep="\t")
    naming.breakdown(found, list(args.baby_names)).show(truncate=False)
    if args.export_html:
        shown = gallery.captions(found, rows)
        crops = spark.read.parquet(args.crops) if args.crops else shown.select("photo_id", "face_idx", F.lit(None).cast("binary").alias("jpeg")).limit(0)
        if compute and not args.crops:
            # cut once for the model and the gallery
            crops = (cut if cut is not None else images.crops(faces, rows, None, thumbnails, codec)).select("photo_id", "face_idx", "jpeg")
        gallery.write_page(written(shown.join(crops, ["photo_id", "face_idx"], "left"), "shown"), args.export_html).agg(F.sum("rendered").alias("rendered")).show()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kinfolio")
    sub = p.add_subparsers(dest="command", required=True)
    inspect, detect, clu = (sub.add_parser(n) for n in ("inspect-db", "detect-datestamps", "cluster"))
    for s in (inspect, detect, clu):
        s.add_argument("--db", required=True)
        s.add_argument("--photo-root")
    for s in (inspect, clu):
        s.add_argument("--recognition-db", required=True)
    detect.add_argument("--limit", type=int, default=0)
    detect.add_argument("--show-clean", action="store_true")
    clu.add_argument("--load-embeddings", help="Parquet of photo_id, face_idx, embedding; without it they are computed")
    clu.add_argument("--codec", help="module:name of an assign.Codec that opens and cuts images")
    clu.add_argument("--embedder", help="module:name of a function that loads a model: list of crops -> array of vectors")
    clu.add_argument("--thumbnails-db", help="SQLite of thumbnails for photos that are not under --photo-root")
    clu.add_argument("--save-embeddings")
    clu.add_argument("--limit", type=int, default=500)
    clu.add_argument("--min-cluster", type=int, default=3)
    clu.add_argument("--temporal-sigma", type=float, default=30.0)
    clu.add_argument("--semi-supervised", action="store_true")
    clu.add_argument("--max-seeds", type=int, default=20)
    clu.add_argument("--pca-dims", type=int, default=0)
    clu.add_argument("--cluster-epsilon", type=float, default=0.0)
    clu.add_argument("--cut-distance", type=float, default=math.inf, help="faces farther apart never share a cluster; set it for large libraries")
    clu.add_argument("--labelled-seeds", action="store_true", help="with --semi-supervised: no cluster holds the seeds of two identities")
    clu.add_argument("--nearest-centroid", action="store_true")
    clu.add_argument("--min-similarity", type=float, default=0.5)
    clu.add_argument("--baby-names", action="append", required=True)
    clu.add_argument("--export-html", help="the gallery as one HTML file")
    clu.add_argument("--crops", help="Parquet of photo_id, face_idx, jpeg")
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    {"inspect-db": inspect_db, "detect-datestamps": detect_datestamps, "cluster": cluster}[args.command](spark or session(), args)


if __name__ == "__main__":
    main()
