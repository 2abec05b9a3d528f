"""The gallery of clustered faces: order, captions, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parse
from ..sources.document import write_document
from .naming import NOISE, sizes


def cluster_order(rows: DataFrame) -> DataFrame:
    """cluster_id, label, badge, faces: largest first, equal sizes by their first face, noise last."""
    noise = F.col("cluster_id") == NOISE
    named = parse.present(F.col("predicted_name"))
    label = F.when(noise, F.lit("Noise / unassigned")).otherwise(F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string"), F.when(named, F.concat(F.lit(" — "), F.col("predicted_name"))).otherwise(F.lit(""))))
    badge = F.when(noise, F.lit("badge-noise")).when(named, F.lit("badge-named")).otherwise(F.lit("badge-unknown"))
    return sizes(rows).select("cluster_id", label.alias("label"), badge.alias("badge"), "faces", "first").orderBy(noise, F.desc("faces"), "first")


def captions(rows: DataFrame, photos: DataFrame) -> DataFrame:
    """Adds ``tooltip`` and ``person_name`` escaped for HTML, from the photo's own date (not the corrected one)."""
    p = photos.select(F.col("id").alias("photo_id"), "digikam_date", "folder_date")
    date = parse.display_date(F.col("digikam_date"), F.col("folder_date"))
    tip = parse.html_escape(parse.tooltip(F.col("person_name"), F.col("confidence"), date))
    return rows.join(p, "photo_id").withColumn("tooltip", tip).withColumn("caption", parse.html_escape(F.coalesce("person_name", F.lit("")))).drop("digikam_date", "folder_date")


def thumbs(rows: DataFrame) -> DataFrame:
    """Adds ``thumb``, the HTML of a face with a ``jpeg`` (binary); faces without one are not shown."""
    name = F.when(F.col("caption") != "", F.format_string("<figcaption>%s</figcaption>", "caption")).otherwise(F.lit(""))
    # one line each, as the document is written by lines
    figure = F.format_string('<figure title="%s"><img loading="lazy" alt="face" src="data:image/jpeg;base64,%s">%s</figure>', "tooltip", F.regexp_replace(F.base64("jpeg"), "[\\r\\n]", ""), name)
    return rows.where(F.col("jpeg").isNotNull()).withColumn("thumb", figure)


# fixed values: the classes that labels, badges and faces are shown with
STYLE = (
    "body{margin:0;padding:1rem 1.5rem;background:#111;color:#eee;font-family:sans-serif}.cluster{margin:.8rem 0;border:1px solid #333}"
    ".cluster summary{padding:.6rem 1rem;cursor:pointer}.badge{margin-left:.8rem;padding:.1rem .6rem;border-radius:1rem;font-size:.8rem}"
    ".badge-named{background:#246}.badge-unknown{background:#443}.badge-noise{background:#422}.grid{display:flex;flex-wrap:wrap;gap:6px;padding:10px}"
    "figure{margin:0;position:relative}figure img{width:140px;height:140px;object-fit:cover;display:block}figcaption{position:absolute;bottom:0;width:100%;font-size:.7rem;background:#000a}"
)


def document(rows: DataFrame) -> DataFrame:
    """``value``: the lines of the gallery as an HTML document, in order; images are inside as data URLs.

    A line opens the document with its style and totals, a line heads each cluster, a line shows each face. Lines are
    range-partitioned in gallery order, so no task or driver holds the gallery. A cluster without shown faces is left out,
    though its faces count in badges and totals.
    """
    shown = thumbs(rows)
    order = sizes(rows).join(shown.select("cluster_id").distinct(), "cluster_id", "left_semi")
    heads = cluster_order(rows).drop("first").join(order.select("cluster_id", F.col("first").alias("head")), "cluster_id")
    noise = F.col("cluster_id") == NOISE
    head = F.concat(F.lit("<details"), F.when(noise, F.lit("")).otherwise(F.lit(" open")), F.lit(' class="cluster"><summary>'), parse.html_escape(F.col("label")), F.lit(' <span class="badge '), F.col("badge"), F.lit('">'), F.col("faces").cast("string"), F.lit(' faces</span></summary><div class="grid">'))
    body, no_photo, no_face = F.lit(1).alias("part"), F.lit(None).cast("long").alias("photo_id"), F.lit(None).cast("int").alias("face_idx")
    key = [body, noise.alias("last"), (-F.col("faces")).alias("size"), F.col("head").alias("first")]
    lines = heads.select(*key, F.lit(0).alias("kind"), no_photo, no_face, head.alias("value"))
    lines = lines.unionByName(shown.join(heads.select("cluster_id", "faces", "head"), "cluster_id").select(*key, F.lit(1).alias("kind"), "photo_id", "face_idx", F.col("thumb").alias("value")))
    lines = lines.unionByName(heads.select(*key, F.lit(2).alias("kind"), no_photo, no_face, F.lit("</div></details>").alias("value")))
    # one row each
    totals = rows.agg(F.count_distinct(F.when(~noise, F.col("cluster_id"))).alias("clusters"), F.count("*").alias("faces")).crossJoin(F.broadcast(shown.agg(F.count("*").alias("rendered"))))
    told = F.concat_ws(" · ", *(F.concat(parse.thousands(F.col(c)), F.lit(f" {t}")) for c, t in (("clusters", "clusters"), ("faces", "faces"), ("rendered", "thumbnails rendered"))))
    opening = F.concat(F.lit(f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Cluster gallery</title><style>{STYLE}</style></head><body><h1>Cluster gallery</h1><p class="stats">'), told, F.lit("</p>"))
    for part, value in ((0, opening), (2, F.lit("</body></html>"))):
        lines = lines.unionByName(totals.select(F.lit(part).alias("part"), value.alias("value")), allowMissingColumns=True)
    return lines.orderBy("part", "last", "size", "first", "kind", "photo_id", "face_idx").select("value")


def write_pages(rows: DataFrame, folder: str) -> DataFrame:
    """Writes the gallery under ``folder``, where the part files in name order are the document, and returns the shown counts."""
    document(rows).write.mode("overwrite").text(folder)
    return rendered(rows)


def write_page(rows: DataFrame, path: str) -> DataFrame:
    """Writes the gallery as one file at ``path`` and returns the shown counts."""
    write_document(document(rows), path)
    return rendered(rows)


def rendered(rows: DataFrame) -> DataFrame:
    return thumbs(rows).groupBy("cluster_id").agg(F.count("*").alias("rendered"))
