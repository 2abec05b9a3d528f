"""Conflicting dates of a photo: flags, and the date to use."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, parse
from ..storage import written

# fixed values: the names of the sources in the flags, in their order
SOURCES = ("exif", "digikam", "filename", "folder")


@dataclass(frozen=True)
class Limits:
    """Bounds of a sane date, and days of difference that are a disagreement or a drift."""

    earliest: str = "1990-01-01"
    latest: str = "2030-01-01"
    disagree_days: int = 90
    drift_days: int = 30


def source_dates() -> dict[str, Column]:
    """The four dates as timestamps; a folder's date is its midnight."""
    return {s: F.col(f"{s}_date") if s != "folder" else dates.midnight(F.col("folder_date")) for s in SOURCES}


def available(rows: DataFrame) -> DataFrame:
    """Adds ``available``: array of struct(source, date) of the dates that are there."""
    found = [F.when(d.isNotNull(), F.struct(F.lit(s).alias("source"), d.alias("date"))) for s, d in source_dates().items()]
    return rows.withColumn("available", F.array_compact(F.array(*found)))


def flag_list(limits: Limits = Limits()) -> Column:
    """Flags in their order: bounds of the exif date, pairs that disagree, exif and folder that drift apart.

    Days are floored, then made positive, so the order within a pair matters.
    """
    d = source_dates()
    day = F.date_format(d["exif"], "yyyy-MM-dd")
    flags = [
        F.when(d["exif"] < F.lit(limits.earliest).cast("timestamp_ntz"), F.concat(F.lit("epoch_reset:exif="), day)).when(d["exif"] > F.lit(limits.latest).cast("timestamp_ntz"), F.concat(F.lit("future:exif="), day)),
    ]
    for a, b in combinations(SOURCES, 2):
        apart = dates.floor_days(d[a], d[b])
        flags.append(F.when(apart > limits.disagree_days, F.concat(F.lit(f"disagree:{a}↔{b}="), apart.cast("string"), F.lit("d"))))
    drift = dates.floor_days(d["exif"], d["folder"])
    flags.append(F.when((drift > limits.drift_days) & (drift <= limits.disagree_days), F.concat(F.lit("folder_drift:"), drift.cast("string"), F.lit("d"))))
    return F.when(F.coalesce(*d.values()).isNull(), F.array(F.lit("no_date"))).otherwise(F.array_compact(F.array(*flags)))


def flagged(rows: DataFrame, limits: Limits = Limits()) -> DataFrame:
    return rows.withColumn("datestamp_flags", flag_list(limits))


def upper_median(values: Column) -> Column:
    """Of n values in order, the one at n // 2."""
    ordered = F.array_sort(values)
    return F.when(F.size(values) > 0, F.get(ordered, F.floor(F.size(values) / 2).cast("int")))


def same_group(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of ``other`` for equal ``keys``; nulls are equal."""
    named = other.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(named, same).drop(*(f"_{k}" for k in keys))


def neighbour_medians(rows: DataFrame) -> DataFrame:
    """album_path, model, median: for each album and camera model the upper median of its clean exif dates.

    A flagged photo of a known model looks at clean photos of its album with that model or none; one of no known model at
    all of the album's. So each (album, model) group takes part in up to three groups. The middle is looked for by months,
    then by the days of its month, then by the times of its day, so a task orders the months of an album or the times of a
    day, however many photos an album has.
    """
    clean = rows.where((F.size("datestamp_flags") == 0) & F.col("exif_date").isNotNull())
    clean = clean.select("album_path", F.coalesce("camera_model", F.lit("")).alias("model"), "exif_date")
    # equal dates are counted first, so a group holds each date once
    counted = clean.groupBy("album_path", "model", "exif_date").agg(F.count("*").alias("n"))
    models = rows.where(F.size("datestamp_flags") > 0).select("album_path", F.coalesce("camera_model", F.lit("")).alias("for_model")).distinct()
    own = counted.join(models, (counted.album_path.eqNullSafe(models.album_path)) & ((models.for_model == counted.model) & (counted.model != "")))
    own = own.select(counted.album_path, "for_model", "exif_date", "n")
    unknown = counted.where("model = ''").join(models.where("for_model <> ''"), counted.album_path.eqNullSafe(models.album_path)).select(counted.album_path, "for_model", "exif_date", "n")
    every = counted.select("album_path", F.lit("").alias("for_model"), "exif_date", "n")
    merged = own.unionByName(unknown).unionByName(every).groupBy("album_path", "for_model", "exif_date").agg(F.sum("n").alias("n"))
    merged = written(merged.withColumn("day", F.to_date("exif_date")), "dates")
    group = ["album_path", "for_model"]
    days = merged.groupBy(*group, F.trunc("day", "month").alias("month"), "day").agg(F.sum("n").alias("n"))
    months = days.groupBy(*group, "month").agg(F.sum("n").alias("n"))
    # a row for each month of a group
    at = months.withColumn("before", F.floor(F.sum("n").over(Window.partitionBy(*group)) / 2))
    at = middle(at, group, "month")
    at = middle(same_group(days, at, [*group, "month"]), group, "day")
    # the day of each group: its times alone are ordered
    at = middle(same_group(merged, written(at, "middle"), [*group, "day"]), group, "exif_date")
    return at.select("album_path", F.col("for_model").alias("model"), F.col("exif_date").cast("timestamp_ntz").alias("median"))


def middle(rows: DataFrame, group: list[str], unit: str) -> DataFrame:
    """``group``, ``unit``, before: the unit in which more than ``before`` dates have been seen first, of ``rows`` with counts
    ``n``, and how many of its dates come before the middle."""
    held = rows.withColumn("upto", F.sum("n").over(Window.partitionBy(*group).orderBy(unit).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    held = held.where((F.col("upto") > F.col("before")) & (F.col("upto") - F.col("n") <= F.col("before")))
    return held.select(*group, unit, (F.col("before") - F.col("upto") + F.col("n")).alias("before"))


def corrected(rows: DataFrame) -> DataFrame:
    """Adds ``corrected_date`` to rows with ``datestamp_flags``.

    Clean: exif, database, folder. Flagged: the neighbours' median, folder, database. The file name's date only flags.
    """
    medians = neighbour_medians(rows).withColumnRenamed("album_path", "_album").withColumnRenamed("model", "_model")
    at = rows.album_path.eqNullSafe(medians["_album"]) & (F.coalesce(rows.camera_model, F.lit("")) == medians["_model"])
    d = source_dates()
    date = F.when(F.size("datestamp_flags") == 0, F.coalesce(d["exif"], d["digikam"], d["folder"])).otherwise(F.coalesce("median", d["folder"], d["digikam"]))
    return rows.join(medians, at, "left").withColumn("corrected_date", date).select(*rows.columns, "corrected_date")


def annotated(rows: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Flags for all photos, then corrected dates for all."""
    return corrected(written(flagged(rows, limits), "flagged"))


def report(rows: DataFrame, *, show_clean: bool = False, limit: int = 100) -> DataFrame:
    """The first ``limit`` anomalies of the listing, as shown to people."""
    shown = rows if show_clean else rows.where(F.size("datestamp_flags") > 0)
    shown = shown.orderBy(F.col("album_path").asc_nulls_first(), F.col("filename").asc_nulls_first(), "id").limit(limit)
    day = lambda c: parse.or_dash(F.date_format(c, "yyyy-MM-dd"))
    flags = F.when(F.size("datestamp_flags") > 0, F.array_join("datestamp_flags", "; ")).otherwise(F.lit("clean"))
    return shown.select("id", "filename", "album_path", day("exif_date").alias("exif_date"), day("folder_date").alias("folder_date"), flags.alias("flags"), day("corrected_date").alias("corrected_date"))
