"""Crops of faces from the image files of their photos, with a fallback to thumbnails."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors

#: Fixed values of the gallery: the largest side of a shown face in pixels, and its JPEG quality.
LARGEST, QUALITY = 140, 80
#: Bytes and rows of crops that a task gathers before it passes them on.
BATCH_BYTES, BATCH_ROWS = 16 << 20, 10_000
#: By how much of its sides a face's rectangle is widened on each side.
PADDING = 0.3


@dataclass(frozen=True)
class Codec:
    """How images are opened, measured and cut: ``decode(bytes)``, ``size(image)`` -> (width, height), ``cut(image, box)`` -> bytes.

    ``thumb(image, box, largest, quality)`` -> bytes cuts the box and shrinks it to a largest side, at a JPEG quality; without
    it the cut itself is shown.
    """

    decode: Callable[[bytes], Any]
    size: Callable[[Any], tuple[int, int]]
    cut: Callable[[Any, tuple[int, int, int, int]], bytes | None]
    thumb: Callable[[Any, tuple[int, int, int, int], int, int], bytes | None] | None = None


def read_file(path: str) -> bytes | None:
    """A file's bytes, by a path or a URI that Arrow knows; None if there is none."""
    try:
        system, name = fs.FileSystem.from_uri(path)
        with system.open_input_stream(name) as f:
            return f.read()
    except (OSError, ValueError):
        return None


def with_faces(faces: DataFrame, photos: DataFrame, files: DataFrame | None, thumbnails: DataFrame | None) -> DataFrame:
    """photo_id, full_path, faces, content, data: a row per photo with faces, its file's bytes and its thumbnail's, if any.

    A thumbnail is that of (unique_hash, file_size), where an empty hash or size 0 finds none. ``files(full_path, content)`` is
    a table of files; without it ``content`` is NULL, and files are read by their path where images are cut.
    """
    spark = faces.sparkSession
    # a photo's faces are its unit
    on = faces.groupBy("photo_id").agg(F.collect_list(F.struct("face_idx", "x", "y", "width", "height")).alias("faces"))
    rows = photos.select(F.col("id").alias("photo_id"), "full_path", F.nullif("unique_hash", F.lit("")).alias("unique_hash"), F.nullif("file_size", F.lit(0)).alias("file_size")).join(on, "photo_id")
    none = F.lit(None).cast("binary")
    rows = rows.withColumn("content", none) if files is None else rows.join(files.select("full_path", "content"), "full_path", "left")
    rows = rows.withColumn("data", none) if thumbnails is None else rows.join(thumbnails.select("unique_hash", "file_size", "data"), ["unique_hash", "file_size"], "left")
    rows = rows.select("photo_id", "full_path", "faces", "content", "data")
    if files is None:
        # a row is a path, but its work is an image
        rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows


def cuts(batches: Iterator[pa.RecordBatch], codec: Codec, by_path: bool, padding: float, shown: tuple[int, int] | None = None) -> Iterator[tuple]:
    """photo_id, face_idx, crop, jpeg of rows of :func:`with_faces`, inside a task: one image at a time, opened once.

    ``shown``: the largest side and quality of the jpeg; None leaves it out.
    """

    def opened(path: str | None, content: pa.Scalar, data: pa.Scalar) -> Any:
        for get in (lambda: read_file(path) if by_path and path else content.as_py(), data.as_py):
            found = get()
            if found is not None:
                try:
                    image = codec.decode(found)
                    if image is not None:
                        return image
                except Exception:  # any codec's error means an unreadable image
                    continue
        return None

    for batch in batches:
        lists, column = batch.column("faces"), batch.column
        ends = lists.offsets.to_pylist()
        flat = lists.values.slice(ends[0], ends[-1] - ends[0])
        found = list(zip(*(flat.field(n).to_pylist() for n in ("face_idx", "x", "y", "width", "height")), strict=True))
        for k, (photo_id, path) in enumerate(zip(column("photo_id").to_pylist(), column("full_path").to_pylist(), strict=True)):
            image = opened(path, column("content")[k], column("data")[k])
            if image is None:
                continue
            try:
                wide, high = codec.size(image)
            except Exception:  # an image without a size is unreadable
                continue
            for face_idx, x, y, width, height in found[ends[k] - ends[0] : ends[k + 1] - ends[0]]:
                try:
                    px, py = int(width * padding), int(height * padding)
                    box = (max(0, x - px), max(0, y - py), min(wide, x + width + px), min(high, y + height + py))
                    if box[2] - box[0] < 4 or box[3] - box[1] < 4:
                        continue
                    crop = codec.cut(image, box)
                    jpeg = None if shown is None else codec.thumb(image, box, *shown) if codec.thumb else crop
                except Exception:  # the face is left out, its neighbours stay
                    continue
                if crop is not None:
                    yield photo_id, face_idx, crop, jpeg


def crops(faces: DataFrame, photos: DataFrame, files: DataFrame | None, thumbnails: DataFrame | None, codec: Codec, padding: float = PADDING, largest: int = LARGEST, quality: int = QUALITY) -> DataFrame:
    """photo_id, face_idx, crop, jpeg: each padded face cut from its image, and as it is shown; unreadable or tiny ones go.

    An image is the photo's file; if there is none, or it cannot be opened, the thumbnail. Files and thumbnails as in
    :func:`with_faces`; without ``files`` a task reads the files of its photos by their ``full_path``, one at a time, and only
    of photos with faces. An image is opened once for all its faces. Rectangles apply unscaled, whether the image is a file or
    a thumbnail.
    """
    by_path = files is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for row in cuts(batches, codec, by_path, padding, (largest, quality)):
            out.append(row)
            held += len(row[2]) + len(row[3] or b"")
            if held >= BATCH_BYTES or len(out) >= BATCH_ROWS:
                yield frame(out)
                out, held = [], 0
        yield frame(out)

    def frame(out: list[tuple]) -> pa.RecordBatch:
        kinds = {"photo_id": pa.int64(), "face_idx": pa.int32(), "crop": pa.binary(), "jpeg": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds.values())], list(kinds))

    return with_faces(faces, photos, files, thumbnails).mapInArrow(run, "photo_id long, face_idx int, crop binary, jpeg binary")


def crop_boxes(faces: DataFrame, photos: DataFrame, padding: float = 0.3) -> DataFrame:
    """Adds ``box`` from the photos' recorded sizes; NULL where the crop would be empty or under 4 pixels."""
    sized = photos.select(F.col("id").alias("photo_id"), F.col("width").alias("_w"), F.col("height").alias("_h"))
    box = vectors.crop_box(F.col("x"), F.col("y"), F.col("width"), F.col("height"), F.col("_w"), F.col("_h"), padding)
    return faces.join(sized, "photo_id").withColumn("box", box).drop("_w", "_h")
