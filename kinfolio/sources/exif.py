"""Capture dates and cameras from the EXIF block of image files."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parse

# fixed values of the EXIF standard: tags and sizes of types
MAKE, MODEL, DATE_TIME, EXIF_IFD, ORIGINAL, DIGITIZED = 0x010F, 0x0110, 0x0132, 0x8769, 0x9003, 0x9004
WANTED = (ORIGINAL, DIGITIZED, DATE_TIME, MAKE, MODEL)
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


class Ranges:
    """A file that is read where it is sliced; ``read`` counts the bytes."""

    def __init__(self, file: Any) -> None:
        self.file, self.size, self.read = file, file.size(), 0

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> bytes:
        start, stop, _ = part.indices(self.size)
        self.file.seek(start)
        found = self.file.read(max(0, stop - start))
        self.read += len(found)
        return found


def tiff_block(data: bytes | Ranges) -> bytes | Ranges | None:
    """The TIFF structure of a JPEG's APP1 segment, or of a TIFF file. Of a JPEG the heads of segments are read up to it."""
    start = data[:4]
    if start in (b"II*\0", b"MM\0*"):
        return data
    if start[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(data):
        head = data[at : at + 10]
        length = struct.unpack(">H", head[2:4])[0]
        if head[0] != 0xFF or head[1] == 0xDA:
            return None
        if head[1] == 0xE1 and head[4:] == b"Exif\0\0":
            return data[at + 10 : at + 2 + length]
        at += 2 + length
    return None


def texts(block: bytes | Ranges) -> dict[int, str]:
    """The ASCII tags of the first image directory and its EXIF directory."""
    order = "<" if block[:2] == b"II" else ">"
    found: dict[int, str] = {}
    todo, seen = [struct.unpack(order + "I", block[4:8])[0]], set()
    while todo:
        at = todo.pop()
        if at in seen or at + 2 > len(block):
            continue
        seen.add(at)
        for k in range(struct.unpack(order + "H", block[at : at + 2])[0]):
            entry = block[at + 2 + 12 * k : at + 14 + 12 * k]
            if len(entry) < 12:
                break
            tag, kind, count = struct.unpack(order + "HHI", entry[:8])
            size = SIZES.get(kind, 0) * count
            value = struct.unpack(order + "I", entry[8:12])[0]
            if tag == EXIF_IFD:
                todo.append(value)
            elif kind == 2 and tag in WANTED:
                raw = entry[8 : 8 + size] if size <= 4 else block[value : value + size]
                found.setdefault(tag, raw.split(b"\0")[0].decode("utf-8", "replace"))
    return found


def tags_of(data: bytes | Ranges | None) -> tuple[str | None, ...]:
    """The values of WANTED; what cannot be read is None."""
    try:
        block = tiff_block(data) if data is not None else None
        tags = texts(block) if block else {}
    except (struct.error, IndexError, OSError):
        tags = {}
    return tuple(tags.get(t) for t in WANTED)


def tags_in(path: str) -> tuple[str | None, ...]:
    """The same of a file, by byte ranges of it: the heads of segments and the EXIF block, never the whole content."""
    try:
        system, name = fs.FileSystem.from_uri(path)
        with system.open_input_file(name) as f:
            return tags_of(Ranges(f))
    except (OSError, ValueError):
        return tags_of(None)


TAGS = "path string, original string, digitized string, image string, make string, model string"


def read_exif(paths: DataFrame) -> DataFrame:
    """full_path, date, make, model of the image files at ``paths(full_path)``; what cannot be read is NULL.

    Only files that are asked for are opened, each once, in many tasks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(p, *tags_in(p)) for p in pdf["path"]], columns=[c.split()[0] for c in TAGS.split(", ")], dtype=object)

    asked = paths.select(F.col("full_path").alias("path")).where("path IS NOT NULL").distinct()
    return dated(asked.repartition(int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInPandas(run, TAGS))


def from_files(files: DataFrame) -> DataFrame:
    """The same from ``files(path, content)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(path, *tags_of(None if data is None else bytes(data))) for path, data in zip(pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in TAGS.split(", ")], dtype=object)

    return dated(files.select("path", "content").mapInPandas(run, TAGS))


def dated(tags: DataFrame) -> DataFrame:
    date = parse.exif_tags_date(F.col("original"), F.col("digitized"), F.col("image"))
    path = F.regexp_replace(F.col("path"), "^file:/+", "/")
    return tags.select(path.alias("full_path"), date.alias("date"), F.trim("make").alias("make"), F.trim("model").alias("model"))
