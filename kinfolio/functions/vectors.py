"""Vectors as arrays, accumulated in doubles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

#: Vectors shorter than this are divided by it, so that a zero vector stays zero.
FLOOR = 1e-12


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column) -> Column:
    v = doubles(v)
    length = F.greatest(norm(v), F.lit(FLOOR))
    return F.transform(v, lambda x: x / length)


def cosine(a: Column, b: Column) -> Column:
    return dot(l2_normalize(a), l2_normalize(b))


def fused(similarity: Column, days_a: Column, days_b: Column, sigma: float = 30.0) -> Column:
    """Similarity fading with distance in time: cos * exp(-dt^2 / (2 sigma^2))."""
    gap = days_a - days_b
    return similarity * F.exp(-(gap * gap) / F.lit(2.0 * sigma * sigma))


def crop_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, padding: float = 0.3) -> Column:
    """struct(x0, y0, x1, y1): the rectangle padded by truncated shares and kept inside the image; NULL under 4 pixels."""
    px, py = (F.floor(s * F.lit(padding)).cast("long") for s in (w, h))
    x0, y0 = F.greatest(F.lit(0), x - px), F.greatest(F.lit(0), y - py)
    x1, y1 = F.least(width, x + w + px), F.least(height, y + h + py)
    box = F.struct(x0.cast("long").alias("x0"), y0.cast("long").alias("y0"), x1.cast("long").alias("x1"), y1.cast("long").alias("y1"))
    return F.when((x1 - x0 >= 4) & (y1 - y0 >= 4), box)


@F.arrow_udf(ArrayType(FloatType()))
def from_blob(blobs: pa.Array) -> pa.Array:
    """Little-endian 32-bit floats of a binary; trailing bytes are dropped. The batch's bytes are read as floats at once."""
    none = blobs.is_null().to_numpy(zero_copy_only=False)
    blobs = blobs.cast(pa.binary())
    ends = np.frombuffer(blobs.buffers()[1], np.int32, len(blobs) + 1, 4 * blobs.offset).astype(np.int64)
    data = blobs.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    size = np.where(none, 0, np.diff(ends))
    if (size % 4).any() or (np.diff(ends) != size).any():
        # bytes behind the last whole float of a row, and of null rows, go
        place = np.arange(len(raw)) - np.repeat(ends[:-1] - ends[0], np.diff(ends))
        raw = raw[place < np.repeat(size - size % 4, np.diff(ends))]
    floats = np.frombuffer(raw.tobytes(), "<f4").astype(np.float32)
    offsets = np.append(0, np.cumsum(size // 4)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(floats), mask=pa.array(none))
