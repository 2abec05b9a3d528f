"""Vector code compression: codebooks by integer k-means of the parts of vectors, a byte pair of digits a part."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Parts of a vector, entries of a part's codebook, rounds of assigning and averaging, steps of a component to 1.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Largest magnitude of a component: sums over 2^34 vectors and distances of parts of 32 components stay within 64 bits.
LARGEST = 1 << 20
#: Vectors of a block, and vectors whose distances to all entries are in memory at once.
BLOCK_ROWS, ROWS_AT_ONCE = 4096, 512


def usable(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def integers(v: Column, scale: int, parts: int) -> Column:
    """floor(scale * x) of each component, exact as doubles; zeros behind, up to a multiple of ``parts``."""
    whole = F.transform(v.cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))).cast("int"))
    return F.concat(whole, F.array_repeat(F.lit(0), F.pmod(-F.size(v), F.lit(parts)).cast("int")))


def blocks(rows: DataFrame, parts: int) -> DataFrame:
    """``rows(vec_id, label, whole)`` as columnar blocks: ids, labels, n and ``block``, the int32 array
    (place in part, part, vector) of a batch of rows, written.

    Each place is one contiguous plane over all parts and vectors, so distances add up plane by plane.
    """
    label = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                lot = batch.slice(at, BLOCK_ROWS)
                n = lot.num_rows
                flat = lot.column("whole").flatten().to_numpy(zero_copy_only=False).astype(np.int32)
                x = np.ascontiguousarray(flat.reshape(n, parts, -1 if len(flat) else 0).transpose(2, 1, 0))
                ends = pa.array([0, n], pa.int32())
                columns = [pa.ListArray.from_arrays(ends, lot.column(c)) for c in ("vec_id", "label")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([n]), pa.array([x.tobytes()], pa.binary())], ["ids", "labels", "n", "block"])

    return written(rows.select("vec_id", "label", "whole").mapInArrow(run, f"ids array<long>, labels array<{label}>, n long, block binary"), "blocks")


def planes(block: bytes, n: int, parts: int) -> np.ndarray:
    x = np.frombuffer(block, np.int32)
    return x.reshape(-1 if len(x) else 0, parts, n)


def assigned(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part of each vector, ties to the lower index, and its squared distance, (part, vector) each.

    ``x`` is (place, part, vector), ``books`` (part, entry, place). The distances of a lot of vectors to all entries grow by
    one place of the parts at a time.
    """
    places, parts, n = x.shape
    code, least = np.zeros((parts, n), np.int64), np.zeros((parts, n), np.int64)
    for at in range(0, n, ROWS_AT_ONCE):
        lot = x[:, :, at : at + ROWS_AT_ONCE]
        far = np.zeros((parts, books.shape[1], lot.shape[2]), np.int64)
        for d in range(places):
            apart = lot[d][:, None, :].astype(np.int64) - books[:, :, d, None]
            far += apart * apart
        best = far.argmin(axis=1)
        code[:, at : at + ROWS_AT_ONCE] = best
        least[:, at : at + ROWS_AT_ONCE] = np.take_along_axis(far, best[:, None, :], 1)[:, 0]
    return code, least


def refined(rdd: RDD, books: np.ndarray, depth: int) -> np.ndarray:
    """``books`` after one round: each entry becomes floor(sum / count) of the parts assigned to it, if any is.

    Sums and counts of all entries are int64 tensors of one fixed size. A partition adds its blocks into one pair, pairs
    merge in a tree of ``depth`` levels of tasks, and the driver gets the few of its last level.
    """
    parts, entries, places = books.shape
    part_of = np.arange(parts)[:, None]

    def add(total: tuple[np.ndarray, np.ndarray] | None, row: tuple[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        sums, counts = total or (np.zeros((parts, entries, places), np.int64), np.zeros((parts, entries), np.int64))
        x = planes(row[1], row[0], parts)
        code, _ = assigned(x, books)
        where = np.broadcast_to(part_of, code.shape)
        np.add.at(counts, (where, code), 1)
        for d in range(places):
            np.add.at(sums[:, :, d], (where, code), x[d])
        return sums, counts

    def merge(a: tuple[np.ndarray, np.ndarray] | None, b: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray] | None:
        return (a[0] + b[0], a[1] + b[1]) if a and b else a or b

    total = rdd.treeAggregate(None, add, merge, depth)
    if total is None:
        return books
    sums, counts = total
    return np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(x) for x in books.ravel().tolist()).encode()).hexdigest()


def coded(table: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error of the vectors of ``blocks``."""
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.array([f"{k:02x}" for k in range(256)], dtype=object)
        for batch in batches:
            codes, errors = [], []
            for n, block in zip(batch.column("n").to_pylist(), batch.column("block").to_pylist(), strict=True):
                code, least = assigned(planes(block, n, parts), books)
                codes.append(["".join(x) for x in digits[code.T]])
                errors.append(least.sum(axis=0).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("ids"), batch.column("labels"), pa.array(codes, pa.list_(pa.string())), pa.array(errors, pa.list_(pa.int64()))], ["ids", "labels", "codes", "errors"])

    label = table.schema["labels"].dataType.simpleString()
    out = table.mapInArrow(run, f"ids array<long>, labels {label}, codes array<string>, errors array<long>")
    rows = out.select(F.inline(F.arrays_zip("ids", "labels", "codes", "errors")))
    return rows.select(F.col("ids").alias("vec_id"), F.col("labels").alias("label"), F.col("codes").alias("code"), F.col("errors").alias("error"))


def first_books(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """The parts of the ``entries`` vectors of smallest vec_id; nulls come last, equal ids by their vectors."""
    top = rows.orderBy(F.col("vec_id").asc_nulls_last(), "whole").limit(entries).select("whole").collect()
    x = np.array([r["whole"] for r in top], np.int64).reshape(len(top), parts, -1 if len(top) and len(top[0]["whole"]) else 0)
    return np.ascontiguousarray(x.transpose(1, 0, 2))


def compress(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, depth: int = 2) -> DataFrame:
    """vec_id, label, code, error, codebooks_sha256 of ``vectors(vec_id, embedding, label)``.

    Components become integers floor(scale * x) and vectors ``parts`` equal consecutive parts. The codebook of a part starts
    as that part of the vectors of smallest vec_id and is refined in ``rounds`` rounds (:func:`refined`) over blocks that are
    written once; all is exact in integers, so the result hangs on neither blocks nor tasks. Only the codebooks travel.

    Vectors that are null or hold null or non-finite components are left out. A length that ``parts`` doesn't divide
    counts as followed by zeros, and vectors of each length have codebooks of their own. Fewer vectors than ``entries`` make shorter codebooks.
    Rows of one vec_id each count, a null vec_id counts as the largest, other columns of any name are not read. An empty table
    gives an empty result. A component of 2^20 or more in magnitude is an error, as sums might leave 64 bits.
    """
    if entries > 256:
        raise ValueError("a code is two hexadecimal digits: 256 entries at most")
    large = F.exists("embedding", lambda x: F.abs(x) >= LARGEST)
    checked = F.when(large, F.raise_error(F.lit(f"a component of {LARGEST} or more in magnitude"))).otherwise(integers(F.col("embedding"), scale, parts))
    rows = written(vectors.where(usable(F.col("embedding"))).select("vec_id", "label", checked.alias("whole")), "integers")
    out = None
    for (length,) in sorted(rows.select(F.size("whole")).distinct().collect()):
        alike = rows.where(F.size("whole") == length)
        table = blocks(alike, parts)
        books = first_books(alike, parts, entries)
        for _ in range(rounds):
            books = refined(table.select("n", "block").rdd.map(tuple), books, depth)
        found = coded(table, books).withColumn("codebooks_sha256", F.lit(digest(books)))
        out = found if out is None else out.unionByName(found)
    if out is None:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit("").alias("codebooks_sha256")).limit(0)
    return out


def with_label_error(rows: DataFrame) -> DataFrame:
    """``rows(label, error)`` with ``label_error``, the error summed over equal labels; null is one of the labels.

    Sums are combined before they are shuffled and both sides of the join are written, so a label of very many rows is split.
    """
    rows = written(rows, "coded")
    totals = written(rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label"), "label_errors")
    return rows.join(totals, rows["label"].eqNullSafe(totals["_label"])).drop("_label")
