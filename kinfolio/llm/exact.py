"""Exact duplicates: groups of one 128-bit content hash, the smallest id kept, bytes compared inside the groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, written

#: Hashes of repeated contents that are sent to every task, 16 bytes each; beyond, every text takes part in the comparison.
BROADCAST_HASHES = 500_000


def normalised(text: Column) -> Column:
    """The text with each run of space and U+0009..U+000D as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def content_hash(content: Column) -> Column:
    """128 bits."""
    return F.unhex(F.md5(content))


def compared(docs: DataFrame, groups: DataFrame, hashed: Callable[[Column], Column]) -> DataFrame:
    """The hashes of ``groups(h)`` behind which different contents stand: (h, content) of each of them, written.

    Equal contents are combined where they are read, so a task
    sends each content once, however many rows have it, and a group of any size is dealt by hash and bytes together.
    """
    shared = groups.select("h")
    contents = docs.select(normalised(F.col("text")).alias("content")).withColumn("h", hashed(F.col("content")))
    if shared.count() <= BROADCAST_HASHES:
        contents = contents.join(F.broadcast(shared), "h", "left_semi")
    several = contents.distinct().groupBy("h").agg(F.count("*").alias("different")).where("different > 1").select("h")
    several = written(several, "collided")
    if several.isEmpty():
        return several.withColumn("content", F.lit(None).cast("string"))
    return written(contents.join(several, "h", "left_semi").distinct(), "contents")


def grouped(rows: DataFrame, *key: str) -> DataFrame:
    """``key``, keep_id (smallest doc_id), keep_row (one row that has it), n of ``rows(doc_id, row)`` where n > 1, written."""
    # of rows with the smallest doc_id one is chosen; they are equal in all that is returned
    first = F.coalesce(F.min_by("row", "doc_id"), F.min("row"))
    return written(rows.groupBy(*key).agg(F.min("doc_id").alias("keep_id"), first.alias("keep_row"), F.count("*").alias("n")).where("n > 1"), "groups")


def mark(docs: DataFrame, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs(doc_id, text)``.

    Texts are equal if they are after :func:`normalised`; of equal ones the row with the smallest doc_id stays (``kept``).
    Rows are grouped by ``hashed`` of the content; the counts are combined before they are shuffled, and the join of the rows
    with their group is between two written tables, so a group with a third of all rows is split. Then the bytes of each
    group are compared; groups in which they differ are grouped anew by the bytes.

    Null and empty texts are equal, and unlike a text of one space; very long texts are one content each. Rows repeated under
    one doc_id with equal contents keep one row. A null doc_id stays only where its group has no other, and keep_id is null
    there. An empty table gives an empty result. Other columns of any name are not read.
    """
    content = normalised(F.col("text"))
    heads = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), hashed(content).alias("h"), F.sha2(content, 256).alias("text_sha256"))
    heads = written(heads, "heads")
    groups = grouped(heads, "h")
    apart = compared(docs, groups, hashed)
    if apart.isEmpty():
        return answers(heads, groups, "h")
    hashes = written(apart.select("h").distinct(), "hashes")
    # the digest leads a row to the contents of its hash, the bytes decide between them
    rows = docs.select("doc_id", normalised(F.col("text")).alias("content")).withColumn("h", hashed(F.col("content"))).join(hashes, "h", "left_semi")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("text_sha256", F.sha2("content", 256)), "apart")
    exact = grouped(rows, "h", "content")
    return answers(heads.join(hashes, "h", "left_anti"), groups, "h").unionByName(answers(rows, exact, "h", "content"))


def answers(rows: DataFrame, groups: DataFrame, *key: str) -> DataFrame:
    """The columns of :func:`mark`; a row without a group in ``groups`` is alone."""
    found = rows.join(groups, list(key), "left")
    kept = F.col("keep_row").isNull() | (F.col("row") == F.col("keep_row"))
    return found.select("doc_id", F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), kept.alias("kept"), "text_sha256")


def keep(docs: DataFrame, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each content.

    Of rows that repeat a doc_id with equal contents, the smallest in its other columns stays, so that reruns agree; the rest
    is as in :func:`mark`.
    """
    names = free_names(docs.columns, "content", "digest", "row")
    content, digest, row = names
    kept = written(mark(docs, hashed).where("kept").select(F.col("doc_id").alias(row), F.col("text_sha256").alias(digest)), "kept")
    rows = docs.withColumn(content, F.sha2(normalised(F.col("text")), 256))
    on = rows["doc_id"].eqNullSafe(kept[row]) & (rows[content] == kept[digest])
    rows = written(rows.join(kept, on, "left_semi"), "stay")
    again = written(rows.groupBy("doc_id", content).agg(F.count("*").alias(row)).where(F.col(row) > 1).select(F.col("doc_id").alias(row), F.col(content).alias(digest)), "again")
    if again.isEmpty():
        return rows.select(*docs.columns)
    on = rows["doc_id"].eqNullSafe(again[row]) & (rows[content] == again[digest])
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    once = rows.join(again, on, "left_semi").groupBy("doc_id", content).agg(F.min_by(whole, F.struct("text", F.to_json(whole))).alias(row)).select(f"{row}.*")
    return rows.join(again, on, "left_anti").select(*docs.columns).unionByName(once)
