"""Mixing sources to target weights, by DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free_names, written

#: Slices of a source's hash order. Only the slice that holds the cut is ordered row by row.
SLICES = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked_sources(sources: DataFrame) -> DataFrame:
    """Adds ``ordinal`` from 0, by code point, null last.

    The order is made by range partitions and one offset per partition, so no task holds all sources.
    """
    split = sources.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id())
    split = written(split, "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = split.groupBy("part").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    # one row per partition: its count is the partition count, whatever the data
    return split.join(F.broadcast(offsets.select("part", "offset")), "part").withColumn("ordinal", F.row_number().over(inside) - 1 + F.col("offset")).drop("part", "offset")


def water_level(sources: DataFrame, total: int, max_epochs: int) -> float | None:
    """The level L at which ``sum(min(max_epochs * source_size, weight * L)) = total``; None if every source is clamped.

    Each round clamps the sources that stand above their cap and shares the rest by weight among the others. The
    level only rises, so it ends; a round sends two sums to the driver.
    """
    cap, level = F.col("source_size") * max_epochs, 0.0
    while True:
        clamped = cap <= F.col("weight") * F.lit(level)
        row = sources.agg(F.sum(F.when(clamped, cap)).alias("c"), F.sum(F.when(~clamped, F.col("weight"))).alias("w")).first()
        if not row.w:
            return None
        risen = (total - (row.c or 0)) / row.w
        if risen <= level:
            return level
        level = risen


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), total_share: float = 1.0, max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """Capped water-filling over ``docs(doc_id, text, source)``.

    Sources, by code point with null last, take ``weights`` in turn and share ``total_share`` of all words. A source's
    target stops at ``max_epochs`` times its size; the excess goes to the others by weight until none is above.

    Then each document repeats ``floor(target / size)`` times, and in the seeded order md5(seed:doc_id) the first
    documents of a source repeat once more, as far as the target reaches; the one at the cut repeats by a fraction, so
    that a source's ``taken`` words add up to its target rounded down. Copies of a row are equal and either may come first.

    Returns doc_id, source, size, source_size, target, taken. Null text counts 0 words; a source of no words has target 0.
    Reruns agree. Null doc_id hashes as an empty one. A very long text counts all its words; an empty table gives an empty
    result.
    """
    if max_epochs < total_share:
        raise ValueError("the sources cannot reach the total within max_epochs")
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("u"))
    sized = written(sized.withColumn("slice", F.conv(F.substring("u", 1, 3), 16, 10).cast("int")), "sized")
    # one row per source and slice; a hot source is summed before it is shuffled
    slices = written(sized.groupBy("source", "slice").agg(F.sum("size").alias("slice_size")), "slices")
    sources = ranked_sources(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")))
    weight = F.lit(weights[0])
    for k, w in enumerate(weights[1:], 1):
        weight = F.when(F.col("ordinal") % len(weights) == k, F.lit(w)).otherwise(weight)
    sources = written(sources.withColumn("weight", weight.cast("long")), "weights")
    words = sources.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(sources, int(words * total_share), max_epochs)
    cap = (F.col("source_size") * max_epochs).cast("double")
    target = cap if level is None else F.least(cap, F.col("weight") * F.lit(level))
    sources = sources.withColumn("target", target)
    sources = sources.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    sources = sources.withColumn("extra", (F.floor(F.col("target")) - F.col("whole") * F.col("source_size")).cast("long"))
    # where each slice begins in its source's order: at most SLICES rows a source
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    cuts = slices.withColumn("slice_from", F.coalesce(F.sum("slice_size").over(before), F.lit(0)).cast("long"))
    cuts = written(cuts.join(sources, cuts.source.eqNullSafe(sources.source)).select(cuts.source, "slice", "slice_size", "slice_from", "source_size", "target", "whole", "extra"), "cuts")
    # the cold way and the hot way are the same join; both sides are plain, so a hot slice can be split at run time
    rows = sized.alias("d").join(cuts.alias("c"), F.col("d.slice").eqNullSafe(F.col("c.slice")) & F.col("d.source").eqNullSafe(F.col("c.source"))).select("doc_id", "d.source", "size", "u", "d.slice", "slice_size", "slice_from", "source_size", "target", "whole", "extra")
    cut = (F.col("slice_from") < F.col("extra")) & (F.col("slice_from") + F.col("slice_size") > F.col("extra"))
    plain = rows.where(~cut).withColumn("once", F.when(F.col("slice_from") < F.col("extra"), F.col("size")).otherwise(F.lit(0)))
    # one slice of a source is ordered: its documents up to the cut
    order = Window.partitionBy("source").orderBy("u", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = rows.where(cut).withColumn("upto", F.col("slice_from") + F.sum("size").over(order))
    ordered = ordered.withColumn("once", F.greatest(F.lit(0), F.col("size") - F.greatest(F.lit(0), F.col("upto") - F.col("extra")))).drop("upto")
    out = plain.unionByName(ordered)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("once")).cast("long").alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, native: split at the white space, keeping it."""
    pieces = F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), n), "")


def repeated(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, the fractional repetition as a shortened text.

    A document of no words has nothing to repeat and stays once. Null doc_id rows stay once too, as they can't be told apart.
    Columns of ``docs`` may have any names.
    """
    size, taken, part, key = free_names(docs.columns, "size", "taken", "part", "key")
    plan = mixed.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias(key)).agg(F.max("size").alias(size), F.max("taken").alias(taken))
    plan = written(plan, "plan")
    rows = docs.join(plan, docs.doc_id == plan[key], "left")
    empty = F.coalesce(F.col(size), F.lit(0)) == 0
    whole = F.when(empty, F.lit(1)).otherwise(F.floor(F.col(taken) / F.col(size))).cast("int")
    rest = F.when(empty, F.lit(0)).otherwise(F.col(taken) % F.col(size)).cast("int")
    parts = F.concat(F.array_repeat(F.lit(-1), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    rows = rows.withColumn(part, F.explode(parts))
    short = F.col(part) >= 0
    text = F.when(short, first_words(F.col("text"), F.greatest(F.col(part), F.lit(1)))).otherwise(F.col("text"))
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(short, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)
