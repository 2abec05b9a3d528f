"""Packing documents into training sequences of several permitted lengths by best fit."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .mixing import word_count

#: Permitted sequence lengths, in words.
CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: What a sequence costs besides its length (its own start, a kernel launch), and pieces that one task packs.
OVERHEAD, PIECES_A_SHARD = 16, 50_000
#: Copies of a row that one task lists.
LOT = 10_000


def cost(capacity: int) -> float:
    return capacity + OVERHEAD


class Counts:
    """A multiset of lengths; finds its largest member up to a limit, and its smallest from one on."""

    def __init__(self) -> None:
        self.mask, self.held = 0, {}

    def add(self, length: int, n: int = 1) -> None:
        self.held[length] = self.held.get(length, 0) + n
        self.mask |= 1 << length

    def drop(self, length: int) -> None:
        self.held[length] -= 1
        if not self.held[length]:
            self.mask &= ~(1 << length)

    def at_most(self, limit: int, mask: int | None = None) -> int:
        return ((self.mask if mask is None else mask) & ((1 << (limit + 1)) - 1)).bit_length() - 1

    def at_least(self, limit: int) -> int:
        rest = self.mask >> limit
        return limit + (rest & -rest).bit_length() - 1 if rest else -1


def opening(length: int, waiting: Counts, capacities: tuple[int, ...]) -> int:
    """The capacity that costs least per packed word if a bin begins with ``length`` and waiting pieces fill it greedily.

    A bin counts as the smallest permitted length that holds its contents; ties go to the larger capacity.
    """
    best, choice = math.inf, capacities[-1]
    for c in capacities:
        if c < length:
            continue
        room, used = c - length, length
        taken: dict[int, int] = {}
        mask = waiting.mask
        while room:
            x = waiting.at_most(room, mask)
            if x <= 0:
                break
            n = min(room // x, waiting.held[x] - taken.get(x, 0))
            if not n:
                mask &= ~(1 << x)
                continue
            taken[x] = taken.get(x, 0) + n
            used, room = used + n * x, room - n * x
            mask &= ~(1 << x)
        price = cost(next(k for k in capacities if k >= used)) / used
        if price <= best:
            best, choice = price, c
    return choice


def best_fit(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """(bin of each piece, place in its bin, capacity of each bin) for ``lengths`` in falling order.

    A piece goes to the open bin with the least room that holds it, the earliest of equals; if there is none, a bin of the
    least-cost capacity opens. At the end each bin shrinks to the smallest permitted length that holds its contents.
    """
    waiting = Counts()
    for x in lengths:
        waiting.add(x)
    rooms, by_room = Counts(), {}
    bins, places, used = [], [], []
    for x in lengths:
        waiting.drop(x)
        room = rooms.at_least(x)
        if room < 0:
            room, b = opening(x, waiting, capacities), len(used)
            used.append(0)
        else:
            b = by_room[room].pop()
            rooms.drop(room)
        bins.append(b)
        places.append(used[b])
        used[b] += x
        rooms.add(room - x)
        by_room.setdefault(room - x, []).append(b)
    return bins, places, [next(c for c in capacities if c >= u) for u in used]


def pieces(docs: DataFrame, most: int) -> DataFrame:
    """doc_id, copy, piece, start, length: each row of ``docs`` cut at every ``most`` words.

    Rows of one doc_id, as repeated by a mix, are numbered by ``copy``. A text of no words has no piece.
    """
    sized = written(docs.select("doc_id", word_count(F.col("text")).alias("words")), "lengths").where("words > 0")
    # equal rows are counted before they are numbered, so that a much repeated row stays one row until here
    counted = sized.groupBy("doc_id", "words").agg(F.count("*").alias("rows"))
    order = Window.partitionBy("doc_id").orderBy("words").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("before", F.coalesce(F.sum("rows").over(order), F.lit(0)))
    # a row repeated very often, as under a null doc_id, is dealt out in lots before it becomes rows again
    lots = counted.where(F.col("rows") > LOT).withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / LOT)))).repartition("doc_id", "words", "lot")
    lots = lots.withColumn("before", F.col("before") + F.col("lot") * LOT).withColumn("rows", F.least(F.lit(LOT).cast("long"), F.col("rows") - F.col("lot") * LOT)).drop("lot")
    counted = counted.where(F.col("rows") <= LOT).unionByName(lots)
    copies = counted.withColumn("copy", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("rows") - 1)))
    cut = copies.withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil(F.col("words") / most).cast("int") - 1)))
    start = F.col("piece").cast("long") * most
    return cut.select("doc_id", "copy", "piece", start.alias("start"), F.least(F.lit(most).cast("long"), F.col("words") - start).alias("length"))


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, pieces_a_shard: int = PIECES_A_SHARD) -> DataFrame:
    """bin_id, capacity, used, place, doc_id, copy, piece, start, length for every piece of ``docs(doc_id, text)``.

    Pieces are dealt by hash to shards of about ``pieces_a_shard`` and each shard packs its own by best fit in falling
    order of length, ties by doc_id, copy and piece; only ids and lengths are shuffled. A shard leaves a few bins partly
    filled, whatever its size. Null and empty texts have no words and no place. A null doc_id is packed like any other.
    Very long texts are cut at the largest capacity; an empty table packs to none.
    """
    capacities = tuple(sorted(set(capacities)))
    cut = written(pieces(docs, capacities[-1]), "pieces")
    shards = max(1, math.ceil(cut.count() / pieces_a_shard))
    # ids as strings: beside a null pandas would make them doubles
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "copy", "piece"), F.lit(shards)).cast("int")).withColumn("doc_id", F.col("doc_id").cast("string"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf["doc_id"] = pd.array([None if x is None else int(x) for x in pdf["doc_id"]], "Int64")
        pdf = pdf.sort_values(["length", "doc_id", "copy", "piece"], ascending=[False, True, True, True], kind="stable", na_position="last").reset_index(drop=True)
        bins, places, sizes = best_fit([int(x) for x in pdf["length"]], capacities)
        pdf["bin"], pdf["place"] = bins, places
        pdf["capacity"] = [sizes[b] for b in bins]
        pdf["used"] = pdf.groupby("bin")["length"].transform("sum")
        pdf["bin_id"] = pdf["shard"].astype(str) + "-" + pdf["bin"].astype(str)
        return pdf[["bin_id", "capacity", "used", "place", "doc_id", "copy", "piece", "start", "length"]]

    return dealt.groupBy("shard").applyInPandas(run, "bin_id string, capacity long, used long, place long, doc_id long, copy long, piece int, start long, length long")
