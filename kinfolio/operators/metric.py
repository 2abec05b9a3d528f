"""Points in blocks of a metric partition, and the pairs of blocks that the triangle inequality leaves within a distance.

A point belongs to the cell of its nearest pivot; a cell is cut into blocks by the distance to the pivot. What is known of a
block, its pivot and its least and largest distance to it, is enough to tell that a point elsewhere is too far from all of it.
The table of blocks and the pivots go to every task: at most ``MAX_BLOCKS`` and ``MAX_PIVOTS`` and as many again of each.
Blocks that meet travel in groups, so a point goes once to a group and not to each block of it. Squared distances come from
products of matrices in single floats, a tile at a time; what these leave within a bound, roundings allowed for, is measured
exactly.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .ordinal import with_ordinal

#: Points of a block, if there are not too many blocks then.
BLOCK = 2048
MAX_PIVOTS, MAX_BLOCKS = 4096, 200_000
#: Points whose distances to all pivots are in memory at once, and components whose differences are.
LOT, AT_ONCE = 256, 1 << 22
#: Groups of blocks aimed at, the most blocks of a group (a bit each), and the most numbers in its points: two groups meet in a task.
GROUPS, MAX_GROUP, GROUP_VALUES = 8, 60, 1 << 23
#: Rows and columns of the tiles in which pairs are sought, and points that a block meets at once.
TILE, WIDE, CHUNK = 256, 2048, 8192
#: Pairs of points that are worth a task.
TASK_PAIRS = 1 << 24


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean, from differences: exact zeros for equal points."""
    out = np.empty((len(a), len(b)))
    step = max(1, AT_ONCE // max(1, b.size))
    for k in range(0, len(a), step):
        d = a[k : k + step, None, :] - b[None, :, :]
        out[k : k + step] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
    return out


def squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by a product of matrices, and for each row of ``a`` how far they may be off."""
    middle = b.mean(axis=0)
    a, b = a - middle, b - middle
    aa, bb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    out = a @ b.T
    out *= -2
    out += aa[:, None]
    out += bb[None, :]
    return out, 8 * (a.shape[1] + 8) * np.finfo(float).eps * (aa + bb.max() + np.dot(middle, middle))


@dataclass
class Flat:
    """Vectors ``x``, and in units of ``unit`` about a middle: as single floats, a column each, with their squared lengths, and how
    far the middle's subtraction may move two of them apart. What isn't finite is NaN there."""

    x: np.ndarray
    single: np.ndarray
    squares: np.ndarray
    unit: float
    off: float

    def take(self, at: np.ndarray | slice) -> Flat:
        return Flat(self.x[at], self.single[:, at], self.squares[at], self.unit, self.off)


def flats(*sides: np.ndarray) -> list[Flat]:
    """Each of ``sides`` in the same units about the same middle."""
    finite = [np.isfinite(x).all(axis=1) for x in sides]
    n = sum(int(f.sum()) for f in finite)
    middle = sum(x[f].sum(axis=0) for x, f in zip(sides, finite, strict=True)) / max(1, n)
    moved = [x - middle for x in sides]
    unit = max(math.sqrt(np.einsum("ij,ij->i", m[f], m[f]).max(initial=0.0)) for m, f in zip(moved, finite, strict=True)) or 1.0
    off = 8 * np.finfo(float).eps * math.sqrt(len(middle)) * (1 + math.sqrt(np.dot(middle, middle)) / unit)
    out = []
    for x, m, f in zip(sides, moved, finite, strict=True):
        m = m / unit
        m[~f] = np.nan
        out.append(Flat(x, np.ascontiguousarray(m.T.astype(np.float32)), np.einsum("ij,ij->i", m, m), unit, off))
    return out


def within(a: np.ndarray | Flat, b: np.ndarray | Flat, bound: np.ndarray, groups: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, distance) of the pairs at most ``bound`` apart, a bound for each row of ``a``; the distances are those of
    :func:`distances`. ``groups`` number the rows of both: only pairs of different ones count."""
    a, b = (a, b) if isinstance(a, Flat) else flats(a, b) if len(a) and len(b) else (a, b)
    if not isinstance(a, Flat) or not len(a.x) or not len(b.x):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    dims, n = a.x.shape[1], len(b.x)
    # a product of rows and columns is the square of the distance less that of the bound, less what single floats may be off
    e = (dims + 8) * 2.0**-23
    reach = np.minimum(bound / a.unit + a.off, 4.0) ** 2
    rows = np.ones((len(a.x), dims + 2), np.float32)
    rows[:, :dims], rows[:, dims] = -2 * a.single.T, a.squares * (1 - 2 * e) - reach * (1 + e) - 1e-30
    tile, beyond = np.empty(TILE * WIDE, np.float32), np.zeros(TILE * WIDE, bool)
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for k in range(0, n, WIDE):
        columns = np.ones((dims + 2, min(WIDE, n - k)), np.float32)
        columns[:dims], columns[dims + 1] = b.single[:, k : k + WIDE], b.squares[k : k + WIDE] * (1 - 2 * e)
        wide = columns.shape[1]
        for r in range(0, len(rows), TILE):
            some = rows[r : r + TILE]
            m = len(some) * wide
            np.matmul(some, columns, out=tile[:m].reshape(len(some), wide))
            np.greater(tile[:m], 0, out=beyond[:m])
            beyond[m : m + -m % 8] = True
            eights = np.flatnonzero(beyond[: m + -m % 8].view(np.uint64) != 0x0101010101010101)
            if len(eights):
                at = (eights[:, None] * 8 + np.arange(8)).ravel()
                i, j = np.divmod(at[~beyond[at]], wide)
                found.append((i + r, j + k))
    i, j = (np.concatenate(f) for f in zip(*found, strict=True))
    if groups is not None:
        apart = groups[0][i] != groups[1][j]
        i, j = i[apart], j[apart]
    d = np.empty(len(i))
    step = max(1, AT_ONCE // dims)
    for k in range(0, len(i), step):
        apart = a.x[i[k : k + step]] - b.x[j[k : k + step]]
        d[k : k + step] = np.sqrt(np.einsum("ik,ik->i", apart, apart))
    ok = d <= bound[i]
    i, j, d = i[ok], j[ok], d[ok]
    order = np.lexsort((j, i)) if n > WIDE else slice(None)
    return i[order], j[order], d[order]


def nearest_bound(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """For each row of ``a`` a distance within which at least ``k`` rows of ``b`` lie; infinite if there are fewer."""
    if len(b) < k:
        return np.full(len(a), np.inf)
    found, off = squares(a, b)
    found.partition(k - 1, axis=1)
    return np.sqrt(np.maximum(found[:, k - 1], 0) * (1 + 1e-12) + off)


def stacked(s: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in s])


@dataclass
class Blocks:
    """``ids``, ``low`` and ``high`` by block, in order of cells; those of cell k are ``first[k]`` to ``first[k + 1]``."""

    pivots: np.ndarray
    pivot_points: np.ndarray
    radius: np.ndarray
    ids: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    rows: int

    def reached(self, x: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, block) of the blocks that may hold a point at most ``bound`` from the row: all others are farther."""
        d = distances(x, self.pivots)
        # differences of distances are off by roundings
        row, cell = np.nonzero(d - self.radius <= bound[:, None] + 1e-12 * (d + self.radius))
        many = self.first[cell + 1] - self.first[cell]
        at = np.repeat(np.arange(len(row)), many)
        block = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + self.first[cell[at]]
        row, far = row[at], d[row[at], cell[at]]
        near = np.maximum(self.low[block] - far, far - self.high[block]) <= bound[row] + 1e-12 * (far + self.high[block])
        return row[near], block[near]

    def nearest_other(self, x: np.ndarray, own: int) -> np.ndarray:
        """For each row a distance below which no point of another block than ``own`` lies."""
        d = distances(x, self.pivots)
        out = np.full(len(x), np.inf)
        mine = int(np.flatnonzero(self.ids == own)[0])
        cell = int(np.searchsorted(self.first, mine, side="right") - 1)
        filled = (self.first[1:] > self.first[:-1]) & (np.arange(len(self.radius)) != cell)
        if filled.any():
            out = ((d - self.radius) - 1e-12 * (d + self.radius))[:, filled].min(axis=1)
        for b in range(self.first[cell], self.first[cell + 1]):
            if b != mine:
                out = np.minimum(out, np.maximum(self.low[b] - d[:, cell], d[:, cell] - self.high[b]) - 1e-12 * (d[:, cell] + self.high[b]))
        return np.maximum(out, 0)


def partition(rows: DataFrame, n: int) -> tuple[DataFrame, Blocks]:
    """``rows(point, features)`` with ``block``, written, and the table of blocks. ``n`` is the number of rows.

    Pivots are points in hash order. Blocks are cut from the order of cell and distance, which ranges of it number, so a cell
    of any size, of equal points too, is many blocks and passes no single task.
    """
    some = written(rows.select("point", "features").orderBy(F.xxhash64("point"), "point").limit(min(MAX_PIVOTS, max(1, math.ceil(n / BLOCK)))), "pivots").collect()
    pivots, pivot_points = np.array([r["features"] for r in some], float), np.array([r["point"] for r in some], np.int64)
    size = max(BLOCK, math.ceil(n / MAX_BLOCKS))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), LOT):
                lot = pdf.iloc[at : at + LOT]
                d = distances(stacked(lot["features"]), pivots)
                cell = d.argmin(axis=1)
                yield lot.assign(cell=cell.astype(np.int32), r=d[np.arange(len(d)), cell])

    placed = rows.select("point", "features").mapInPandas(place, "point long, features array<double>, cell int, r double")
    placed = with_ordinal(placed, [F.col("cell"), F.col("r"), F.col("point")])
    placed = written(placed.withColumn("block", F.floor(F.col("ordinal") / size) * len(pivots) + F.col("cell")).drop("ordinal"), "placed")
    # a row for each block
    found = placed.groupBy("block").agg(F.min("cell").alias("cell"), F.min("r").alias("low"), F.max("r").alias("high")).orderBy("cell", "low", "block").toPandas()
    cells = np.arange(len(pivots))
    radius = np.zeros(len(pivots))
    np.maximum.at(radius, found["cell"].to_numpy(int), found["high"].to_numpy(float))
    first = np.append(np.searchsorted(found["cell"].to_numpy(int), cells), len(found))
    radius[first[1:] == first[:-1]] = -np.inf
    blocks = Blocks(pivots, pivot_points, radius, found["block"].to_numpy(np.int64), found["low"].to_numpy(float), found["high"].to_numpy(float), first, size)
    return placed.select("point", "features", "block"), blocks


def probes(rows: DataFrame, blocks: Blocks, keep: Callable[[pd.DataFrame, np.ndarray, np.ndarray], np.ndarray] | None = None, n: int | None = None) -> DataFrame:
    """own, block, own_group, group, place: each block of ``rows(point, features, block, bound, ...)`` with each other block that may hold
    a point within ``bound`` of one of its rows. ``place`` numbers the blocks of a group. ``keep(rows, row, block)`` tells which
    pairs of places count.

    ``n`` is the number of rows, if they are not all points: groups of few rows are of more blocks.
    """
    order = np.argsort(blocks.ids)
    size = min(MAX_GROUP, max(1, GROUP_VALUES // (blocks.rows * blocks.pivots.shape[1])), max(1, math.ceil(len(blocks.ids) / GROUPS)))
    # rows lie in some blocks more than in others, so a group may hold more, but none more than its blocks do
    own_size = size if n is None else max(size, len(blocks.ids) // max(1, math.ceil(n / (size * blocks.rows))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), LOT):
                lot = pdf.iloc[at : at + LOT]
                row, block = blocks.reached(stacked(lot["features"]), lot["bound"].to_numpy(float))
                ok = blocks.ids[block] != lot["block"].to_numpy()[row]
                if keep is not None:
                    ok &= keep(lot, row, block)
                own = order[np.searchsorted(blocks.ids, lot["block"].to_numpy(), sorter=order)]
                own, block = np.divmod(np.unique(own[row[ok]] * len(blocks.ids) + block[ok]), len(blocks.ids))
                yield pd.DataFrame({"own": blocks.ids[own], "block": blocks.ids[block], "own_group": own // own_size, "group": block // size, "place": block % size})

    return rows.mapInPandas(run, "own long, block long, own_group long, group long, place long").distinct()


def meet(members: DataFrame, found: DataFrame, blocks: Blocks, rows: DataFrame, run: Callable[[pd.DataFrame, Flat, Iterator[tuple[pd.DataFrame, Flat]]], pd.DataFrame], schema: str) -> DataFrame:
    """What ``run(come, x, meetings)`` makes of ``rows`` that come to ``members``: two groups of blocks meet in a task.

    ``come`` is a block of ``rows`` with its vectors ``x``. ``meetings`` are the members of the blocks that it meets there, up to
    CHUNK at once, with theirs.
    """
    found = written(found, "pairs")
    key = ["own_group", "group"]
    many = found.groupBy(*key).count().agg(F.count("*").alias("cells"), F.sum("count").alias("pairs")).first()
    # few pairs of points are not worth a task to each cell
    parts = max(1, min(4 * many["cells"], math.ceil((many["pairs"] or 0) * blocks.rows**2 / TASK_PAIRS), 2000))
    dealt = lambda df: df.repartition(parts, *key)
    keys = [F.col(k).alias(k) for k in key]
    there = dealt(members.join(found.select(F.col("block").alias("block"), F.col("place").alias("place"), *keys).distinct(), "block"))
    lists = found.select(F.col("own").alias("block"), *keys, F.expr("shiftleft(1L, CAST(place AS INT))").alias("bit")).groupBy("block", *key).agg(F.bit_or("bit").alias("meets"))
    come = dealt(rows.join(lists, "block"))

    def both(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=names)
        a, b = a.sort_values(["place", "point"]), b.sort_values(["block", "point"])
        theirs, mine = flats(stacked(a["features"]), stacked(b["features"]))
        a, b = a.drop(columns="features").reset_index(drop=True), b.drop(columns="features").reset_index(drop=True)
        starts = np.searchsorted(a["place"].to_numpy(), np.arange(MAX_GROUP + 1))

        def meetings(meets: int) -> Iterator[tuple[pd.DataFrame, Flat]]:
            picked = np.concatenate([np.arange(starts[p], starts[p + 1]) for p in range(MAX_GROUP) if meets >> p & 1])
            for k in range(0, len(picked), CHUNK):
                at = picked[k : k + CHUNK]
                yield a.iloc[at], theirs.take(slice(at[0], at[-1] + 1) if at[-1] - at[0] < len(at) else at)

        out = [run(part, mine.take(slice(part.index[0], part.index[-1] + 1)), meetings(int(part["meets"].iloc[0]))) for _, part in b.groupby("block")]
        return pd.concat([x for x in out if len(x)] or [pd.DataFrame(columns=names)])

    names = [f.split()[0] for f in schema.split(", ")]
    return there.groupBy(*key).cogroup(come.groupBy(*key)).applyInPandas(both, schema)
