"""Density-based hierarchical clustering (Campello, Moulavi, Sander 2013; McInnes, Healy 2017; Malzer, Baum 2020).

Points farther apart than ``cut`` never share a cluster, so the hierarchy splits into the connected components of the
graph of pairs within ``cut``. Points lie in blocks of a metric partition (:mod:`.metric`), and a point meets another block
only if the triangle inequality leaves a point of it below the bound that is known by then: its k-th nearest so far for core
distances, ``cut`` for components, and for spanning trees the least edge known to leave the point's tree, in rounds after
Boruvka. All is exact. Vectors of a component never meet in one task; its n - 1 edges do, where its clusters are read off
them. The part of the hierarchy above ``cut`` is not built: where there are several components each counts as a cluster
born at distance ``cut``. With an infinite ``cut`` there is one component and one tree, as in a single-machine library.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written
from . import metric
from .components import components
from .metric import Blocks, Flat, distances, stacked
from .ordinal import with_ordinal

EDGE = "component long, a long, b long, weight double"
#: Nearest points of each that are kept for the rounds of the trees.
NEAR = 16
#: A tree that searches looks so much farther than the least edge that is known to leave it, for the rounds to come.
SLACK = 1.15
#: Edges between trees that one task joins; more are joined by stars.
JOINED = 1 << 20


def core_distances(rows: DataFrame, min_samples: int = 2) -> DataFrame:
    """point, core: the distance to the ``min_samples``-th nearest of ``rows(point, features)``, the point itself included."""
    return cores(*metric.partition(rows, rows.count()), min_samples).select("point", "core")


class Nearest:
    """The ``most`` nearest of each row, of pairs that come in lots: (row, distance, and what else is kept of a pair)."""

    def __init__(self, most: int) -> None:
        self.most, self.row, self.kept, self.trimmed = most, np.empty(0, np.int64), None, 0

    def add(self, row: np.ndarray, d: np.ndarray, *more: np.ndarray) -> None:
        self.row = np.append(self.row, row)
        self.kept = [np.append(k, v) for k, v in zip(self.kept, (d, *more), strict=True)] if self.kept else [d, *more]

    def trim(self) -> np.ndarray:
        """Sorts and cuts what is kept; the places of the last of full rows."""
        order = np.lexsort((self.kept[1], self.kept[0], self.row))
        row = self.row[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        self.row, self.kept = row[rank < self.most], [k[order][rank < self.most] for k in self.kept]
        self.trimmed = len(self.row)
        return np.flatnonzero(rank[rank < self.most] == self.most - 1)

    def tighten(self, bound: np.ndarray) -> None:
        """Lowers the ``bound`` of full rows to their last, once as much has come as is kept."""
        if len(self.row) - self.trimmed > max(self.trimmed, 4 * len(bound)):
            last = self.trim()
            np.minimum.at(bound, self.row[last], self.kept[0][last])

    def lists(self) -> tuple[np.ndarray, list[list[np.ndarray]]]:
        """The rows that have any, and a list of arrays for each thing kept."""
        if not len(self.row):
            return self.row, [[] for _ in self.kept or (0, 0)]
        self.trim()
        starts = np.flatnonzero(np.diff(self.row, prepend=self.row[0] - 1))
        return self.row[starts], [np.split(k, starts[1:]) for k in self.kept]


def cores(placed: DataFrame, blocks: Blocks, min_samples: int) -> DataFrame:
    """``placed`` with ``core``, written."""
    return neighbours(placed, blocks, min_samples, min_samples).drop("near", "far")


def neighbours(placed: DataFrame, blocks: Blocks, min_samples: int, most: int) -> DataFrame:
    """``placed`` with ``core``, ``near`` and ``far``, written: ``near`` are structs (d, q) of at most ``most`` nearest points, the
    point itself included, and no point that isn't among them is nearer than ``far``.

    The k nearest in a point's own block, and the k nearest pivots, bound what the blocks around it can add.
    """

    def bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), metric.LOT):
                lot = pdf.iloc[at : at + metric.LOT]
                yield lot.assign(bound=np.minimum(lot["bound"], metric.nearest_bound(stacked(lot["features"]), blocks.pivots, min_samples)))

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        x = stacked(pdf["features"])
        return pdf.assign(bound=metric.nearest_bound(x, x, min_samples))

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids = stacked(pdf["features"]), pdf["point"].to_numpy()
        best = Nearest(most)
        i, j, d = metric.within(x, x, pdf["bound"].to_numpy(float))
        best.add(i, d, ids[j])
        return listed(best, ids)

    def outside(come: pd.DataFrame, x: Flat, meetings: Iterator[tuple[pd.DataFrame, Flat]]) -> pd.DataFrame:
        bound, best = come["bound"].to_numpy(float).copy(), Nearest(most)
        for there, y in meetings:
            i, j, d = metric.within(x, y, bound)
            best.add(i, d, there["point"].to_numpy()[j])
            best.tighten(bound)
        return listed(best, come["point"].to_numpy())

    def listed(best: Nearest, ids: np.ndarray) -> pd.DataFrame:
        i, (d, q) = best.lists()
        return pd.DataFrame({"point": ids[i], "d": d, "q": q})

    schema = "point long, d array<double>, q array<long>"
    near = placed.groupBy("block").applyInPandas(inside, "point long, features array<double>, block long, bound double")
    near = written(near.mapInPandas(bounded, near.schema), "bounds")
    found = near.groupBy("block").applyInPandas(own, schema)
    if len(blocks.ids) > 1:
        found = found.unionByName(metric.meet(placed, metric.probes(near, blocks), blocks, near, outside, schema))
    # at most ``most`` from each group of blocks that a point has met
    best = found.groupBy("point").agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("d", "q")))), 1, most).alias("near"))
    full = lambda k: F.when(F.size("near") >= k, F.element_at("near", k)["d"]).otherwise(F.lit(float("inf")))
    return written(near.join(best, "point").select("point", "features", "block", full(min_samples).alias("core"), "near", F.least("bound", full(most)).alias("far")), "core")


def within(placed: DataFrame, blocks: Blocks, cut: float, near: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(point, component) of the graph of pairs at most ``cut`` apart, and edges (a, b, d) of it that hold it together. ``near`` are
    such edges that are known; if ``placed`` has ``far``, all of points nearer than that are among them.

    A block yields a spanning forest, not its pairs. With ``near`` these hold most points together; those of all components
    but the largest, if ``far`` is within ``cut``, search the blocks around them, and blocks that meet yield the edges that join
    two components.
    """

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids = stacked(pdf["features"]), pdf["point"].to_numpy()
        near = np.zeros((len(ids), len(ids)), bool)
        i, j, _ = metric.within(x, x, np.full(len(ids), float(cut)))
        near[i, j] = True
        left, a, b = np.ones(len(ids), bool), [], []
        for start in range(len(ids)):
            if not left[start]:
                continue
            left[start] = False
            front = np.array([start])
            while len(front):
                reach = near[front] & left[None, :]
                new = np.flatnonzero(reach.any(axis=0))
                a += list(front[reach[:, new].argmax(axis=0)])
                b += list(new)
                left[new] = False
                front = new
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        apart = x[a] - x[b]
        return pd.DataFrame({"a": ids[a], "b": ids[b], "d": np.sqrt(np.einsum("ik,ik->i", apart, apart))})

    def joining(come: pd.DataFrame, x: Flat, meetings: Iterator[tuple[pd.DataFrame, Flat]]) -> pd.DataFrame:
        ids, mine = come["point"].to_numpy(), come["component"].to_numpy()
        out = [pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64), "d": np.empty(0)})]
        for there, y in meetings:
            theirs = there["component"].to_numpy()
            i, j, d = metric.within(x, y, np.full(len(ids), float(cut)), (mine, theirs))
            # one edge of two components, and of those as many as join any
            ends = np.stack([mine[i], theirs[j]], axis=1)
            _, once = np.unique(ends, axis=0, return_index=True)
            names, places = np.unique(ends[once], return_inverse=True)
            places = places.reshape(-1, 2)
            kept = once[[k for k, _, _ in merges(places[:, 0], places[:, 1], len(names))]] if len(once) else once
            out.append(pd.DataFrame({"a": ids[i[kept]], "b": there["point"].to_numpy()[j[kept]], "d": d[kept]}))
        return pd.concat(out)

    schema = "a long, b long, d double"
    edges = placed.groupBy("block").applyInPandas(forest, schema)
    edges = written(edges if near is None else edges.unionByName(near), "forest")
    numbered = lambda: placed.join(components(edges, "a", "b").withColumnRenamed("node", "point"), "point", "left").withColumn("component", F.coalesce("component", "point"))
    if len(blocks.ids) > 1:
        parts = written(numbered().select("point", "features", "block", "component", *(c for c in ("far",) if c in placed.columns)), "parts")
        largest = parts.groupBy("component").count().orderBy(F.desc("count"), "component").first()["component"]
        rows = parts.where(F.col("component") != largest)
        rows = written((rows.where(F.col("far") <= cut).drop("far") if "far" in placed.columns else rows).withColumn("bound", F.lit(float(cut))), "rows")
        n = rows.count()
        if not n:
            return parts.select("point", "component"), edges
        edges = written(edges.unionByName(metric.meet(parts, metric.probes(rows, blocks, n=n), blocks, rows, joining, schema)), "forest")
    return numbered().select("point", "component"), edges


def spanning_tree(x: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, weight): the minimum spanning tree of mutual reachability, by Prim with a row at a time.

    Edges of equal weight are ordered by their lower, then their higher row: one tree is least, and of the rows of a subset
    the tree holds all its edges among them.
    """
    n = len(x)
    rows, left = np.arange(n), np.ones(n, bool)
    best, low, high = np.full(n, np.inf), np.full(n, n), np.full(n, n)
    at, edges = 0, []
    left[0] = False
    for _ in range(n - 1):
        d = np.maximum(np.maximum(distances(x[at : at + 1], x)[0], core), core[at])
        lo, hi = np.minimum(rows, at), np.maximum(rows, at)
        closer = left & ((d < best) | ((d == best) & ((lo < low) | ((lo == low) & (hi < high)))))
        best[closer], low[closer], high[closer] = d[closer], lo[closer], hi[closer]
        tied = np.flatnonzero(left & (best == best[left].min()))
        at = int(tied[np.lexsort((high[tied], low[tied]))[0]])
        edges.append((low[at], high[at], best[at]))
        left[at] = False
    low, high, weight = zip(*edges, strict=True) if edges else ((), (), ())
    return np.array(low, np.int64), np.array(high, np.int64), np.array(weight, float)


def merges(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(edge, one tree, the other) of each edge, taken in order, that joins two trees. Rows are trees 0 to n - 1, and the k-th
    edge that joins makes tree n + k."""
    parent, out = list(range(2 * n)), []

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for k, (p, q) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        ra, rb = root(p), root(q)
        if ra != rb:
            parent[ra] = parent[rb] = n + len(out)
            out.append((k, ra, rb))
    return out


def ordered(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """The edges by weight, lower and higher point; the points; both ends as places among the points."""
    pdf = pdf.sort_values(["weight", "a", "b"])
    ends = pdf[["a", "b"]].to_numpy()
    points, places = np.unique(ends, return_inverse=True)
    places = places.reshape(ends.shape)
    return pdf, points, places[:, 0], places[:, 1]


def sure_edges(a: np.ndarray, b: np.ndarray, weight: np.ndarray, escape: np.ndarray) -> np.ndarray:
    """Which edges of a block's tree, by weight, are in the whole tree too: the least that leaves one of the two trees it joins,
    and below all that can leave that tree for another block. ``escape`` bounds those of each point."""
    parent, least, stuck = list(range(len(escape))), escape.tolist(), [False] * len(escape)
    out = np.zeros(len(a), bool)

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for k, (p, q, w) in enumerate(zip(a.tolist(), b.tolist(), weight.tolist(), strict=True)):
        p, q = root(p), root(q)
        out[k] = (not stuck[p] and w < least[p]) or (not stuck[q] and w < least[q])
        if out[k]:
            parent[q], least[p], stuck[p] = p, min(least[p], least[q]), stuck[p] or stuck[q]
        else:
            stuck[p] = stuck[q] = True
    return out


def local_trees(points: DataFrame, blocks: Blocks) -> DataFrame:
    """The edges of the spanning tree of each block's points of a component, with ``sure`` (:func:`sure_edges`), written."""

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for component, part in pdf.groupby("component"):
            part = part.sort_values("point")
            ids, x, core = part["point"].to_numpy(np.int64), stacked(part["features"]), part["core"].to_numpy(float)
            a, b, weight = spanning_tree(x, core)
            order = np.lexsort((b, a, weight))
            a, b, weight = a[order], b[order], weight[order]
            sure = sure_edges(a, b, weight, np.maximum(core, blocks.nearest_other(x, int(part["block"].iloc[0]))))
            found.append(pd.DataFrame({"component": component, "a": ids[a], "b": ids[b], "weight": weight, "sure": sure}))
        return pd.concat(found)

    return written(points.groupBy("block").applyInPandas(grow, EDGE + ", sure boolean"), "local")


def pivot_edges(points: DataFrame, blocks: Blocks) -> DataFrame:
    """Edges that join all blocks of one component: a point of each with its pivot, and the pivots' own tree."""
    spark = points.sparkSession
    pivots = spark.createDataFrame([(int(p), k) for k, p in enumerate(blocks.pivot_points)], "point long, k int")
    known = {r["k"]: r["core"] for r in points.join(F.broadcast(pivots), "point").select("k", "core").collect()}
    core = np.array([known[k] for k in range(len(blocks.pivots))])
    # the tree's ends in the order of the points' numbers
    order = np.argsort(blocks.pivot_points)
    a, b, weight = spanning_tree(blocks.pivots[order], core[order])
    ids = blocks.pivot_points[order]
    between = spark.createDataFrame([(0, int(ids[p]), int(ids[q]), float(w)) for p, q, w in zip(a, b, weight, strict=True)], EDGE)

    def inward(pdf: pd.DataFrame) -> pd.DataFrame:
        d = np.maximum(distances(stacked(pdf["features"]), blocks.pivots), np.maximum(pdf["core"].to_numpy(float)[:, None], core[None, :]))
        d[pdf["point"].to_numpy()[:, None] == blocks.pivot_points[None, :]] = np.inf
        k = d.argmin(axis=1)
        point, pivot = pdf["point"].to_numpy(), blocks.pivot_points[k]
        out = pd.DataFrame({"component": 0, "a": np.minimum(point, pivot), "b": np.maximum(point, pivot), "weight": d[np.arange(len(d)), k]})
        return out[np.isfinite(out["weight"])]

    one = points.groupBy("block").agg(F.min(F.struct("point", "features", "core")).alias("p")).select("p.*")
    return between.unionByName(one.mapInPandas(lambda batches: (inward(pdf) for pdf in batches), EDGE))


def contracted(pairs: DataFrame) -> DataFrame:
    """(node, component) of ``pairs(tree, other)``: up to JOINED of them in one task, more by stars."""
    if pairs.count() > JOINED:
        return components(pairs, "tree", "other")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ends = np.concatenate([np.empty((0, 2), np.int64), *(pdf[["tree", "other"]].to_numpy(np.int64) for pdf in batches)])
        nodes, places = np.unique(ends, return_inverse=True)
        parent = list(range(len(nodes)))

        def root(v: int) -> int:
            while parent[v] != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        for p, q in places.reshape(-1, 2).tolist():
            p, q = root(p), root(q)
            # the least place is the smallest node
            parent[max(p, q)] = min(p, q)
        yield pd.DataFrame({"node": nodes, "component": nodes[[root(v) for v in range(len(nodes))]]})

    return written(pairs.select("tree", "other").repartition(1).mapInPandas(run, "node long, component long"), "components")


def spanning_trees(points: DataFrame, blocks: Blocks, links: DataFrame | None = None) -> DataFrame:
    """component, a, b, weight: the edges of the spanning tree by mutual reachability of each component of
    ``points(point, features, block, core, component)``. ``links(component, a, b, weight)`` hold each component together, and if
    points have ``far``, all edges of points nearer than that are among them.

    The sure edges of the blocks' trees come first. Then, in rounds, each tree but the largest of a component gets the least
    edge that leaves it. What leaves it inside a block is in the block's tree, and with ``links`` that bounds what another
    block must offer; a point searches only if that bound reaches beyond ``far``. A search finds the nearest points outside the
    tree too, so ``far`` grows and most points search once. While half of the trees can do without a search, the others wait.
    Trees that are their whole component are done and neither search nor are searched.
    """
    points = points if "far" in points.columns else points.withColumn("far", F.lit(0.0))
    local = local_trees(points, blocks)
    if len(blocks.ids) == 1:
        return local.drop("sure")
    tree = local.where("sure").drop("sure")
    known = local.where("NOT sure").drop("sure").unionByName(links if links is not None else pivot_edges(points, blocks))
    known = known.withColumn("ta", F.col("a")).withColumn("tb", F.col("b"))
    now = components(tree, "a", "b")
    state = points.select("point", "block", "component", "core", "far", F.col("point").alias("tree"))
    least = F.min(F.struct("weight", "a", "b", "component", "other")).alias("e")
    while True:
        # ``now`` are trees of the last round (points, at first) with the tree that they are in
        grown = lambda df, x: df.join(now.select(F.col("node").alias(x), F.col("component").alias("_t")), x, "left").withColumn(x, F.coalesce("_t", x)).drop("_t")  # noqa: B023, E731
        state = written(grown(state, "tree"), "state")
        sizes = written(state.groupBy("component", "tree").count(), "sizes")
        todo = written(sizes.groupBy("component").agg(F.count("*").alias("trees"), F.max_by("tree", F.struct("count", "tree")).alias("largest")).where("trees > 1"), "todo")
        if todo.isEmpty():
            return tree
        # of the edges between two trees only the least can be in the whole tree
        known = grown(grown(known, "ta"), "tb").where("ta <> tb").groupBy(F.least("ta", "tb").alias("ta"), F.greatest("ta", "tb").alias("tb")).agg(F.min(F.struct("weight", "a", "b", "component")).alias("e"))
        known = written(known.select("e.*", "ta", "tb"), "known")
        leaving = known.select("*", F.explode(F.array(F.struct(F.col("ta").alias("tree"), F.col("tb").alias("other")), F.struct(F.col("tb").alias("tree"), F.col("ta").alias("other")))).alias("t")).select("weight", "a", "b", "component", "t.*")
        bounds = leaving.groupBy("tree").agg(least).select("tree", "e.*")
        bounds = written(bounds.join(todo.select(F.col("largest").alias("tree")), "tree", "left_anti"), "bounds")
        rows = state.join(bounds.select("tree", F.col("weight").alias("bound")), "tree").where("core <= bound AND far <= bound")
        rows = written(rows.select("point", "tree", "bound"), "rows")
        n, best = rows.count(), bounds
        doubtful = rows.select("tree").distinct()
        if n and 2 * doubtful.count() <= bounds.count():
            best = bounds.join(doubtful, "tree", "left_anti")
        elif n:
            found = search(points, state.join(todo, "component", "left_semi"), rows, n, blocks)
            best = bounds.unionByName(found.where("edge").select("tree", "weight", "a", "b", "component", "other")).groupBy("tree").agg(least).select("tree", "e.*")
            near = found.where("NOT edge")
            new = near.select("component", "tree", "point", F.explode("near").alias("n")).select("n.w", "component", F.least("point", "n.q").alias("a"), F.greatest("point", "n.q").alias("b"), F.col("tree").alias("ta"), F.col("n.t").alias("tb"))
            known = known.unionByName(new.withColumnRenamed("w", "weight"))
            state = state.join(near.select("point", F.col("reach").alias("_f")), "point", "left").withColumn("far", F.greatest("far", "_f")).drop("_f")
        best = written(best.select("component", "a", "b", "weight", "tree", "other"), "best")
        tree = tree.unionByName(best.select("component", "a", "b", "weight").distinct())
        now = contracted(best)


def search(points: DataFrame, state: DataFrame, rows: DataFrame, n: int, blocks: Blocks) -> DataFrame:
    """What ``rows(point, tree, bound)`` find in other blocks outside their trees, written; ``n`` is their number.

    Rows with ``edge``: the least edge (weight, a, b, component, other) that leaves a tree within its bound, of each part of the
    search that found any. Others: for each point ``near`` are structs (d, q, w, t), distance, point, weight and tree, and all
    points nearer than ``reach`` outside the tree are among them.
    """
    # a row for each block
    facts = {r["block"]: r for r in state.groupBy("block").agg(F.min("core").alias("core"), F.min("tree").alias("low"), F.max("tree").alias("high")).collect()}
    core = np.array([facts[b]["core"] if b in facts else np.inf for b in blocks.ids.tolist()], float)
    low = np.array([facts[b]["low"] if b in facts else 0 for b in blocks.ids.tolist()], np.int64)
    one = np.array([b in facts and facts[b]["low"] == facts[b]["high"] for b in blocks.ids.tolist()], bool)

    def keep(lot: pd.DataFrame, row: np.ndarray, block: np.ndarray) -> np.ndarray:
        return (core[block] <= lot["bound"].to_numpy(float)[row]) & ~(one[block] & (low[block] == lot["tree"].to_numpy()[row]))

    def run(come: pd.DataFrame, x: Flat, meetings: Iterator[tuple[pd.DataFrame, Flat]]) -> pd.DataFrame:
        column = lambda pdf, c: pdf[c].to_numpy()
        ids, mine, part, cores = (column(come, c) for c in ("point", "tree", "component", "core"))
        trees, at = np.unique(mine, return_inverse=True)
        least, reach, best, out = np.full(len(trees), np.inf), column(come, "bound").astype(float).copy(), Nearest(NEAR), []
        np.minimum.at(least, at, column(come, "least"))
        for there, y in meetings:
            # trees lie in one component each
            i, j, d = metric.within(x, y, np.maximum(least[at], reach), (mine, column(there, "tree")))
            same = part[i] == column(there, "component")[j]
            i, j, d = i[same], j[same], d[same]
            w, q, t = np.maximum(d, np.maximum(cores[i], column(there, "core")[j])), column(there, "point")[j], column(there, "tree")[j]
            ok = w <= least[at[i]]
            out.append(pd.DataFrame({"tree": mine[i[ok]], "weight": w[ok], "a": np.minimum(ids[i[ok]], q[ok]), "b": np.maximum(ids[i[ok]], q[ok]), "component": part[i[ok]], "other": t[ok], "edge": True}))
            out = [pd.concat(out).sort_values(["weight", "a", "b"]).drop_duplicates("tree")]
            np.minimum.at(least, np.searchsorted(trees, out[0]["tree"]), out[0]["weight"].to_numpy(float))
            inside = d <= reach[i]
            best.add(i[inside], d[inside], q[inside], w[inside], t[inside])
            best.tighten(reach)
        i, kept = best.lists()
        lists = dict(zip("dqwt", (pd.Series(k, dtype=object) for k in kept), strict=False)) if len(i) else {}
        # ids would become doubles beside what is missing
        near = pd.DataFrame({"tree": mine[i], "component": part[i], "point": ids[i], "weight": 0.0, "a": 0, "b": 0, "other": 0, "edge": False, **lists})
        edges = [x.assign(point=0, d=None, q=None, w=None, t=None) for x in out if len(x)]
        return pd.concat([near, *edges] if len(near) else edges)[names] if len(near) or edges else pd.DataFrame(columns=names)

    names = ["point", "tree", "component", "weight", "a", "b", "other", "edge", "d", "q", "w", "t"]
    members = written(points.select("point", "features").join(state, "point"), "open")
    rows = members.join(rows.select("point", F.col("bound").alias("least"), (F.col("bound") * SLACK).alias("bound")), "point")
    rows = written(rows, "come")
    schema = "point long, tree long, component long, weight double, a long, b long, other long, edge boolean, d array<double>, q array<long>, w array<double>, t array<long>"
    found = written(metric.meet(members, metric.probes(rows, blocks, keep, n), blocks, rows, run, schema), "found")
    near = found.where("NOT edge").groupBy("point").agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("d", "q", "w", "t")))), 1, NEAR).alias("near"))
    near = rows.select("point", "tree", "component", "bound").join(near, "point", "left")
    near = near.withColumn("reach", F.when(F.size("near") >= NEAR, F.least("bound", F.element_at("near", NEAR)["d"])).otherwise(F.col("bound"))).drop("bound")
    edges = found.where("edge").select("edge", "tree", "component", "weight", "a", "b", "other")
    return written(near.withColumn("edge", F.lit(False)).unionByName(edges, allowMissingColumns=True), "leaving")


#: What a tree holds of seeds' identities: none, or several; else the identity's number.
NONE, SEVERAL = -1, -2


def labels(a: np.ndarray, b: np.ndarray, weights: np.ndarray, n: int, min_cluster_size: int, epsilon: float, birth: float | None, identity: np.ndarray | None = None) -> np.ndarray:
    """Cluster of each of ``n`` points, -1 for noise, by excess of mass over the tree that is in the edges, given in order.

    ``birth``: lambda of the root if it may be a cluster. ``identity`` numbers the seeds' identities, NONE for other points.
    With it no cluster holds seeds of two identities: where a tree that does falls apart into two that hold seeds, both go
    on, whatever their size, and of the selections that are left one with the most pairs of seeds of an identity together is
    taken, then the most mass (Campello et al. 2013, with must-link and cannot-link constraints).
    """
    if n < max(2, min_cluster_size):
        return np.full(n, -1)
    # the dendrogram: node n + k joins the two trees of the k-th edge that joins any
    kids, size, weight = {}, np.ones(2 * n - 1, int), np.zeros(2 * n - 1)
    whose, seeds = np.full(2 * n - 1, NONE), np.zeros(2 * n - 1, int)
    if identity is not None:
        whose[:n], seeds[:n] = identity, identity != NONE
    for v, (k, ra, rb) in enumerate(merges(a, b, n), n):
        kids[v], size[v], weight[v] = (ra, rb), size[ra] + size[rb], weights[k]
        seeds[v] = seeds[ra] + seeds[rb]
        whose[v] = whose[ra] if whose[rb] in (NONE, whose[ra]) else whose[rb] if whose[ra] == NONE else SEVERAL
    inverse = lambda w: 1 / w if w > 0 else np.inf

    def points(v: int) -> list[int]:
        stack, out = [v], []
        while stack:
            u = stack.pop()
            if u < n:
                out.append(u)
            else:
                stack.extend(kids[u])
        return out

    born, up, stability, members, below, tops = [birth if birth is not None else 0.0], [-1], [0.0], [[]], [[]], [2 * n - 2]
    stack = [(2 * n - 2, 0)]
    while stack:
        v, c = stack.pop()
        if v < n:
            members[c].append(v)
            continue
        lam, (a, b) = inverse(weight[v]), kids[v]
        apart = whose[v] == SEVERAL and seeds[a] and seeds[b]
        big = [u for u in (a, b) if apart or size[u] >= min_cluster_size]
        gain = lambda m: 0.0 if np.isinf(lam) and np.isinf(born[c]) else m * (lam - born[c])  # noqa: B023, E731
        if len(big) == 2:
            stability[c] += gain(size[v])
            for u in big:
                born.append(lam), up.append(c), stability.append(0.0), members.append([]), below.append([]), tops.append(u)
                below[c].append(len(born) - 1)
                stack.append((u, len(born) - 1))
        else:
            for u in (a, b):
                if u in big:
                    stack.append((u, c))
                else:
                    stability[c] += gain(size[u])
                    members[c] += points(u)
    able = [(c or birth is not None) and whose[v] != SEVERAL and size[v] >= min_cluster_size for c, v in enumerate(tops)]
    picked, worth = [False] * len(born), [(0, 0.0)] * len(born)
    for c in range(len(born) - 1, -1, -1):
        inner = (sum(worth[k][0] for k in below[c]), sum(worth[k][1] for k in below[c]))
        own = (int(seeds[tops[c]]) * (int(seeds[tops[c]]) - 1) // 2, stability[c])
        picked[c] = able[c] and (not below[c] or own >= inner)
        worth[c] = own if picked[c] else inner
    out = np.full(n, -1)

    def everything(c: int) -> list[int]:
        todo, found = [c], []
        while todo:
            k = todo.pop()
            found += members[k]
            todo += below[k]
        return found

    chosen: list[int] = []
    todo = [0]
    while todo:
        c = todo.pop()
        if picked[c]:
            chosen.append(c)
        else:
            todo += below[c]
    if epsilon > 0:
        # a cluster born within epsilon gives way to its nearest ancestor born beyond it
        risen = set()
        for c in chosen:
            while c and born[c] > 1 / epsilon and up[c] >= 0 and able[up[c]]:
                c = up[c]
            risen.add(c)
        chosen = [c for c in risen if not any(a in risen for a in ancestors(c, up))]
    for k, c in enumerate(sorted(chosen)):
        out[everything(c)] = k
    return out


def ancestors(c: int, up: list[int]) -> list[int]:
    found = []
    while up[c] >= 0:
        c = up[c]
        found.append(c)
    return found


def cluster(rows: DataFrame, *, cut: float, min_cluster_size: int = 3, min_samples: int = 2, epsilon: float = 0.0, labelled: bool = False) -> DataFrame:
    """point, cluster_id for ``rows(point, features)``: clusters numbered by their smallest point, noise -1.

    ``labelled``: rows have an ``identity`` (a number; null for points that are no seeds), and no cluster holds seeds of two
    identities (:func:`labels`). Fewer than two points give no rows. Equal distances are ordered by the points' numbers.
    """
    n = rows.count()
    if n < 2:
        return rows.select("point", F.lit(NOISE).cast("long").alias("cluster_id")).limit(0)
    placed, blocks = metric.partition(rows, n)
    core = neighbours(placed, blocks, min_samples, max(NEAR, min_samples))
    near = core.select(F.col("point").alias("a"), F.explode("near").alias("n")).select("a", F.col("n.q").alias("b"), F.col("n.d").alias("d")).where("a <> b")
    near = written(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d").distinct(), "near")
    core = core.drop("near")
    several = False
    if math.isfinite(cut):
        parts, edges = within(core, blocks, cut, near.where(F.col("d") <= cut))
        parts = written(parts, "parts")
        several = parts.select("component").distinct().limit(2).count() > 1
        near = near.unionByName(edges)
        core = written(core.join(parts, "point"), "points")
    else:
        core = written(core.withColumn("component", F.lit(0).cast("long")), "points")
    end = lambda x: core.select(F.col("point").alias(x), F.col("core").alias(f"c{x}"), F.col("component").alias(f"k{x}"))
    held = near.join(end("a"), "a").join(end("b"), "b").where("ka = kb")
    links = held.select(F.col("ka").alias("component"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.greatest("d", "ca", "cb").alias("weight")).distinct()
    links = links if math.isfinite(cut) or len(blocks.ids) == 1 else links.unionByName(pivot_edges(core, blocks))
    birth = 1 / cut if several else None
    edges = spanning_trees(core, blocks, links)
    for x in ("a", "b"):
        seeds = rows.where("identity IS NOT NULL").select(F.col("point").alias(x), F.col("identity").cast("string").alias(f"i{x}")) if labelled else None
        edges = edges.join(seeds, x, "left") if labelled else edges

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, points, a, b = ordered(pdf)
        identity = None
        if labelled:
            identity, numbers = np.full(len(points), NONE), {}
            for places, names in ((a, pdf["ia"]), (b, pdf["ib"])):
                for place, name in zip(places.tolist(), names, strict=True):
                    if isinstance(name, str):
                        identity[place] = numbers.setdefault(name, len(numbers))
        found = labels(a, b, pdf["weight"].to_numpy(), len(points), min_cluster_size, epsilon, birth, identity)
        return pd.DataFrame({"component": pdf["component"].iloc[0], "point": points, "local": found})

    local = written(edges.groupBy("component").applyInPandas(tree, "component long, point long, local long").where("local >= 0"), "labels")
    firsts = local.groupBy("component", "local").agg(F.min("point").alias("first"))
    numbered = with_ordinal(firsts, [F.col("first")], "cluster_id").drop("first")
    # a point without an edge is in no cluster
    found = local.join(numbered, ["component", "local"]).select("point", "cluster_id")
    return rows.select("point").join(found, "point", "left").select("point", F.coalesce("cluster_id", F.lit(NOISE)).cast("long").alias("cluster_id"))


NOISE = -1
