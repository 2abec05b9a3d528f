"""Approximate nearest neighbours: balanced posting lists behind a graph over their centroids."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_ids, written

#: Vectors a list should hold, rows of the sample that places the centroids, and sample rows a centroid needs.
LIST_ROWS, SAMPLE_ROWS, ROWS_A_CENTROID = 256, 20_000, 16
#: A vector stands in at most so many lists, and in those whose centroid is at most so much farther than the nearest.
REPLICAS, BOUNDARY = 4, 1.1
#: Rows that walk the graph together: their neighbours' vectors are in memory at once.
WALK_ROWS = 256
#: Rows of a block of a list, and of the queries that meet it.
BLOCK_ROWS = 4096
#: Pairs of a query and a vector whose components are in memory at once, besides one query's with a block.
PAIRS = 1 << 16


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the vectors that take part; of unequal vectors with one vec_id, the smallest in array order."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select("vec_id", v.cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
    return rows.where(fine).where(norm(F.col("embedding")) > 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


@dataclass
class Lists:
    """Centroids of unit length, their neighbour graph, and the distance ratio up to which a query visits lists.

    ``held``: per list, results its vectors can give at least, each vector counted in its nearest list alone.
    """

    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray
    ratio: float
    held: np.ndarray | None = None

    def search(self, x: np.ndarray, beam: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest centroids found of each row of ``x``, nearest first, and their distances."""
        parts = [self._walk(x[a : a + WALK_ROWS], beam, wide) for a in range(0, len(x), WALK_ROWS)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _walk(self, x: np.ndarray, beam: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
        """One block of rows of :meth:`search`.

        A best-first walk of the graph by all rows at once: each step opens the ``wide`` nearest centroids of a row's beam
        that are not open yet, until a row's whole beam is open.
        """
        n, k = len(x), len(self.centroids)
        beam = min(beam, k)
        seen = np.zeros((n, k), bool)
        seen[:, self.entries] = True
        ids = np.broadcast_to(self.entries, (n, len(self.entries)))
        sims = x @ self.centroids[self.entries].T
        opened = np.zeros(ids.shape, bool)
        rows = np.arange(n)[:, None]

        def best(ids, sims, opened):
            if ids.shape[1] < beam:
                more = beam - ids.shape[1]
                ids, sims, opened = np.pad(ids, ((0, 0), (0, more))), np.pad(sims, ((0, 0), (0, more)), constant_values=-np.inf), np.pad(opened, ((0, 0), (0, more)), constant_values=True)
            order = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
            return ids[rows, order], sims[rows, order], opened[rows, order]

        ids, sims, opened = best(ids, sims, opened)
        while not opened.all():
            rank = np.argsort(opened, axis=1, kind="stable")[:, :wide]
            fresh = ~opened[rows, rank]
            opened[rows, rank] = True
            near = self.graph[ids[rows, rank]]
            near = np.where(fresh[:, :, None], near, near[:, :1, :1]).reshape(n, -1)
            new = ~seen[rows, near]
            order = np.argsort(near, axis=1, kind="stable")
            twice = np.zeros(near.shape, bool)
            ranked = near[rows, order]
            twice[:, 1:] = ranked[:, 1:] == ranked[:, :-1]
            new[rows, order] &= ~twice
            new &= np.repeat(fresh, self.graph.shape[1], axis=1)
            seen[rows, near] |= new
            found = np.where(new, np.einsum("nd,nkd->nk", x, self.centroids[near]), -np.inf)
            ids, sims, opened = best(np.concatenate([ids, near], 1), np.concatenate([sims, found], 1), np.concatenate([opened, ~new], 1))
        return ids, np.sqrt(np.maximum(0, 2 - 2 * sims))

    def places(self, x: np.ndarray) -> list[np.ndarray]:
        """Lists of each row: its nearest, and near ones beyond the boundary in other directions than those it has."""
        ids, d = self.search(x, max(16, 2 * REPLICAS))
        out = []
        for near, dist in zip(ids, d, strict=True):
            chosen = [near[0]]
            for c, dc in zip(near[1:], dist[1:], strict=True):
                if len(chosen) == REPLICAS or not dc <= BOUNDARY * dist[0]:
                    break
                gap = np.sqrt(np.maximum(0, 2 - 2 * self.centroids[chosen] @ self.centroids[c]))
                if (gap >= dc).all():
                    chosen.append(c)
            out.append(np.array(chosen))
        return out

    def visits(self, x: np.ndarray, least: int = 0) -> list[np.ndarray]:
        """Lists a query visits: all whose centroid is at most ``ratio`` times as far as the nearest.

        Where that and nearer lists hold no more than ``least`` (a query is no result of its own), the ratio counts from the
        list with which they do; if all together hold too few, all are visited. The beam doubles until its farthest list is
        beyond the ratio, so the ratio alone decides.
        """
        out: list[np.ndarray | None] = [None] * len(x)
        left, beam = np.arange(len(x)), 64
        while len(left):
            ids, d = self.search(x[left], beam)
            real, reach, enough = np.isfinite(d), d[:, 0], np.ones(len(d), bool)
            if self.held is not None:
                more = np.cumsum(np.where(real, self.held[ids], 0), axis=1) > least
                enough = more.any(axis=1)
                reach = np.where(enough, d[np.arange(len(d)), more.argmax(axis=1)], np.inf)
            inside = real & (d <= self.ratio * np.maximum(reach, 1e-12)[:, None])
            for row, near, ok in zip(left, ids, inside, strict=True):
                out[row] = near[ok]
            go = inside.all(axis=1) | ~enough
            left, beam = (left[go] if beam < len(self.centroids) else left[:0]), 2 * beam
        return out  # type: ignore[return-value]


def fit(sample: np.ndarray, rows: int, *, rounds: int = 10, degree: int = 16, recall: float = 0.98, probes: int = 400, seed: int = 7) -> Lists:
    """Balanced spherical k-means on the sample, the graph, and the ratio that reaches ``recall`` on the sample.

    The sample is sparser than the table, so its neighbours lie farther and the ratio errs on the wide side.
    """
    rng = np.random.default_rng(seed)
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    k = int(max(1, min(rows // LIST_ROWS, len(x) // ROWS_A_CENTROID)))
    c = x[rng.choice(len(x), k, replace=False)]
    fair, held = len(x) / k, np.full(k, len(x) / k)
    for _ in range(rounds):
        total, count = np.zeros_like(c), np.zeros(k)
        for a in range(0, len(x), 2048):
            # a list over its fair share seems farther
            s = x[a : a + 2048] @ c.T - 0.05 * np.maximum(0, held / fair - 1)
            at = s.argmax(axis=1)
            np.add.at(total, at, x[a : a + 2048])
            count += np.bincount(at, minlength=k)
        empty = count == 0
        total[empty] = x[rng.choice(len(x), int(empty.sum()))]
        c = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
        held = (held + count) / 2
    degree = min(degree, k - 1) if k > 1 else 0
    graph = np.zeros((k, max(1, degree + (4 if k > 1 else 0))), np.int64)
    for a in range(0, k, 1024):
        s = c[a : a + 1024] @ c.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        if degree:
            graph[a : a + 1024, :degree] = np.argsort(-s, axis=1, kind="stable")[:, :degree]
    if degree:
        # a ring and far edges, so that every list can be reached
        graph[:, degree] = (np.arange(k) + 1) % k
        graph[:, degree + 1 :] = rng.integers(0, k, (k, 3))
    lists = Lists(c, graph, np.arange(0, k, max(1, k // 32))[:64], np.inf)
    if k > 1:
        pick = rng.choice(len(x), min(probes, len(x)), replace=False)
        placed = lists.places(x)
        dist = np.sqrt(np.maximum(0, 2 - 2 * x[pick] @ c.T))
        need = []
        for q, own in zip(pick, dist, strict=True):
            s = x @ x[q]
            s[q] = -np.inf
            need += [own[placed[v]].min() / max(own.min(), 1e-12) for v in np.argsort(-s, kind="stable")[:5]]
        lists.ratio = float(np.quantile(need, recall))
    return lists


def first_k(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Rows that are among the first k of their ``q``, highest score first, ties to the smaller id."""
    order = np.lexsort((ids, -score, q))
    ranked = q[order]
    first = np.r_[True, ranked[1:] != ranked[:-1]] if len(q) else np.zeros(0, bool)
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0)) if len(q) else np.zeros(0, int)
    return order[rank < k]


def nearest(block: np.ndarray, members: list[np.ndarray], queries: np.ndarray, query_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score): per query its k nearest, by cosine in doubles, ties to the smaller id.

    A row of the block stands for the equal vectors ``members``: ids in ascending order, k + 1 of them at most, as a query is
    no neighbour of its own. A matrix product finds what can be among the nearest, up to rounding; each of those is then
    scored alike, at most about PAIRS at a time, and the best k + 1 rows give their members.
    """
    ids, size = np.array([m[0] for m in members]), np.array([len(m) for m in members])
    start, flat = np.cumsum(size) - size, np.concatenate(members)
    bn, qn = np.sqrt(np.einsum("ij,ij->i", block, block)), np.sqrt(np.einsum("ij,ij->i", queries, queries))
    rough = (queries / qn[:, None]) @ (block / bn[:, None]).T
    rough[(query_ids[:, None] == ids[None, :]) & (size == 1)] = -np.inf
    if rough.shape[1] > k + 1:
        bar = np.partition(rough, -(k + 1), axis=1)[:, -(k + 1)]
    else:
        bar = np.full(len(rough), -2.0)
    may = rough >= np.maximum(bar, -2.0)[:, None] - 1e-9
    lot = np.cumsum(may.sum(axis=1)) // PAIRS
    out = []
    for part in np.split(np.arange(len(lot)), np.flatnonzero(np.diff(lot)) + 1):
        q, v = np.nonzero(may[part])
        q = part[q]
        score = np.einsum("ij,ij->i", queries[q], block[v]) / (qn[q] * bn[v])
        best = first_k(q, ids[v], score, k + 1)
        q, v, score = q[best], v[best], score[best]
        n = size[v]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        q, score, found = np.repeat(q, n), np.repeat(score, n), flat[np.repeat(start[v], n) + within]
        other = found != query_ids[q]
        q, score, found = q[other], score[other], found[other]
        best = first_k(q, found, score, k)
        out.append((query_ids[q[best]], found[best], score[best]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))  # type: ignore[return-value]


def stacked(s: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in s])


def search(vectors: DataFrame, *, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``every``, the ``k`` nearest other rows found.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor does a null vec_id; rows of one
    vec_id count once. A query's candidates are the vectors of its length: each length has lists of its own. An empty table
    gives an empty result. Other columns of any name are not read.
    """
    rows = written(usable(vectors), "vectors")
    found = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = sorted(r["dim"] for r in rows.select(F.size("embedding").alias("dim")).distinct().collect())
    parts = [search_alike(rows.where(F.size("embedding") == dim) if len(lengths) > 1 else rows, every, k) for dim in lengths]
    return functools.reduce(DataFrame.unionByName, parts) if parts else found


def search_alike(rows: DataFrame, every: int, k: int) -> DataFrame:
    """:func:`search` over the written ``rows(vec_id, embedding)`` of one length."""
    spark, schema = rows.sparkSession, "query_id long, vec_id long, score double"
    # equal vectors are one, with the ids that can be results; every partition sends k + 1 rows of a vector at most
    order = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    distinct = few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
    distinct = written(distinct.select(F.element_at("members", 1).alias("vec_id"), "embedding", "members"), "distinct")
    n = distinct.count()
    sample = bounded_ids(distinct.select("vec_id", "embedding"), "vec_id", SAMPLE_ROWS, 3).toPandas().sort_values("vec_id")  # at most SAMPLE_ROWS vectors
    lists = fit(stacked(sample["embedding"]), n)

    def placed(lists: Lists, way: str, *more):
        sent = spark.sparkContext.broadcast(lists)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for a in range(0, len(pdf), 1000):
                    part = pdf.iloc[a : a + 1000]
                    x = stacked(part["embedding"])
                    where = getattr(sent.value, way)(x / np.linalg.norm(x, axis=1, keepdims=True), *more)
                    yield pd.DataFrame({"vec_id": part["vec_id"].values, "list": where, "embedding": part["embedding"].values, "members": part["members"].values})

        return run

    kind = "vec_id long, list array<int>, embedding array<double>, members array<long>"
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = distinct.repartition(tasks, "vec_id")
    asking = rows.where(F.col("vec_id") % every == 0).select("vec_id", "embedding", F.array("vec_id").alias("members")).repartition(tasks, "vec_id")
    posted = written(spread.mapInPandas(placed(lists, "places"), kind), "postings")
    # one row a list
    first = posted.groupBy(F.element_at("list", 1).alias("list")).agg(F.sum(F.size("members")).alias("n")).toPandas()
    held = np.zeros(len(lists.centroids), np.int64)
    held[first["list"].to_numpy(int)] = first["n"]
    posted = posted.select(F.explode("list").alias("list"), "vec_id", "embedding", "members")
    asked = written(asking.mapInPandas(placed(replace(lists, held=held), "visits", k), kind), "visits").select(F.explode("list").alias("list"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    # one row a list: at most SAMPLE_ROWS / ROWS_A_CENTROID lists
    sizes = posted.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("cuts"))
    loads = asked.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("lots"))
    blocks = F.broadcast(written(sizes.join(loads, "list"), "blocks"))
    posted = posted.join(blocks, "list").withColumn("cut", F.pmod(F.xxhash64("vec_id"), "cuts")).withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
    asked = asked.join(blocks, "list").withColumn("lot", F.pmod(F.xxhash64("query_id"), "lots").cast("int")).withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    posted = posted.select("list", F.col("cut").cast("int").alias("cut"), "lot", "vec_id", "embedding", "members")
    asked = asked.select("list", "cut", "lot", "query_id", "query")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        q, v, s = nearest(stacked(left["embedding"]), [np.asarray(m, np.int64) for m in left["members"]], stacked(right["query"]), right["query_id"].to_numpy(), k)
        return pd.DataFrame({"query_id": q, "vec_id": v, "score": s})

    key = ("list", "cut", "lot")
    met = posted.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(meet, schema)
    met = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
