"""Quality rules: gradient-boosted trees over document statistics, scored from flat node arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_ids, free_names, map_with_ids

FEATURES = (
    "log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "bang_share", "pipe_share",
    "digit_share", "punct_share", "distinct_share", "words_per_line", "symbols_per_word", "other_share",
)
#: -1: as the statistic rises, the score may not.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "bang_share": -1, "pipe_share": -1, "symbols_per_word": -1}
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
BLANKS = np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)
PUNCTUATION = np.frombuffer(b".,;:!?\"'()-", np.uint8)
WINDOW = 5


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """Words that lie in a window of five found at least twice, the first one included; and distinct words.

    Windows are numbered exactly: words get numbers, pairs of neighbours get numbers, then pairs of pairs, then five.
    """
    n, seen = len(words), {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if n <= WINDOW or len(seen) == n:
        return 0, len(seen)
    two = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)[1]
    if two.max() + 1 == len(two):
        return 0, len(seen)
    four = np.unique(two[:-2] * n + two[2:], return_inverse=True)[1]
    _, five, counts = np.unique(four[:-1] * n + ids[4:], return_inverse=True, return_counts=True)
    again = counts[five] > 1
    if not again.any():
        return 0, len(seen)
    cover = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + WINDOW, -1)
    return int((np.cumsum(cover)[:n] > 0).sum()), len(seen)


def statistics(raw: bytes | None) -> tuple[list[int], list[float]]:
    """[n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words] and the features of a whole text."""
    raw = raw or b""
    words = raw.split()  # blanks of bytes.split() are space and \t..\r
    n = len(words)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    points = len(raw) - int(hist[0x80:0xC0].sum())
    word_chars = points - int(hist[BLANKS].sum())
    n_symbols = int(hist[SYMBOLS].sum())
    lines = [line for line in raw.split(b"\n") if line.strip()] if n else []
    n_dup = len(lines) - len(set(lines))
    n_repeat, distinct = repeated_words(words) if n else (0, 0)
    c, w = max(1, word_chars), max(1, n)
    features = [
        np.log1p(n), word_chars / w, n_symbols / c, n_dup / max(1, len(lines)), n_repeat / w, int(hist[65:91].sum()) / c, int(hist[33]) / c, int(hist[124]) / c,
        int(hist[48:58].sum()) / c, int(hist[PUNCTUATION].sum()) / c, distinct / w, np.log1p(n / max(1, len(lines))), n_symbols / w, int(hist[0xC0:].sum()) / c,
    ]
    return [n, word_chars, n_symbols, n_dup, n_repeat], features


@dataclass
class Trees:
    """All trees' nodes in one set of arrays; a leaf points to itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float
    cut: float = 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities; every row walks every tree at once, a level a step."""
        if not len(self.roots):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        rows = np.arange(len(x))[:, None]
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, *, trees: int = 60, depth: int = 3, bins: int = 64, rate: float = 0.15, smooth: float = 2.0, least: int = 8) -> Trees:
    """Boosted trees for log loss on binned features.

    Of a constrained feature a split is taken only if its sides' values lie in the constraint's order, and the middle of
    the two bounds both subtrees, so the order holds in the whole tree.
    """
    nodes: list[list[float]] = []
    p = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
    base = float(np.log(p / (1 - p)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1) if len(x) else np.zeros(x.shape, int)
    raw, roots = np.full(len(y), base), []

    def leaf(value: float) -> int:
        k = len(nodes)
        nodes.append([0, np.inf, k, k, value])
        return k

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        gs, hs = g[rows].sum(), h[rows].sum()
        value = float(np.clip(gs / (hs + smooth), low, high))
        best = (1e-6, -1, -1, 0.0, 0.0)
        if level < depth and len(rows) >= 2 * least:
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                c = codes[rows, j]
                gl, hl, nl = (np.cumsum(np.bincount(c, w, len(e) + 1))[:-1] for w in (g[rows], h[rows], None))
                vl, vr = np.clip(gl / (hl + smooth), low, high), np.clip((gs - gl) / (hs - hl + smooth), low, high)
                gain = gl**2 / (hl + smooth) + (gs - gl) ** 2 / (hs - hl + smooth) - gs**2 / (hs + smooth)
                ok = (nl >= least) & (len(rows) - nl >= least)
                if monotone[j]:
                    ok &= (vr - vl) * monotone[j] >= 0
                gain = np.where(ok, gain, -1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k, float(vl[k]), float(vr[k]))
        _, j, k, vl, vr = best
        if j < 0:
            return leaf(value)
        me = len(nodes)
        nodes.append([j, float(edges[j][k]), 0, 0, value])
        goes, middle = codes[rows, j] <= k, (vl + vr) / 2
        bounds = [(low, high), (low, high)]
        if monotone[j]:
            bounds = [(low, middle), (middle, high)] if monotone[j] > 0 else [(middle, high), (low, middle)]
        nodes[me][2] = grow(rows[goes], g, h, level + 1, *bounds[0])
        nodes[me][3] = grow(rows[~goes], g, h, level + 1, *bounds[1])
        return me

    for _ in range(trees if len(y) and 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-raw))
        first = len(nodes)
        roots.append(grow(np.arange(len(y)), y - p, p * (1 - p), 0, -4.0, 4.0))
        for node in nodes[first:]:
            node[4] *= rate
        at = np.full(len(y), roots[-1])
        a = np.array(nodes)
        for _ in range(depth):
            at = np.where(x[np.arange(len(y)), a[at, 0].astype(int)] <= a[at, 1], a[at, 2], a[at, 3]).astype(int)
        raw = raw + a[at, 4]
    a = np.array(nodes).reshape(-1, 5)
    return Trees(np.array(roots, int), a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4], depth, base)


def sparing_cut(p: np.ndarray, y: np.ndarray, loss: float = 0.01, most: float = 0.3) -> float:
    """A cut up to ``most`` that rejects at most a share ``loss`` of the good texts (1): a quarter of the way from the bad texts
    below it, so that good texts unlike the labelled ones stay too."""
    good = np.sort(p[y == 1])
    top = float(min(most, good[int(loss * len(good))])) if len(good) else most
    low = float(p[(y == 0) & (p < top)].max(initial=0.0))
    return low + (top - low) / 4


def train(docs: DataFrame, labels: DataFrame, *, limit: int = 20_000, seed: int = 5, **options) -> Trees:
    """Fits on at most ``limit`` labelled rows in seeded order; only their statistics reach the driver.

    Every fifth row places the cut between kept and rejected texts and fits nothing else. Without labels all score alike and
    the base rule alone rejects. Null labels and doc_ids are left out; of a repeated doc_id the worst label and the text of the
    smallest statistics count, so there is a row for each chosen id and reruns agree.
    """
    chosen = bounded_ids(labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")), "doc_id", limit, seed)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``limit`` ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "quality": pdf["quality"], "x": [statistics(t)[1] for t in pdf["text"]]})

    found = rows.select("doc_id", F.col("text").cast("binary").alias("text"), "quality").mapInPandas(run, "doc_id long, quality int, x array<double>")
    found = found.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("x").alias("x")).toPandas().sort_values("doc_id")
    x = np.array(found["x"].tolist(), float).reshape(-1, len(FEATURES))
    y, probe = found["quality"].to_numpy(float), np.arange(len(x)) % 5 == 4
    model = fit(x[~probe], y[~probe], np.array([MONOTONE.get(f, 0) for f in FEATURES]), **options)
    model.cut = sparing_cut(model.score(x[probe]), y[probe]) if len(model.roots) else 0.0
    return model


def scored(texts: pd.Series, model: Trees) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The five base statistics, the trees' score, whether the base rule fails, and whether the text is kept."""
    found = [statistics(t) for t in texts]
    base = np.array([f[0] for f in found], np.int64).reshape(-1, 5)
    p = model.score(np.array([f[1] for f in found], float).reshape(-1, len(FEATURES)))
    failed = (base[:, 0] < 10) | (100 * base[:, 4] > 20 * base[:, 0])
    return base, p, failed, ~failed & (p >= model.cut)


def accepted(docs: DataFrame, model: Trees) -> DataFrame:
    """The rows of ``docs`` that :func:`assess` keeps, with their columns; a column of any name may be among them."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    (name,) = free_names(docs.columns, "kept")

    @F.pandas_udf("boolean")
    def verdict(texts: pd.Series) -> pd.Series:
        return pd.Series(scored(texts, sent.value)[3])

    return docs.withColumn(name, verdict(F.col("text").cast("binary"))).where(F.col(name)).select(*docs.columns)


def assess(docs: DataFrame, model: Trees) -> DataFrame:
    """Base statistics, the base rule and the verdict for every whole text.

    Base rule: fails under 10 words, or if over a fifth of the words lie in repeated windows. ``kept`` is false then, else
    whether the trees' probability of good quality reaches the model's ``cut``. Null and empty texts have 0 words and fail.
    Repeated rows and null doc_ids give a row each. Very long texts are read whole; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            base, p, failed, kept = scored(pdf["text"], sent.value)
            out = pd.DataFrame(base, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])
            yield out.assign(doc_id=pdf["doc_id"].values, base_failed=failed, kept=kept, score=p)

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return map_with_ids(rows, run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double", "doc_id")
