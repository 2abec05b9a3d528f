"""Toxicity: a convolutional classifier over hashed word embeddings, in numpy, with thresholds by language."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_ids, map_with_ids, written

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 17, 8, (1, 2, 3), 8
#: Words whose buckets a Python worker remembers.
CACHE = 1 << 20
STRIP = b".,;:!?\"'()[]{}#*$%&|<>"


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of the doc_id as text leaves 1 modulo 3. A null doc_id: false."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def word_ids(raw: bytes | None, cache: dict[bytes, int]) -> np.ndarray:
    """The buckets of a text's words, lower-cased and stripped of ASCII punctuation; 0 is for none."""
    words = raw.lower().split() if raw else []
    if len(cache) > CACHE:
        cache.clear()
    out = np.empty(len(words), np.int32)
    for k, w in enumerate(words):
        i = cache.get(w)
        if i is None:
            bare = w.strip(STRIP)
            i = cache[w] = 1 + xxhash.xxh3_64_intdigest(bare) % (BUCKETS - 1) if bare else 0
        out[k] = i
    return out


@dataclass
class Model:
    """Embeddings, one kernel per width, the output layer, a calibration of the logit, and thresholds by language."""

    embed: np.ndarray
    kernels: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    default: float = 0.7

    def tables(self) -> list[list[np.ndarray]]:
        """Per width and place the filters' answer to each bucket, so that scoring is looking up and adding."""
        return [[self.embed @ k[j] for j in range(w)] for w, k in zip(WIDTHS, self.kernels, strict=True)]

    def features(self, ids: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """Max-pooled filter answers over the whole text; a text shorter than a filter is padded with bucket 0."""
        pooled = []
        for w, t, b in zip(WIDTHS, tables, self.biases, strict=True):
            x = ids if len(ids) >= w else np.concatenate([ids, np.zeros(w - len(ids), ids.dtype)])
            n = len(x) - w + 1
            total = t[0][x[:n]]
            for j in range(1, w):
                total = total + t[j][x[j : j + n]]
            pooled.append(np.maximum(total.max(axis=0) + b, 0))
        return np.concatenate(pooled)

    def logits(self, texts: list[np.ndarray], tables: list[list[np.ndarray]] | None = None) -> np.ndarray:
        tables = tables or self.tables()
        x = np.array([self.features(t, tables) for t in texts], np.float64).reshape(-1, len(WIDTHS) * FILTERS)
        return x @ self.out + self.out_bias

    def scores(self, texts: list[np.ndarray], tables: list[list[np.ndarray]] | None = None) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(texts, tables) + self.shift, -30, 30)))

    def threshold(self, lang: str | None) -> float:
        return self.thresholds.get(lang or "", self.default)


def families(texts: list[np.ndarray], samples: int = 5, seed: int = 13) -> np.ndarray:
    """One over the number of texts that are nearly the same as each: those with equal minima of their hashed words."""
    rng = np.random.default_rng(seed)
    order = np.stack([rng.permutation(BUCKETS) for _ in range(samples)])
    keys = [tuple(order[:, np.unique(ids)].min(axis=1)) if len(ids) else () for ids in texts]
    count = Counter(keys)
    return np.array([1 / count[k] for k in keys])


def evidence(texts: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Per bucket how surely it stands in toxic (or clean, negative) texts more often: its likelihood ratio, to at most 2.

    Copies of a text count as one, or a word of a much copied text would be taken for evidence of its label. The ratio grows
    with the number of texts, so words of a few texts have next to none, whatever their labels.
    """
    weight = families(texts)
    counts = np.zeros((2, BUCKETS))
    for ids, label, w in zip(texts, y, weight, strict=True):
        counts[int(label), np.unique(ids)] += w
    n = np.array([max(1e-9, weight[y == 0].sum()), max(1e-9, weight[y == 1].sum())])
    both = counts.sum(axis=0)
    expected = both[None, :] * (n / n.sum())[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * np.where(counts > 0, counts * np.log(counts / expected), 0).sum(axis=0)
    signed = np.where(counts[1] >= expected[1], ratio, -ratio)
    signed[0] = 0
    return np.clip(signed / 64, -2, 2)


def fit(texts: list[np.ndarray], y: np.ndarray, *, epochs: int = 4, batch: int = 64, rate: float = 0.02, decay: float = 1e-3, drop: float = 0.1, seed: int = 3) -> Model:
    """Stochastic gradient descent (Adagrad) on log loss, classes weighed alike.

    The first embedding axis begins as the words' evidence and the first filter of each width reads that axis, so that
    training begins with a sensible detector and refines it. Max pooling sends a filter's gradient to one place a text.
    """
    rng = np.random.default_rng(seed)
    kernels = [rng.normal(0, 0.1, (w, DIM, FILTERS)) for w in WIDTHS]
    model = Model(rng.normal(0, 0.02, (BUCKETS, DIM)), kernels, [np.zeros(FILTERS) for _ in WIDTHS], np.zeros(len(WIDTHS) * FILTERS), 0.0)
    if not len(texts) or not 0 < y.sum() < len(y):
        return model
    model.embed[:, 0] = evidence(texts, y)
    for k, w in enumerate(WIDTHS):
        model.kernels[k][:, :, 0] = 0
        model.kernels[k][:, 0, 0] = 1.0
        model.out[k * FILTERS] = 1.0
    model.out_bias = -1.5
    params = {"embed": model.embed, "out": model.out, **{f"k{k}": x for k, x in enumerate(model.kernels)}, **{f"b{k}": x for k, x in enumerate(model.biases)}}
    sums = {k: np.full_like(v, 0.05) for k, v in params.items()}
    bias_sum = 0.05
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(epochs):
        tables = model.tables()
        for lot in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // batch)):
            grads = {k: np.zeros_like(v) for k, v in params.items() if k != "embed"}
            touched: dict[int, np.ndarray] = {}
            bias_grad = 0.0
            for i in lot:
                ids = texts[i][rng.random(len(texts[i])) >= drop]
                pooled, where, padded = [], [], []
                for w, t, b in zip(WIDTHS, tables, model.biases, strict=True):
                    x = ids if len(ids) >= w else np.concatenate([ids, np.zeros(w - len(ids), np.int32)])
                    n = len(x) - w + 1
                    total = t[0][x[:n]]
                    for j in range(1, w):
                        total = total + t[j][x[j : j + n]]
                    top = total.argmax(axis=0)
                    pooled.append(total[top, np.arange(FILTERS)] + b)
                    where.append(top)
                    padded.append(x)
                flat = np.concatenate(pooled)
                active = np.maximum(flat, 0)
                p = 1 / (1 + np.exp(-np.clip(active @ model.out + model.out_bias, -30, 30)))
                g = (p - y[i]) * weight[i] / len(lot)
                grads["out"] += g * active
                bias_grad += g
                back = g * model.out * (flat > 0)
                for k, w in enumerate(WIDTHS):
                    gk = back[k * FILTERS : (k + 1) * FILTERS]
                    grads[f"b{k}"] += gk
                    for j in range(w):
                        at = padded[k][where[k] + j]
                        grads[f"k{k}"][j] += model.embed[at].T * gk
                        for a, d in zip(at, (model.kernels[k][j] * gk).T, strict=True):
                            touched[a] = touched.get(a, 0) + d
            for k, gr in grads.items():
                gr = gr + decay * params[k]
                sums[k] += gr**2
                params[k] -= rate * gr / np.sqrt(sums[k])
            bias_sum += bias_grad**2
            model.out_bias -= rate * bias_grad / np.sqrt(bias_sum)
            if touched:
                at = np.fromiter(touched, np.int64, len(touched))
                gr = np.stack(list(touched.values()))
                sums["embed"][at] += gr**2
                model.embed[at] -= rate * gr / np.sqrt(sums["embed"][at])
            for k, w in enumerate(WIDTHS):
                for j in range(w):
                    tables[k][j][at if touched else []] = model.embed[at if touched else []] @ model.kernels[k][j]
        # the kernels have moved a little; the tables are made anew for each epoch
    return model


def calibrate(model: Model, texts: list[np.ndarray], y: np.ndarray, langs: list[str], *, precision: float = 0.9, trust: int = 20) -> Model:
    """Platt scaling of the logit on texts that gave no evidence or gradient, then a threshold per language.

    A threshold is the smallest score from which on texts reach ``precision`` (1 if none does). A language's own lies between
    the one of its texts and the one of all texts, nearer to its own the more toxic texts it has: half way at ``trust``.
    """
    if not len(texts) or not 0 < y.sum() < len(y):
        return model
    z = model.logits(texts)
    a, b = 1.0, 0.0
    goal = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((y == 0).sum() + 2))
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))

    def loss(a: float, b: float) -> float:
        t = a * z + b
        return float(np.sum(weight * (np.logaddexp(0, t) - goal * t)))

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        d, h = weight * (p - goal), weight * np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[np.sum(h * z * z) + 1e-3, np.sum(h * z)], [np.sum(h * z), np.sum(h) + 1e-3]])
        step = np.linalg.solve(hess, np.array([np.sum(d * z), np.sum(d)]))
        while np.abs(step).max() >= 1e-8 and loss(a - step[0], b - step[1]) > loss(a, b):
            step /= 2
        if np.abs(step).max() < 1e-8:
            break
        a, b = a - step[0], b - step[1]
    model.scale, model.shift = (float(a), float(b)) if np.isfinite(a + b) and a > 0 else (1.0, 0.0)
    p = model.scores(texts)

    def cut(p: np.ndarray, y: np.ndarray) -> float:
        order = np.argsort(-p, kind="stable")
        hits = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
        good = np.flatnonzero(hits >= precision)
        return float(p[order[good[-1]]]) if len(good) else 1.0

    model.default = cut(p, y)
    for lang in sorted(set(langs)):
        own = np.array([x == lang for x in langs])
        share = y[own].sum() / (y[own].sum() + trust)
        model.thresholds[lang] = float(share * cut(p[own], y[own]) + (1 - share) * model.default)
    return model


def train(docs: DataFrame, labels: DataFrame, *, limit: int = 12_000, words: int = 4_000_000, seed: int = 5, **options) -> Model:
    """Fits on labelled rows that are not held out, in seeded order: at most ``limit`` / 3 toxic and 2 / 3 ``limit`` clean ones, and
    no further than ``words`` words together.

    Their word buckets, 4 bytes a word, not their texts, reach the driver. Every fifth row calibrates, the others fit. Of a
    repeated doc_id one row counts, with the label that is toxic if any is.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = bounded_ids(known.where("toxic = 1"), "doc_id", limit // 3, seed).unionByName(bounded_ids(known.where("toxic = 0"), "doc_id", limit - limit // 3, seed))
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.coalesce("lang", F.lit("")).alias("lang")).join(F.broadcast(chosen), "doc_id")  # at most ``limit`` ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[bytes, int] = {}
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang": pdf["lang"], "toxic": pdf["toxic"], "ids": pd.Series([word_ids(t, cache) for t in pdf["text"]], dtype=object)})

    found = written(rows.mapInPandas(run, "doc_id long, lang string, toxic int, ids array<int>"), "labelled")
    found = found.groupBy("doc_id").agg(F.min(F.struct("ids", "lang", "toxic")).alias("r")).select("doc_id", "r.*")
    # at most ``limit`` rows: how far they go within ``words``
    order = F.xxhash64(F.lit(seed + 1), "doc_id")
    upto = found.select("doc_id", F.sum(F.size("ids")).over(Window.orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, -1)).alias("before")).where(F.coalesce("before", F.lit(0)) < words).select("doc_id")
    found = found.join(written(upto, "upto"), "doc_id").where(F.size("ids") <= words)
    found = found.toPandas()
    found = found.assign(o=[xxhash.xxh3_64_intdigest(str(i)) for i in found["doc_id"]]).sort_values(["o", "doc_id"], kind="stable")
    texts, y, langs = [np.asarray(x, np.int32) for x in found["ids"]], found["toxic"].to_numpy(float), found["lang"].tolist()
    probe = np.arange(len(texts)) % 5 == 4
    model = fit([t for t, p in zip(texts, probe, strict=True) if not p], y[~probe], seed=seed, **options)
    return calibrate(model, [t for t, p in zip(texts, probe, strict=True) if p], y[probe], [x for x, p in zip(langs, probe, strict=True) if p])


def score(docs: DataFrame, model: Model, *, cut: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= ``cut``), threshold and flagged (by the language's threshold).

    Each score comes from the whole text alone. Null and empty texts score as a text of padding does; equal texts, in repeated
    rows too, get equal scores, and a score at the cut is predicted. A null doc_id gets a row and is not held out. An empty
    table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[bytes, int] = {}
        model = sent.value
        tables = [[t.astype(np.float32) for t in ts] for ts in model.tables()]
        for pdf in batches:
            p = model.scores([word_ids(t, cache) for t in pdf["text"]], tables)
            t = np.array([model.threshold(x) for x in pdf["lang"]], float)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": p, "predicted": (p >= cut).astype(np.int32), "threshold": t, "flagged": p >= t})

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary").alias("text"), "lang")
    return map_with_ids(rows, run, "doc_id long, held_out boolean, score double, predicted int, threshold double, flagged boolean", "doc_id")
