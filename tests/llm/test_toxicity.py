import os
import random
import zlib

import numpy as np
import pytest

from kinfolio.llm import toxicity

DOCS = "doc_id long, text string, lang string, score int"


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    vocab, rude = [f"w{k}" for k in range(3000)], {"en": ["idiot", "scum", "moron"], "fr": ["nul", "bete", "sot"]}
    docs, labels = [], []
    for k in range(n):
        lang, toxic = ("en", "fr")[k % 2], int(k % 5 == 0)
        words = [rng.choice(vocab) for _ in range(rng.randint(5, 200))]
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words) + 1), rng.choice(rude[lang]) + rng.choice(["", ",", "."]))
        docs.append((k, " ".join(words), lang, 0))
        labels.append((k, 1, toxic))
    return docs, labels


def test_held_out_accuracy_and_rows(spark):
    docs, labels = corpus()
    extra = [(5000, None, None, 0), (5001, "", "en", 0), (None, "w1 idiot", "en", 0), (0, docs[0][1], "en", 0), (5002, "w1 " * 60_000 + "scum", "en", 0)]
    df = spark.createDataFrame(docs + extra, DOCS)
    ls = spark.createDataFrame(labels + [(None, 1, 1), (9999, 1, None)], "doc_id long, quality int, toxic int")
    out = toxicity.score(df, toxicity.train(df, ls)).collect()
    assert len(out) == len(docs) + len(extra)
    truth = {i: t for i, _, t in labels}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held)
    assert not any(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in out if not r.held_out and r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    by = {r.doc_id: r for r in out}
    assert by[5000].score == by[5001].score and by[5000].predicted == 0
    assert by[5002].predicted == 1 and by[None].predicted == 1 and not by[None].held_out


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = corpus(200)
    df = spark.createDataFrame(docs, DOCS)
    other = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    a, b = (toxicity.train(df, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, other))
    assert np.array_equal(a.embed, b.embed) and a.scale == b.scale and a.thresholds == b.thresholds


def test_no_labels(spark):
    df = spark.createDataFrame(corpus(20)[0], DOCS)
    model = toxicity.train(df, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.score(df, model).count() == 20
    assert toxicity.score(df.limit(0), model).count() == 0


def test_pooling_over_the_whole_text_equals_brute_force():
    rng = np.random.default_rng(2)
    m = toxicity.fit([rng.integers(1, 999, 20).astype(np.int32) for _ in range(60)], (np.arange(60) % 2).astype(float), epochs=1)
    ids = rng.integers(1, 999, 50).astype(np.int32)
    want = []
    for w, k, b in zip(toxicity.WIDTHS, m.kernels, m.biases, strict=True):
        want.append(np.maximum(np.max([sum(m.embed[ids[i + j]] @ k[j] for j in range(w)) for i in range(len(ids) - w + 1)], axis=0) + b, 0))
    assert np.allclose(m.features(ids, m.tables()), np.concatenate(want))


def test_thresholds_differ_by_language_and_lean_on_the_common_one():
    rng = np.random.default_rng(3)
    model = toxicity.fit([], np.zeros(0))
    model.logits = lambda texts, tables=None: np.array([t[0] for t in texts], float)
    z, y, langs = [], [], []
    for lang, shift, n in (("en", 0.0, 400), ("fr", 3.0, 400), ("de", 3.0, 6)):
        toxic = np.arange(n) % 2
        z += list(rng.normal(0, 1, n) + 2 * toxic + shift)
        y += list(toxic)
        langs += [lang] * n
    toxicity.calibrate(model, [[v] for v in z], np.array(y, float), langs)
    t = model.thresholds
    assert t["en"] < t["fr"] and abs(t["de"] - model.default) < abs(t["fr"] - model.default)
    assert model.threshold("unknown") == model.default


def test_copies_count_once():
    rng = np.random.default_rng(4)
    own = [rng.integers(1, 5000, 60).astype(np.int32) for _ in range(40)]
    weight = toxicity.families([own[0]] * 50 + own[1:])
    assert np.allclose(weight[:50], 1 / 50) and np.allclose(weight[50:], 1)
    texts = [np.append(t, 7).astype(np.int32) for t in own[:20]] + own[20:] + [np.append(own[0], 9).astype(np.int32)] * 20
    y = np.array([1.0] * 20 + [0.0] * 20 + [1.0] * 20)
    e = toxicity.evidence(texts, y)
    assert e[7] > 5 * e[9] >= 0


def test_training_words_are_bounded(spark):
    docs, labels = corpus(300)
    df, ls = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    seen = []
    fit = toxicity.fit
    try:
        toxicity.fit = lambda texts, y, **k: seen.append(sum(map(len, texts))) or fit(texts[:0], y[:0])
        toxicity.train(df, ls, words=3000)
    finally:
        toxicity.fit = fit
    assert 0 < seen[0] <= 3000 + 200


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_held_out_rows_by_language(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).where("held_out").join(labels.where("toxic IS NOT NULL").select("doc_id", "toxic"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    at = rows.assign(hit=rows["predicted"] == 1, own=rows["flagged"]).groupby(["lang", "toxic"], dropna=False)[["hit", "own"]].agg(["sum", "count"])
    print(model.thresholds, model.default, at, sep="\n")
    toxic, clean = rows[rows["toxic"] == 1], rows[rows["toxic"] == 0]
    assert (toxic["predicted"] == 1).mean() >= 0.7 and (clean["predicted"] == 0).mean() >= 0.97
    for lang, of in clean.groupby("lang"):
        assert (~of["flagged"]).mean() >= 0.9, lang
    assert toxic[toxic["lang"] == "en"]["flagged"].mean() >= 0.85
