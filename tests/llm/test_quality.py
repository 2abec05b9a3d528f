import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from kinfolio.llm import quality

DOCS = "doc_id long, text string, quality string"


def brute_statistics(text, window=5):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]
    counts, cover = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            cover.update(range(i, i + window))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover)


def test_statistics_equal_brute_force():
    rng = random.Random(2)
    for _ in range(8000):
        t = "".join(rng.choice(["a", "b", " ", "\n", "\t", "#", " ", "é", "\x1c", "a b c d e "]) for _ in range(rng.randint(0, 60)))
        assert tuple(quality.statistics(t.encode())[0]) == brute_statistics(t), repr(t)
    assert quality.statistics(None)[0] == [0, 0, 0, 0, 0]


def test_flat_trees_equal_walking_and_are_monotone():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 4))
    y = ((x[:, 0] < 0.3) & (x[:, 1] > -1) | (rng.random(1500) < 0.05)).astype(float)
    m = quality.fit(x, y, np.array([-1, 0, 0, 0]), trees=25)

    def walk(row):
        total = m.base
        for k in m.roots:
            while m.left[k] != k:
                k = m.left[k] if row[m.feature[k]] <= m.threshold[k] else m.right[k]
            total += m.value[k]
        return 1 / (1 + np.exp(-total))

    p = m.score(x[:200])
    assert np.allclose(p, [walk(r) for r in x[:200]])
    assert ((p > 0.5) == (y[:200] == 1)).mean() > 0.9
    for row in x[:50]:
        line = np.repeat(row[None], 40, 0)
        line[:, 0] = np.linspace(-3, 3, 40)
        assert (np.diff(m.score(line)) <= 1e-12).all()
    assert quality.fit(x[:0], y[:0], np.zeros(4)).score(x[:3]).shape == (3,)


def test_verdicts(spark):
    rng = random.Random(3)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the"]) + str(rng.randint(0, 99)) for _ in range(60)) for _ in range(150)]
    bad = [" ".join(w + "%%%" for w in t.split()) for t in good]
    rows = [(k, t, "x") for k, t in enumerate(good + bad)]
    rows += [(900, None, "x"), (901, "", "x"), (902, "a b c", "x"), (903, "one two three four five " * 9, "x"), (None, good[0], "x"), (0, good[0], "x")]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, int(k < 150)) for k in range(0, 300, 2)] + [(None, 1), (7777, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    out = quality.assess(docs, model).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert all(by[k].kept for k in range(1, 150, 2)) and not any(by[k].kept for k in range(151, 300, 2))
    assert by[900].base_failed and by[901].n_words == 0 and by[902].base_failed
    assert by[903].base_failed and not by[903].kept and by[903].n_repeat_words == 45
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns
    assert sorted(r.text or "" for r in kept.collect()) == sorted(t or "" for r, (_, t, _) in zip(quality.assess(docs.coalesce(1), model).collect(), rows, strict=True) if r.kept)
    assert quality.accepted(docs.withColumn("kept", F.lit(3)), model).columns == [*docs.columns, "kept"]
    none = quality.train(docs.limit(0), labels)
    assert quality.assess(docs.limit(0), none).count() == 0


def test_cut_spares_good_texts():
    rng = np.random.default_rng(2)
    p, y = np.concatenate([rng.uniform(0.2, 1, 1000), rng.uniform(0, 0.5, 300)]), np.concatenate([np.ones(1000), np.zeros(300)])
    cut = quality.sparing_cut(p, y)
    assert (p[:1000] < cut).mean() <= 0.01 and (p[1000:] < cut).mean() > 0.3
    assert quality.sparing_cut(np.full(5, 0.9), np.ones(5)) == 0.3 / 4 == quality.sparing_cut(np.zeros(0), np.zeros(0))


def test_repeated_ids_fit_the_same_model(spark):
    rng = random.Random(9)
    rows = [(k // 3, " ".join(rng.choice(["alpha", "beta", "%%%", "x#"]) + str(rng.randint(0, 9)) for _ in range(30)), "x") for k in range(600)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, quality int")
    models = [quality.train(spark.createDataFrame(r, DOCS).repartition(n), labels) for r, n in ((rows, 1), (rows[::-1], 7))]
    assert models[0].cut == models[1].cut
    assert all(np.array_equal(getattr(models[0], f), getattr(models[1], f)) for f in ("roots", "feature", "threshold", "left", "right", "value"))
