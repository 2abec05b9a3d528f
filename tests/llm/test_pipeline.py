"""Each stage of the pipeline against a plain version, on documents with the corners that tables have."""

import random
import re

import pytest

import corpus_pipeline
from kinfolio.llm import packing, pii

from .test_mixing import brute_targets
from .test_neardup import brute as brute_components
from .test_quality import brute_statistics

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string"


def corpus():
    rng = random.Random(7)
    vocab = [f"word{k}" for k in range(500)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    rows = []
    for k in range(150):
        t = text(rng.randint(20, 150))
        if k % 10 == 0:
            t += " mail a.b@c.example or +1 (222) 555-1234"
        rows.append((k, t))
        if k % 6 == 0:
            w = t.split()
            w[len(w) // 2] = "changed"
            rows.append((1000 + k, " ".join(w)))
            rows.append((2000 + k, t.upper()))
    rows += [(3000 + k, " ".join(w + "###" for w in text(60).split())) for k in range(40)]
    rows += [(4000, None), (4001, ""), (4002, "short one"), (None, text(50)), (5, dict(rows)[5]), (4003, "five words again and again " * 30), (4004, text(30_000))]
    out = [(i, t, "en", rng.choice(["s0", "s0", "s0", "s1", "s2", None]), None if t is None else len(t), "x") for i, t in rows]
    rng.shuffle(out)
    labels = [(i, 0 if i is not None and 3000 <= i < 4000 else 1, 0) for i, *_ in out if i is not None and i % 2 == 0]
    return out, labels


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rows, labels = corpus()
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, found = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if name != "best_fit_packing":
            assert out.columns == columns, name
        out.write.parquet(f"{folder}/{k}")
        found[name] = (docs.collect(), spark.read.parquet(f"{folder}/{k}").collect())
        docs = spark.read.parquet(f"{folder}/{k}")
    found["run"] = (folder, corpus_pipeline.run(spark, folder).collect())
    return found


def key(r):
    return (r.doc_id if r.doc_id is not None else -1, r.text or "", r.source or "")


def test_quality(results):
    before, after = results["quality_rules"]

    def fails(t):
        n, _, _, _, repeat = brute_statistics(t)
        return n < 10 or 100 * repeat > 20 * n

    kept = {key(r) for r in after}
    assert not any(fails(r.text) for r in after)
    for r in before:
        junk = r.doc_id is not None and 3000 <= r.doc_id < 4000
        assert (key(r) in kept) == (not fails(r.text) and not junk), r.doc_id


def test_near_duplicates(results):
    before, after = results["near_duplicates"]
    want = {eval(s)[0] for s in brute_components([(r.doc_id, r.text) for r in before], 5, 80) if eval(s)[3]}
    assert sorted(r.doc_id for r in after if r.doc_id is not None) == sorted(i for i in want if i is not None)
    assert sum(r.doc_id is None for r in after) == sum(r.doc_id is None for r in before)
    assert {key(r) for r in after} <= {key(r) for r in before}


def test_personal_data(results):
    before, after = results["personal_data"]
    assert len(before) == len(after)
    anchors = pii.automaton()
    new = {r.doc_id: r for r in after}
    for r in before:
        t, done, out = r.text, 0, []
        for kind, a, b in sorted(pii.spans(t, anchors), key=lambda s: s[1]):
            out += [t[done:a], f"[{kind.upper()}]"]
            done = b
        assert new[r.doc_id].text == "".join(out) + t[done:]
        assert new[r.doc_id].n_chars == len(new[r.doc_id].text)
    assert not any(re.search(r"@c\.example|555-1234", r.text) for r in after)


def test_mixing(results):
    before, after = results["mix_sources"]
    sizes, got, once = {}, {}, {}
    for r in before:
        n = len(r.text.split())
        sizes[r.source] = sizes.get(r.source, 0) + n
        once[r.doc_id] = n
    order = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    target = brute_targets(sizes, {s: 1 + k % 3 for k, s in enumerate(order)})
    docs = {}
    for r in after:
        n = len(r.text.split())
        got[r.source] = got.get(r.source, 0) + n
        docs[r.doc_id] = docs.get(r.doc_id, 0) + n
    null = sum(len(r.text.split()) for r in before if r.doc_id is None)
    for s in sizes:
        assert abs(got.get(s, 0) - target[s]) <= 1 + 3 * null
    assert all(docs[i] <= 3 * once[i] for i in docs)


def test_packing(results):
    before, after = results["best_fit_packing"]
    want, got, bins = {}, {}, {}
    for r in before:
        want[r.doc_id] = want.get(r.doc_id, 0) + len(r.text.split())
    for r in after:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        bins.setdefault(r.bin_id, []).append(r)
    assert got == want
    for b in bins.values():
        used = sum(r.length for r in b)
        assert b[0].capacity == next(c for c in packing.CAPACITIES if c >= used)


def test_run_equals_the_stages(results):
    assert sorted(map(str, results["run"][1])) == sorted(map(str, results["best_fit_packing"][1]))


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None, None)] * 3, [(7, None, "en", "s", None, "x"), (7, "", "en", "s", 0, "x")]])
def test_stages_of_empty_tables_and_of_nulls(spark, tmp_path, rows):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, DOCS)
    want = {"quality_rules": 0, "near_duplicates": 1 if rows and rows[0][0] else len(rows), "personal_data": len(rows), "mix_sources": len(rows), "best_fit_packing": 0}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == want[name], name


def test_columns_of_any_name_come_along(spark, tmp_path):
    spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = ["kept", "size", "taken", "part", "key", "rep", "Count", "u", "slice"]
    docs = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(20)), "en", "s", 9, *range(len(names))) for k in range(40)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name


def test_rows_of_one_id_leave_the_same_one(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(1, b, "en", "s", 1, "x"), (1, a, "en", "s", 1, "y"), (1, a, "en", "s", 1, "x"), (2, b, "en", "s", 1, "x")]
    for order in (rows, rows[::-1]):
        out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(order, DOCS).repartition(3), "").collect()
        assert [(r.doc_id, r.text, r.kept) for r in out] == [(1, a, "x")]
