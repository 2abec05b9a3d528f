import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from kinfolio.llm import fim

SCHEMA = "doc_id long, text string, output string, form string, n string"


def brute(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    hexed = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    a, b = min(a, b), max(a, b)
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


texts = st.text(alphabet=st.sampled_from("a\n\r é😀<PSM>"), max_size=60).map(lambda t: t * 40) | st.text(max_size=300)


@settings(max_examples=300, deadline=None)
@given(texts, st.integers(-5, 1 << 62))
def test_rearranged_equals_slices(text, doc_id):
    found = fim.rearranged(text, fim.draws(7, doc_id), 100, 50)
    assert found == brute(doc_id, text)
    assert fim.restore(found[4], found[1]) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab\n", max_size=3000), max_size=12), st.data())
def test_trees_split_and_join(parts, data):
    whole = fim.EMPTY
    for p in parts:
        whole = fim.join(whole, fim.rope(p))
    text = "".join(parts)
    at = data.draw(st.integers(0, len(text)))
    a, b = fim.split_chars(whole, at)
    assert (fim.flat(a), fim.flat(b), a.chars, b.chars) == (text[:at], text[at:], at, len(text) - at)
    assert fim.flat(fim.join(a, b)) == text


def heights(r):
    if r.left is None:
        return
    assert abs(r.left.height - r.right.height) <= 1 and r.height == 1 + max(r.left.height, r.right.height)
    assert (r.units, r.chars) == (r.left.units + r.right.units, r.left.chars + r.right.chars)
    heights(r.left)
    heights(r.right)


def test_trees_stay_balanced():
    whole = fim.rope("x\n" * 100_000)
    heights(whole)
    for rank in (1, 77, 50_000, 99_999):
        a, b = fim.split_units(whole, rank)
        heights(a)
        heights(b)
        heights(fim.join(b, a))
        assert fim.flat(a) == "x\n" * rank and a.units == rank


def test_table(spark):
    rows = [(k, f"line {k}\nmiddle é😀 {k}\n" * k + "end", "x", "y", "z") for k in range(40)]
    rows += [(None, "a\nb\nc", "x", "y", "z"), (50, None, "x", "y", "z"), (51, "", "x", "y", "z"), (52, "has <P> in it\n", None, None, None), (53, "w\n" * 500_000, "x", "y", "z"), (1, rows[1][1], "again", "y", "z")]
    out = fim.restored(fim.transform(spark.createDataFrame(rows, SCHEMA))).collect()
    want = sorted(((r[0], *brute(r[0], r[1]), r[1] or "") for r in rows), key=str)
    assert sorted(map(tuple, out), key=str) == want
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    some = fim.transform(spark.createDataFrame(rows, SCHEMA), rate=30, spm=0).collect()
    assert sorted(map(tuple, some), key=str) == sorted(((r[0], *brute(r[0], r[1], 30, 0)) for r in rows), key=str)


def test_digests(spark):
    (r,) = fim.digests(fim.transform(spark.createDataFrame([(3, "é\nb\n", None, None, None)], SCHEMA))).collect()
    assert r.output_sha256 == hashlib.sha256(brute(3, "é\nb\n")[4].encode()).hexdigest()
    assert r.restored_sha256 == hashlib.sha256("é\nb\n".encode()).hexdigest()


def test_empty_table(spark):
    assert fim.digests(fim.transform(spark.createDataFrame([], SCHEMA))).collect() == []
