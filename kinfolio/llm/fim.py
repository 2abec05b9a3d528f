"""Fill in the middle: a rope of each text is split at two ranks of lines and joined anew with sentinels.

Leaves and inner nodes of the rope hold their count of units (lines) and of code points, so a split at a rank and the length
of a part cost a walk down the tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_with_ids

#: Code points of a leaf.
LEAF = 1024
#: Sentinels before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = SENTINELS = "<P>", "<S>", "<M>"


@dataclass(frozen=True, slots=True)
class Rope:
    """A leaf holds ``text``, an inner node two ropes. A unit counts in the leaf in which it ends."""

    units: int
    chars: int
    height: int = 0
    text: str = ""
    left: Rope | None = None
    right: Rope | None = None


EMPTY = Rope(0, 0)


def node(left: Rope, right: Rope) -> Rope:
    return Rope(left.units + right.units, left.chars + right.chars, 1 + max(left.height, right.height), "", left, right)


def rope(text: str) -> Rope:
    """The lines ``[^\\n]*\\n|[^\\n]+`` of a text are its units; a last line without a line end is one."""
    leaves = [(part := text[a : a + LEAF], part.count("\n")) for a in range(0, len(text), LEAF)]
    level = [Rope(n, len(part), 0, part) for part, n in leaves]
    if level and not text.endswith("\n"):
        last = level[-1]
        level[-1] = Rope(last.units + 1, last.chars, 0, last.text)
    return halves(level, 0, len(level)) if level else EMPTY


def halves(leaves: list[Rope], a: int, b: int) -> Rope:
    """One tree of ``leaves[a:b]``, as even as can be."""
    if b - a == 1:
        return leaves[a]
    mid = (a + b) // 2
    return node(halves(leaves, a, mid), halves(leaves, mid, b))


def join(a: Rope, b: Rope) -> Rope:
    """``a`` and then ``b``; neighbours differ in height by one at most wherever they did before."""
    if not a.chars or not b.chars:
        return b if not a.chars else a
    if a.height > b.height + 1:
        return balanced(a.left, join(a.right, b))
    if b.height > a.height + 1:
        return balanced(join(a, b.left), b.right)
    return node(a, b)


def balanced(a: Rope, b: Rope) -> Rope:
    if a.height > b.height + 1:
        x, y = a.left, a.right
        return node(x, node(y, b)) if x.height >= y.height else node(node(x, y.left), node(y.right, b))
    if b.height > a.height + 1:
        x, y = b.left, b.right
        return node(node(a, x), y) if y.height >= x.height else node(node(a, x.left), node(x.right, y))
    return node(a, b)


def split(r: Rope, rank: int, count: Callable[[Rope], int], cut: Callable[[Rope, int], int]) -> tuple[Rope, Rope]:
    """``r`` before and behind ``rank``, at most ``count(r)``; ``cut`` finds the place in a leaf.

    The place is the first with that count, so what of a next unit stands in the same leaves goes to the second part.
    """
    if rank <= 0:
        return EMPTY, r
    if r.left is None:
        at = cut(r, rank)
        head = r.text[:at]
        units = head.count("\n")
        return Rope(units, at, 0, head), Rope(r.units - units, r.chars - at, 0, r.text[at:])
    if rank <= count(r.left):
        a, b = split(r.left, rank, count, cut)
        return a, join(b, r.right)
    a, b = split(r.right, rank - count(r.left), count, cut)
    return join(r.left, a), b


def after_lines(leaf: Rope, rank: int) -> int:
    at = 0
    for _ in range(rank):
        at = leaf.text.index("\n", at) + 1
    return at


def split_units(r: Rope, rank: int) -> tuple[Rope, Rope]:
    if rank >= r.units:  # a last unit without a line end has no place of its own
        return r, EMPTY
    return split(r, rank, lambda x: x.units, after_lines)


def split_chars(r: Rope, rank: int) -> tuple[Rope, Rope]:
    return split(r, rank, lambda x: x.chars, lambda _, at: at)


def flat(r: Rope) -> str:
    out, stack = [], [r]
    while stack:
        x = stack.pop()
        if x.left is None:
            out.append(x.text)
        else:
            stack += [x.right, x.left]
    return "".join(out)


def mark(sentinel: str) -> Rope:
    return Rope(0, len(sentinel), 0, sentinel)


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers of 32 bits by seed and doc_id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def rearranged(text: str, h: list[int], rate: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of prefix and of middle, output) of a text."""
    whole = rope(text)
    n = whole.units
    if not text or any(s in text for s in SENTINELS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    head, suffix = split_units(whole, high)
    prefix, middle = split_units(head, low)
    if h[3] % 100 < spm:
        form, parts = "spm", (mark(SUFFIX), suffix, mark(PREFIX), prefix, mark(MIDDLE), middle)
    else:
        form, parts = "psm", (mark(PREFIX), prefix, mark(SUFFIX), suffix, mark(MIDDLE), middle)
    out = EMPTY
    for part in parts:
        out = join(out, part)
    return n, form, prefix.chars, middle.chars, flat(out)


def restore(output: str, form: str) -> str:
    """The text from which ``output`` was made: its rope is split at the sentinels and joined in the text's order.

    No sentinel stands inside a part, and none can arise where a part meets a sentinel, as ``<`` only begins one.
    """
    if form == "plain":
        return output
    order = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)
    rest, parts = rope(output), {}
    starts = [output.index(s) for s in order]
    for s, at in reversed(list(zip(order, starts, strict=True))):
        rest, part = split_chars(rest, at)
        parts[s] = split_chars(part, len(s))[1]
    return flat(join(join(parts[PREFIX], parts[MIDDLE]), parts[SUFFIX]))


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output for every row of ``docs(doc_id, text)``.

    ``rate`` percent of the texts are rearranged, of those ``spm`` percent with the suffix first. Where a text is cut hangs on
    seed and doc_id alone, so reruns agree and repeated rows get equal answers; a null doc_id draws as an empty one. Null
    and empty texts, and texts that hold a sentinel, stay plain. Very long texts are one rope each. An empty table gives an
    empty result. Other columns of any name are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                found.append(rearranged(text, draws(seed, doc_id), rate, spm))
            out = pd.DataFrame(found, columns=["n", "form", "prefix_chars", "middle_chars", "output"], dtype=object)
            out.insert(0, "doc_id", pdf["doc_id"].values)
            yield out

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return map_with_ids(rows, run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string", "doc_id")


def restored(rows: DataFrame) -> DataFrame:
    """The columns of ``rows`` (of :func:`transform`, or others with ``form`` and ``output``) and ``restored``, the text again.

    A null output stays null.
    """

    def run(form: pd.Series, output: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else restore(x, f) for f, x in zip(form, output, strict=True)], dtype=object)

    return rows.withColumn("restored", F.pandas_udf(run, "string")("form", "output"))


def digests(rows: DataFrame) -> DataFrame:
    """The columns of :func:`transform` with SHA-256 of the output, and of the text restored from it, in place of both."""
    out = restored(rows)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
