"""Near duplicates: MinHash bands propose pairs, odd sketches verify them, whole shingle sets confirm them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import map_with_ids, written

#: Rows of a band; a pair at the threshold goes unseen by all bands with at most this probability.
ROWS, MISS = 5, 1e-8
#: Bands in which large groups are joined before all bands are looked at.
FIRST_BANDS = 8
#: 64-bit words of an odd sketch.
SKETCH_WORDS = 8
#: Words whose hashes a Python worker remembers.
CACHE = 1 << 20
#: Ids or buckets that are sent to every task, at most 40 bytes each.
BROADCAST_IDS = 500_000
#: Elements of a block of hash values.
BLOCK = 1 << 22
#: Classes of a lot, and the bytes of its bitmaps.
LOT, LOT_BYTES = 1024, 1 << 25
#: Columns of the matrices that are multiplied at a time; their sums are exact in 32-bit floats.
COLUMNS = 8192
#: Meetings in rare shingles for each class of a group, up to which they are joined pair by pair.
MEETINGS = 16

MIX1, MIX2, MIX3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def bands_for(similarity: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - similarity**ROWS))


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise."""
    h = (h ^ (h >> np.uint64(33))) * MIX2
    h = (h ^ (h >> np.uint64(29))) * MIX3
    return h ^ (h >> np.uint64(32))


def shingles(raw: bytes | None, width: int, cache: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of a lower-cased text.

    Fewer words are one shingle; none are none. ``bytes.lower`` changes A-Z alone.
    """
    words = raw.lower().split() if raw else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    if len(cache) > CACHE:
        cache.clear()
    ids = np.empty(n, np.uint64)
    for k, w in enumerate(words):
        h = cache.get(w)
        if h is None:
            h = cache[w] = xxhash.xxh3_64_intdigest(w)
        ids[k] = h
    size = min(n, width)
    h = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        h = mixed(h * MIX1 + ids[k : n - size + 1 + k])
    return np.unique(h)


def parameters(k: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, k, np.uint64).astype(np.uint32), (rng.integers(0, 1 << 31, k, np.uint64).astype(np.uint32) << np.uint32(1)) | np.uint32(1)


def minhash(h: np.ndarray, xors: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The smallest of each of k 32-bit permutations, in blocks of bounded size."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    step = max(1, BLOCK // len(xors))
    out = np.full(len(xors), 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), step):
        block = x[None, a : a + step] ^ xors[:, None]
        block *= factors[:, None]
        np.minimum(out, block.min(axis=1), out=out)
    return out


def odd_sketch(m: np.ndarray, words: int = SKETCH_WORDS) -> np.ndarray:
    """Each (place, sample) flips one bit of the bitmap, so a bit holds the parity of its samples."""
    bits = 64 * words
    at = (mixed(m.astype(np.uint64) * MIX1 + np.arange(len(m), dtype=np.uint64)) % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(at, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def most_bits(similarity: float, samples: int, words: int = SKETCH_WORDS) -> int:
    """The largest XOR population count that a pair of at least ``similarity`` shows, six deviations included.

    Of k samples some differ; each differing sample flips two bits of n. Both steps get six standard deviations.
    """
    n, p = 64 * words, 1 - similarity
    flips = 2 * min(samples, samples * p + 6 * math.sqrt(samples * p * similarity))
    odd = (1 - math.exp(-2 * flips / n)) / 2
    return min(n, math.ceil(n * odd + 6 * math.sqrt(n * odd * (1 - odd) / 2)))


def signatures(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """doc_id, n_shingles, digest (of the whole set), bands, sketch for each row of ``docs(doc_id, text)``."""
    bands = bands_for(similarity)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[bytes, int] = {}
        xors, factors = parameters(bands * ROWS)
        tags = np.arange(bands, dtype=np.uint64)
        for pdf in batches:
            rows = []
            for raw in pdf["text"]:
                h = shingles(raw, width, cache)
                if not len(h):
                    rows.append((0, None, None, None))
                    continue
                m = minhash(h, xors, factors)
                key = tags.copy()
                for k in range(ROWS):
                    key = mixed(key * MIX1 + m[k::ROWS])
                rows.append((len(h), xxhash.xxh3_128_digest(h.tobytes()), key.view(np.int64), odd_sketch(m)))
            out = pd.DataFrame(rows, columns=["n_shingles", "digest", "bands", "sketch"])
            out.insert(0, "doc_id", pdf["doc_id"].values)
            yield out

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return map_with_ids(rows, run, "doc_id long, n_shingles long, digest binary, bands array<long>, sketch array<long>", "doc_id")


def differing(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def sketched(pairs: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """``pairs(a, b)`` with ``bits``: those whose sketches and set sizes allow the similarity."""
    left = reps.select(F.col("rep").alias("a"), F.col("sketch").alias("sa"), F.col("size").alias("na"))
    right = reps.select(F.col("rep").alias("b"), F.col("sketch").alias("sb"), F.col("size").alias("nb"))
    pairs = pairs.join(left, "a").join(right, "b").withColumn("bits", differing(F.col("sa"), F.col("sb")))
    near = F.col("bits") <= most_bits(similarity, bands_for(similarity) * ROWS)
    percent = round(100 * similarity)
    sizes = (100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na"))
    return pairs.where(near & sizes).drop("sa", "sb", "na", "nb")


def small(rows: DataFrame) -> DataFrame:
    """A written table as the small side of a join: sent to every task if it has at most BROADCAST_IDS rows."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def texts_of(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, text (binary) of the given documents."""
    return texts.join(small(written(ids, "ids")), "doc_id", "left_semi")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """``pairs(a, b)`` of which 100 * intersection >= 100 * similarity * union holds on the whole sets, written."""
    percent = round(100 * similarity)
    # a class representative is the smallest id of its set; of repeated rows with that id any text has a set of its own,
    # so the pair holds if it holds for one of them
    texts = texts_of(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), texts)
    rows = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[bytes, int] = {}
        last: tuple[bytes | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for pdf in batches:
            keep = []
            for ta, tb in zip(pdf["ta"], pdf["tb"], strict=True):
                if ta != last[0]:
                    last = (ta, shingles(ta, width, cache))
                x, y = last[1], shingles(tb, width, cache)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pdf.loc[keep, ["a", "b"]]

    return written(rows.select("a", "b", "ta", "tb").mapInPandas(run, "a long, b long").distinct(), "links")


def ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def link(docs: DataFrame, *, width: int = 3, similarity: float = 0.85) -> DataFrame:
    """Components of documents linked by the Jaccard similarity of their ``width``-word shingle sets.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id).

    1. Rows with the same set are one class; its smallest doc_id represents it from here on.
    2. Large groups are joined in a few bands: each bucket has a hub, the class that meets most others, and each class goes
       with the hub whose odd sketch is nearest, so a group of any size yields one pair a class (:func:`first_pairs`).
    3. In the buckets of all bands only classes outside the bucket's largest component go on. Each is compared with a hub of
       that component and with two hubs among the others (:func:`fringe_of`). Sketches reject, whole sets confirm.
    4. What a bucket still leaves unseen between components is found by bounds on the shingles in which classes differ from
       the middle of their group (:func:`across`), so no link is lost to the shortcuts of steps 2 and 3.

    Null and empty texts have 0 shingles and no links. A null doc_id links with nothing: its component_id is null and it
    is kept. Repeated doc_ids are one document with the sets of all its rows; equal rows count once. Very long texts are
    hashed in blocks. An empty table gives an empty result.
    """
    sig = written(signatures(docs, width, similarity), "signatures")
    filled = sig.where("n_shingles > 0 AND doc_id IS NOT NULL")
    again = written(filled.groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    repeated = not again.isEmpty()
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", F.col("text").cast("binary").alias("text"))
    if repeated:
        texts = texts.join(again, "doc_id", "left_anti").unionByName(texts.join(again, "doc_id", "left_semi").distinct())
    # the digest stands for the set, so the other columns are equal within a class
    reps = written(filled.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")

    placed, chosen = first_pairs(reps, similarity)
    comp = components(confirmed(chosen, texts, width, similarity), "a", "b")
    classes = with_component(reps.select("rep", "bands").join(placed.select("rep", "score"), "rep", "left"), comp)
    sizes = comp.groupBy(F.col("component").alias("comp")).agg(F.count("*").alias("n"))
    classes = written(classes.join(sizes, "comp", "left").select("rep", "comp", "bands", standing().alias("standing")), "placed")

    fringe = fringe_of(classes)
    hubs = F.explode(F.array(F.struct(F.col("hub"), F.col("giant").alias("of")), F.struct(F.col("hub2").alias("hub"), F.col("comp2").alias("of")), F.struct(F.col("hub3").alias("hub"), F.col("comp3").alias("of"))))
    met = fringe.select("rep", "comp", hubs.alias("h")).where("h.hub IS NOT NULL AND h.of <> comp").select(*ordered("rep", "h.hub")).distinct()
    met = written(sketched(met.join(chosen, ["a", "b"], "left_anti"), reps, similarity).select("a", "b").distinct(), "met")
    tested = chosen.unionByName(met)
    if not met.isEmpty():
        comp = merged(comp, confirmed(met, texts, width, similarity))

    left = written(unseen(fringe, comp), "unseen")
    if not left.isEmpty():
        comp = across(left, classes.select("rep", "standing"), comp, reps, tested, texts, width, similarity)

    out = sig.select("doc_id", "n_shingles", "digest").join(reps.select("digest", "rep"), "digest", "left")
    out = out.withColumn("node", F.coalesce("rep", "doc_id"))
    if repeated:
        # different sets of one doc_id hang together through it
        comp = merged(comp, out.where("node <> doc_id").join(again, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct())
    out = out.join(comp.withColumnRenamed("component", "linked"), "node", "left").withColumn("component_id", F.coalesce("linked", "node"))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def first_pairs(reps: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Classes that meet others in the first bands with their ``score`` (how many they meet), and one pair (a, b) of each with
    the nearest hub by sketch.

    In a group of near copies the class in the middle shares the most bands and so meets the most: it is the hub of nearly
    all the group's buckets.
    """
    rows = reps.select("rep", F.explode(F.slice("bands", 1, FIRST_BANDS)).alias("key"))
    shared = written(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    placed = written(rows.join(shared, "key").groupBy("rep").agg(F.sum("n").alias("score"), F.collect_set("key").alias("keys")), "first")
    rows = placed.select("rep", "score", F.explode("keys").alias("key"))
    hubs = written(rows.groupBy("key").agg(F.max_by("rep", F.least("score", F.lit((1 << 40) - 1)) * F.lit(1 << 22) + F.xxhash64("rep").bitwiseAND(F.lit((1 << 22) - 1))).alias("hub")), "hubs")
    met = rows.join(hubs, "key").where("rep <> hub").select("rep", *ordered("rep", "hub")).distinct()
    best = sketched(met, reps, similarity).groupBy("rep").agg(F.min_by(F.struct("a", "b"), F.struct("bits", "a", "b")).alias("p"))
    return placed, written(best.select("p.a", "p.b").distinct(), "chosen")


def standing() -> Column:
    """Order of the classes of a bucket in one number: size of the component ``n``, the component, ``score``, the class."""
    n, score = (F.least(F.coalesce(F.col(c), F.lit(d)), F.lit((1 << 20) - 1)).cast("long") for c, d in (("n", 1), ("score", 0)))
    tie = lambda c, bits: F.xxhash64(c).bitwiseAND(F.lit((1 << bits) - 1))
    return F.shiftleft(n, 43) + F.shiftleft(tie("comp", 12), 31) + F.shiftleft(score, 11) + tie("rep", 11)


def fringe_of(classes: DataFrame) -> DataFrame:
    """The rows (key, rep, comp) of buckets of several components that are outside the bucket's ``giant``, its component of the
    largest size, written. ``hub`` is the giant's member in the middle, ``hub2`` and ``hub3`` are members of two other
    components, ``inside`` counts the giant's rows in the bucket and ``others`` the rest.
    """
    rows = classes.select("rep", "comp", "standing", F.explode("bands").alias("key"))
    top = lambda c: F.max_by(c, "standing")
    several = rows.groupBy("key").agg(top("rep").alias("hub"), top("comp").alias("giant"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n")).where("low <> high")
    several = written(several.select("key", "hub", "giant", "n"), "buckets")
    outside = rows.join(small(several), "key").where("comp <> giant")
    outside = written(outside.select("key", "rep", "comp", "standing", "hub", "giant", "n"), "outside")
    second = written(outside.groupBy("key").agg(F.count("*").alias("others"), top("rep").alias("hub2"), top("comp").alias("comp2")), "second")
    outside = outside.join(second, "key").withColumn("inside", F.col("n") - F.col("others"))
    third = written(outside.where("comp <> comp2").groupBy("key").agg(top("rep").alias("hub3"), top("comp").alias("comp3")), "third")
    return written(outside.join(third, "key", "left").drop("standing", "n"), "fringe")


def unseen(fringe: DataFrame, comp: DataFrame) -> DataFrame:
    """rep, comp, giant, wide: the fringe's rows that may have links which no hub has shown, with components as they are now.

    The giant's hub has met all others, and the two other hubs have met each other's components: where the giant has no more
    members in the bucket (else ``wide``), the hubs are done and so is a bucket in which one component is left.
    """
    now = comp.select("node", "component")
    rows = fringe.join(now.select(F.col("node").alias("rep"), F.col("component").alias("_r")), "rep", "left").join(now.select(F.col("node").alias("hub"), F.col("component").alias("_h")), "hub", "left")
    # a component that has grown is the one of its members: the hub is the giant's
    rows = rows.withColumn("comp", F.coalesce("_r", "comp")).withColumn("giant", F.coalesce("_h", "giant")).where("comp <> giant")
    wide = F.col("inside") > 1
    rows = rows.where(wide | ~(F.col("rep").eqNullSafe(F.col("hub2")) | F.col("rep").eqNullSafe(F.col("hub3")))).withColumn("wide", wide)
    open_ = written(rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("wide").alias("wide")).where("wide OR low <> high").select("key"), "open")
    return rows.join(open_, "key", "left_semi").groupBy("giant", "rep", "comp").agg(F.max("wide").alias("wide"))


def across(left: DataFrame, standings: DataFrame, comp: DataFrame, reps: DataFrame, tested: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """``comp`` with the links between components that :func:`unseen` leaves.

    Every pair of a bucket is in the group of the bucket's giant: its rows ``left``, and the giant's members where they count.
    The giant's member in the middle is the group's pivot P; all are compared with it. For X and Y without a link to P,
    |X & Y| <= min(|X & P|, |Y & P|) + |(X - P) & (Y - P)|. So Y either shares shingles with X that P lacks, which are few
    and rare, or X and Y lie within P almost wholly and are smaller than P. The first kind is found by a join on the rarest
    of those shingles, as many of each as no pair can do without (prefix and positional filter); sketches and whole sets
    decide. The second kind is compared in lots of bounded size, whole sets at once, as bitmaps over the shingles of P
    (:func:`links_in_lots`), and so is a whole group whose shingles aren't rare, as where many texts are cut from one: there
    the join would make nearly all pairs. The bound holds for any pivot, so no link is lost.
    """
    percent = round(100 * similarity)
    whole = 100 + percent
    groups = written(left.groupBy(F.col("giant").alias("g")).agg(F.max("wide").alias("wide")), "groups")
    now = written(with_component(standings, comp), "now")
    members = now.join(groups, now.comp == groups.g).select("g", "rep", "comp", "wide", "standing")
    pivots = written(members.groupBy("g").agg(F.max_by("rep", "standing").alias("pivot")), "pivots")
    items = left.select(F.col("giant").alias("g"), "rep", "comp").unionByName(members.where("wide").select("g", "rep", "comp")).distinct()
    items = written(items.join(pivots, "g").where("rep <> pivot"), "items")
    found = texts_of(items.select(F.col("rep").alias("doc_id")).unionByName(pivots.select(F.col("pivot").alias("doc_id"))).distinct(), texts)
    middle = written(pivots.join(found, pivots.pivot == found.doc_id).groupBy("g").agg(F.max("text").alias("middle")), "middle")
    rows = items.join(found.withColumnRenamed("doc_id", "rep"), "rep").join(middle, "g")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[bytes, int] = {}
        last: tuple[bytes | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for pdf in batches:
            out = []
            for text, p in zip(pdf["text"], pdf["middle"], strict=True):
                if p != last[0]:
                    last = (p, shingles(p, width, cache))
                x = shingles(text, width, cache)
                rest = np.setdiff1d(x, last[1], assume_unique=True)
                base = len(x) - len(rest)
                linked = base > 0 and 100 * base >= percent * (len(x) + len(last[1]) - base)
                have = np.packbits(np.isin(last[1], x, assume_unique=True)).tobytes()
                out.append((xxhash.xxh3_64_intdigest(x.tobytes(), 1) >> 1, len(x), base, linked, rest.view(np.int64), have))
            yield pd.concat([pdf[["g", "rep", "comp", "pivot"]].reset_index(drop=True), pd.DataFrame(out, columns=["which", "size", "base", "linked", "rest", "have"])], axis=1)

    schema = "g long, rep long, comp long, pivot long, which long, size long, base long, linked boolean, rest array<long>, have binary"
    items = written(rows.select("g", "rep", "comp", "pivot", "text", "middle").mapInPandas(run, schema), "differences")
    comp = merged(comp, items.where("linked AND comp <> g").select(*ordered("rep", "pivot")).distinct())
    named = comp.select(F.col("node").alias("_node"), F.col("component").alias("_c"))
    items = items.join(named, F.col("rep") == F.col("_node"), "left").withColumn("comp", F.coalesce("_c", "comp")).drop("_node", "_c")
    items = items.join(named, F.col("pivot") == F.col("_node"), "left").withColumn("outside", F.col("comp") != F.coalesce("_c", "g")).drop("_node", "_c", "linked", "pivot")
    items = written(items, "sided")

    id_ = ["g", "rep", "which"]
    each = items.select(*id_, "comp", "outside", F.explode("rest").alias("shingle"))
    common = each.groupBy("g", "shingle").agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("outside").alias("outside")).where("low <> high AND outside").select("g", "shingle", "n")
    held = each.join(written(common, "common"), ["g", "shingle"]).groupBy(*id_).agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("held"))
    least = written(items.groupBy("g").agg(F.min("size").alias("least")), "least")
    able = items.drop("rest").join(held, id_, "left").withColumn("held", F.coalesce(F.transform("held", lambda s: s["shingle"]), F.array().cast("array<long>"))).join(least, "g")
    # what a link needs: the other set has at least t times this one's size, and the group's least size
    needs = percent * (F.col("size") + F.greatest(F.col("least").cast("double"), F.col("size") * percent / 100)) / whole
    able = able.withColumn("more", F.ceil(needs - 1e-6) - F.col("base")).where(F.size("held") >= F.col("more"))
    able = written(able.select(*id_, "comp", "outside", "size", "base", "more", "held", "have"), "able")

    def pairs(x: DataFrame, y: DataFrame, common: Column) -> DataFrame:
        """Pairs of different components, the first outside, that meet in a shingle and whose sizes fit with ``common``
        shingles at most; a pair of two outside comes once."""
        x, y = x.alias("x"), y.alias("y")
        same = (F.col("x.g") == F.col("y.g")) & (F.col("x.shingle") == F.col("y.shingle"))
        fit = (100 * F.col("x.size") >= percent * F.col("y.size")) & (100 * F.col("y.size") >= percent * F.col("x.size")) & (F.col("x.comp") != F.col("y.comp")) & (~F.col("y.outside") | (F.col("x.rep") < F.col("y.rep")))
        met = x.join(y, same & fit & (whole * common >= percent * (F.col("x.size") + F.col("y.size"))))
        return met.select("x.g", F.col("x.rep").alias("xr"), F.col("x.which").alias("xw"), F.col("y.rep").alias("yr"), F.col("y.which").alias("yw")).distinct()

    # where a pair meets first in the order of rarity, only what comes behind in both can be common too
    prefix = able.select("*", F.posexplode(F.slice("held", F.lit(1), F.least(F.size("held"), F.size("held") - F.col("more") + 1).cast("int"))).alias("at", "shingle"))
    prefix = prefix.withColumn("upto", F.size("held") - F.col("at")).drop("held", "at", "have")
    meetings = prefix.groupBy("g", "shingle").agg((F.count("*") * F.count_if("outside").cast("double")).alias("n")).groupBy("g").agg(F.sum("n").alias("n"))
    many = meetings.join(able.groupBy("g").agg(F.count("*").alias("classes")), "g").where(F.col("n") > MEETINGS * F.col("classes")).select("g", F.lit(True).alias("many"))
    many = small(written(many, "many"))
    prefix = prefix.join(many, "g", "left_anti")
    met = pairs(prefix.where("outside"), prefix, F.least("x.base", "y.base") + F.least("x.upto", "y.upto"))
    x = able.select("g", F.col("rep").alias("xr"), F.col("which").alias("xw"), F.col("size").alias("xs"), F.col("base").alias("xb"), F.col("held").alias("xh"))
    y = able.select("g", F.col("rep").alias("yr"), F.col("which").alias("yw"), F.col("size").alias("ys"), F.col("base").alias("yb"), F.col("held").alias("yh"))
    met = met.join(x, ["g", "xr", "xw"]).join(y, ["g", "yr", "yw"])
    met = met.where(whole * (F.least("xb", "yb") + F.size(F.array_intersect("xh", "yh"))) >= percent * (F.col("xs") + F.col("ys"))).select("xr", "yr")
    found = met.select(*ordered("xr", "yr")).distinct().join(tested, ["a", "b"], "left_anti")
    found = written(sketched(found, reps, similarity).select("a", "b").distinct(), "across")
    if not found.isEmpty():
        comp = merged(comp, confirmed(found, texts, width, similarity))
    rows = able.join(many, "g", "left").where("many OR more <= 0").select(*id_, "comp", "outside", "size", F.col("held").alias("rest"), "have")
    links = links_in_lots(with_component(rows.drop("comp"), comp), percent)
    return comp if links.isEmpty() else merged(comp, links)


def overlaps(x: pd.DataFrame, y: pd.DataFrame) -> np.ndarray:
    """Shingles that each row of ``x`` and each of ``y`` have in common, as products of their incidence matrices: over the
    pivot's shingles (``have``) and over those others (``rest``) that both sides hold."""
    common = np.zeros((len(x), len(y)))
    hx, hy = (np.frombuffer(b"".join(d["have"]), np.uint8).reshape(len(d), -1) for d in (x, y))
    for at in range(0, hx.shape[1], COLUMNS // 8):
        u, v = (np.unpackbits(h[:, at : at + COLUMNS // 8], axis=1).astype(np.float32) for h in (hx, hy))
        common += u @ v.T
    sides = [(np.concatenate([np.asarray(r, np.int64) for r in d["rest"]]), np.repeat(np.arange(len(d)), d["rest"].map(len)), len(d)) for d in (x, y)]
    both = np.intersect1d(sides[0][0], sides[1][0])
    for at in range(0, len(both), COLUMNS):
        part = both[at : at + COLUMNS]
        u, v = (np.zeros((n, len(part)), np.float32) for *_, n in sides)
        for m, (shingle, row, _) in zip((u, v), sides, strict=True):
            k = np.minimum(np.searchsorted(part, shingle), len(part) - 1)
            hit = part[k] == shingle
            m[row[hit], k[hit]] = 1
        common += u @ v.T
    return common


def spanning(a: np.ndarray, b: np.ndarray, comp_a: np.ndarray, comp_b: np.ndarray) -> list[int]:
    """Places of links (a, b) that join their components as all the links do: one at most for each component joined."""
    _, first = np.unique(np.stack([comp_a, comp_b]), axis=1, return_index=True)
    up: dict[int, int] = {}

    def root(c: int) -> int:
        while up.get(c, c) != c:
            up[c] = c = up.get(up[c], up[c])
        return c

    kept = []
    for k in first.tolist():
        p, q = root(int(comp_a[k])), root(int(comp_b[k]))
        if p != q:
            up[q] = p
            kept.append(k)
    return kept


def links_in_lots(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join what all links between different components of a group join, of ``rows(g, rep, which, comp,
    outside, size, rest, have)``, at least one side of each outside.

    A group's rows of a size step are dealt into lots of at most LOT rows or LOT_BYTES on average; lots of neighbouring steps
    meet, one task each, which counts common shingles by products of matrices. A row travels once for each lot that it
    meets; pairs don't travel, but for at most one link for each row of the lots. Comparisons still grow with the square of
    the group's rows of neighbouring sizes, but as sums of products, some 10^10 a second and core.
    """
    step = F.floor(F.log(F.col("size").cast("double")) / math.log(100 / percent)).cast("int")
    rows = written(rows.withColumns({"step": step, "deal": F.xxhash64("rep", "which")}), "within")
    per = F.greatest(F.lit(16.0), F.least(F.lit(float(LOT)), F.lit(float(LOT_BYTES)) / F.greatest(F.lit(1), F.max(F.length("have")))))
    lots = written(rows.groupBy("g", "step").agg(F.ceil(F.count("*") / per).alias("lots"), F.ceil(F.count_if("outside") / per).alias("out")), "lots")
    x, y = lots.where("out > 0").select("g", F.col("step").alias("xs"), F.col("out").alias("xn")), lots.select("g", F.col("step").alias("ys"), F.col("lots").alias("yn"))
    meets = written(x.join(y, "g").where(F.abs(F.col("xs") - F.col("ys")) <= 1), "meets")
    key = ["g", "xs", "ys", "xk", "yk"]

    def dealt(rows: DataFrame, mine: str, other: str) -> DataFrame:
        rows = rows.withColumnRenamed("step", f"{mine}s").join(small(meets), ["g", f"{mine}s"])
        own, each = F.pmod("deal", f"{mine}n").alias(f"{mine}k"), F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}n") - 1)).alias(f"{other}k")
        rows = rows.select("g", "xs", "ys", own, each, "rep", "comp", "outside", "size", "rest", "have")
        return rows.toDF(*rows.columns)  # columns of its own, as both sides come from one table

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        a = b = np.zeros(0, np.int64)
        if len(x) and len(y):
            x, y = x.sort_values("rep", ignore_index=True), y.sort_values("rep", ignore_index=True)
            common, xs, ys = overlaps(x, y), x["size"].to_numpy()[:, None], y["size"].to_numpy()[None, :]
            near = (common > 0) & (100 * common >= percent * (xs + ys - common))
            i, j = np.nonzero(near & (x["comp"].to_numpy()[:, None] != y["comp"].to_numpy()[None, :]))
            a, b = x["rep"].to_numpy()[i], y["rep"].to_numpy()[j]
            k = spanning(a, b, x["comp"].to_numpy()[i], y["comp"].to_numpy()[j])
            a, b = a[k], b[k]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    sides = [dealt(r, *names).groupBy(*key) for r, names in ((rows.where("outside"), "xy"), (rows, "yx"))]
    return written(sides[0].cogroup(sides[1]).applyInPandas(run, "a long, b long").distinct(), "linked_in_lots")


def merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) of what ``comp`` joins already and ``links(a, b)`` join besides: only components are linked anew."""
    a, b = (comp.select(F.col("node").alias(x), F.col("component").alias(f"{x}_comp")) for x in ("a", "b"))
    ends = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b"))
    above = components(ends, "a", "b")
    if above.isEmpty():
        return comp
    up = above.select(F.col("node").alias("component"), F.col("component").alias("top"))
    moved = comp.join(up, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    new = above.join(comp.select("node"), "node", "left_anti")
    return written(moved.unionByName(new), "components")


def with_component(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """``rows(rep)`` with ``comp``: the component of a class, or itself."""
    return rows.join(comp, rows.rep == comp.node, "left").withColumn("comp", F.coalesce("component", "rep")).drop("node", "component")
