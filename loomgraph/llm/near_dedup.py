"""Near-duplicate classes by ProbMinHash.

Shingles are runs of ``words`` lower-cased words (a text with fewer words is one shingle), weighted by
1 + ln(count in the text). Every shingle sends a Poisson process whose rate is its weight over the registers, each
register once; the earliest arrival owns the register, and a text stops once the next arrivals of all its shingles come
later than its latest register, so that registers agree with the probability Jaccard similarity of the weights. The
weights steer which texts meet; a link needs ``least`` Jaccard similarity of the sets of shingles, counted exactly.

Texts with equal words collapse first. Bands of four registers then bring texts together in buckets, in which members
are compared with one of them, the centre, and never with each other; linked texts form classes.

An exact search for the links between classes follows, so that none is lost to registers or centres. Of two texts that
are similar enough, both have ``least`` of their shingles in common, so under any order of all shingles the first k that
they share lie among the first n - least * n + k of each. Under the order of the hashes, this leaves aside every text
that shares fewer than k of its first ones with any other text; the rest, with their buckets, are all that is compared.
Under the order of rising frequency, the first n - least * n + 1 are a text's entries, which bring texts together once
more; what stands before the first shared one is not shared, which bounds how many can be. Groups of several classes
compare their members with the cleanest of them in TURNS turns, which join what belongs together cheaply, and then all
pairs of members of different classes that the bound lets through. No other pair can be a link between two classes.
Texts travel as their sets of shingle hashes, and only those that are compared.

Defined results: texts that are null or have no words are classes of their own; class_id is the smallest doc_id of the
class; rows that share a doc_id are one document and get one class; rows without doc_id get none. Extra columns are
ignored. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textnp as tn
from .common import discard, released, staged
from .components import stars

REGISTERS, ROWS = 128, 4
BANDS = REGISTERS // ROWS
#: Orders in which a bucket's centre is chosen; with few, buckets of one group share their centres.
CENTRES = 4
#: Turns that join classes before all pairs of classes are looked through, at most; another one is worth its tables only
#: after one that brought together a pair for so many members of groups. All pairs follow in any case.
TURNS, WORTH = 2, 20
_OTHER = 0xC2B2AE3D27D4EB4F
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(data: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle hash, count) of each row's distinct shingles, and a pair of hashes of each row's words."""
    data = _LOWER[data]
    starts, ends, first = tn.words(data, off)
    n, size = len(starts), np.diff(first)
    hashes = tn.word_hashes(data, starts, ends) if n else np.zeros(0, np.uint64)
    sums, other = tn.prefix(hashes), tn.prefix(tn.mix(hashes + np.uint64(0x51ED27)), _OTHER)
    same = np.stack([tn.ranges_hash(sums, first[:-1], first[1:]), tn.ranges_hash(other, first[:-1], first[1:], _OTHER)])
    row = np.repeat(np.arange(len(size)), size)
    full = np.flatnonzero(row[: n - words + 1] == row[words - 1 :]) if n >= words else np.zeros(0, np.int64)
    short = np.flatnonzero((size > 0) & (size < words))
    lo = np.concatenate([full, first[short]])
    hi = np.concatenate([full + words, first[short + 1]])
    of = np.concatenate([row[full], short])
    key = tn.ranges_hash(sums, lo, hi)
    order = np.lexsort((key, of))
    key, of = key[order], of[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    return of[at], key[at], np.diff(np.append(at, len(key))), same


def prob_min_hash(row: np.ndarray, key: np.ndarray, weight: np.ndarray, rows: int, m: int = REGISTERS) -> np.ndarray:
    """rows x m register owners. Arrival j of an element comes after a further exponential gap scaled by m / (m - j), at its own next register."""
    reach, owner = np.full(rows * m, np.inf), np.zeros(rows * m, np.uint64)
    shift, step = tn.mix(key + np.uint64(0xA5A5)) % np.uint64(m), (tn.mix(key + np.uint64(0x5A5A)) % np.uint64(m // 2)) * np.uint64(2) + np.uint64(1)
    time = np.zeros(len(key))
    for j in range(m):
        u = tn.mix(key + np.uint64((0x9E3779B97F4A7C15 * (j + 1)) & (2**64 - 1)))
        time = time - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) * (m / (m - j)) / weight
        slot = row * m + ((shift + step * np.uint64(j)) % np.uint64(m)).astype(np.int64)
        np.minimum.at(reach, slot, time)
        won = reach[slot] == time
        owner[slot[won]] = key[won]
        alive = time < reach.reshape(rows, m).max(1)[row]
        if not alive.any():
            break
        row, key, weight, shift, step, time = row[alive], key[alive], weight[alive], shift[alive], step[alive], time[alive]
    return owner.reshape(rows, m)


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.view(np.int64).ravel()))


def _needed(n: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(how many of n shingles a similar text has at least, how many of those are looked for under the order of the hashes).

    Neither these numbers nor their difference fall as n rises, so that the first ones of the smaller of two texts hold
    as many shared ones as the larger one looks for.
    """
    common = np.maximum(1, np.ceil(least * n - 1e-9)).astype(np.int64)
    return common, np.maximum(1, common // 8)


def _sketch(words: int, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, off in tn.chunks(batch.column(1), tn.CHUNK_BYTES // 2):
                row, key, times, same = shingles(data, off, words)
                owner = prob_min_hash(row, key, 1 + np.log(times), hi - lo)
                distinct = np.bincount(row, minlength=hi - lo)
                parts = owner.reshape(hi - lo, BANDS, ROWS)
                bands = np.zeros((hi - lo, BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
                for i in range(ROWS):
                    bands = tn.mix(bands * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
                lists = _lists(bands, np.arange(hi - lo + 1) * BANDS)
                common, some = _needed(distinct, least)
                size, start = np.where(distinct > 0, distinct - common + some, 0), np.cumsum(distinct) - distinct
                # keys are in order within each row
                firsts = _lists(key[np.arange(len(row)) - start[row] < size[row]], np.append(0, np.cumsum(size)))
                out = pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(same[0].view(np.int64)), pa.array(same[1].view(np.int64)), pa.array(distinct, pa.int32()), pa.array(some, pa.int32()), lists, firsts], ["doc_id", "h1", "h2", "n", "some", "bands", "firsts"])
                yield out.filter(pa.array(distinct > 0))

    return run


def _sets(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, text) -> (doc_id, s): the hashes of each text's distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in tn.chunks(batch.column(1), tn.CHUNK_BYTES // 2):
                row, key, _, _ = shingles(data, off, words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), _lists(key, np.searchsorted(row, np.arange(hi - lo + 1)))], ["doc_id", "s"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) whose sets are similar enough."""
    # a small list of the texts that are asked for is broadcast to the sets, so that only theirs travel
    ends = staged(pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct(), "ends")
    asked = sets.join(ends, "doc_id", "left_semi")
    both = pairs.join(asked.select(F.col("doc_id").alias("u"), F.col("s").alias("a")), "u").join(asked.select(F.col("doc_id").alias("v"), F.col("s").alias("b")), "v")
    return both.where(F.size(F.array_intersect("a", "b")) * (1 + least) >= least * (F.size("a") + F.size("b")) - 1e-9).select("u", "v")


def _similar(common: Column, n: Column, m: Column, least: float) -> Column:
    """Whether sets of n and m are similar enough with so many in common."""
    return common * (1 + least) >= least * (n + m) - 1e-9


def _pairs(met: DataFrame, other: Column, least: float) -> DataFrame:
    """(u, v) of members (node, n) and centres c (node, n), but for those whose sizes alone keep them apart."""
    return met.where(other & _similar(F.least("n", "c.n"), F.col("n"), F.col("c.n"), least)).select(F.greatest("node", "c.node").alias("u"), F.least("node", "c.node").alias("v"))


def _rank() -> Column:
    return F.xxhash64("node", F.pmod("bucket", F.lit(CENTRES)))


def _texts(sketches: DataFrame) -> DataFrame:
    """(h1, h2, rep, alive) of every text: its smallest document, and whether it shares enough of its first shingles with other texts."""
    met = sketches.select("h1", F.explode("firsts").alias("h")).groupBy("h").agg(F.min("h1").alias("h1"), F.max("h1").alias("b"))
    own = met.where("h1 = b").groupBy("h1").agg(F.count(F.lit(1)).alias("own"))
    texts = sketches.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.max("some").alias("some"), F.max(F.size("firsts")).alias("size"))
    return texts.join(own, "h1", "left").select("h1", "h2", "rep", (F.col("size") - F.coalesce("own", F.lit(0)) >= F.col("some")).alias("alive"))


def _entries(sets: DataFrame, least: float) -> DataFrame:
    """(h, node, n, rest) of each set's first shingles under the order of rising frequency, those of one set alone left out; rest: the place's distance from the end."""
    rows = sets.select("node", F.size("s").alias("n"), F.explode("s").alias("h"))
    often = rows.groupBy("h").agg(F.count(F.lit(1)).alias("times"), F.min("node").alias("a"), F.max("node").alias("b")).where("a != b")
    often = staged(often.select("h", "times"), "often")
    # dense: a document of several rows may hold a shingle more than once
    along = Window.partitionBy("node").orderBy(F.desc("times"), F.desc("h"))
    placed = rows.join(often, "h").withColumn("rest", F.dense_rank().over(along))
    entries = staged(placed.where(F.col("rest") >= F.greatest(F.lit(1), F.ceil(least * F.col("n") - 1e-9))).select("h", "node", "n", "rest"), "entries")
    discard(often)
    return entries


def _several(entries: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """(h, node, n, rest, root) of the groups by h that hold several classes, without members that are similar to none even of the group's smallest size."""
    labelled = staged(entries.join(classes, "node"), "labelled")
    several = staged(labelled.groupBy("h").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.min("n").alias("m")).where("a != b").select("h", "m"), "several")
    left = staged(labelled.join(several, "h").where(_similar(F.col("rest"), F.col("n"), F.greatest("m", least * F.col("n")), least)).drop("m"), "left")
    discard(labelled, several)
    return left


def _across(met: DataFrame, other: Column, least: float) -> DataFrame:
    """(u, v) of members and c (node, n, rest) of a group, but for those whose places keep them apart; distinct."""
    bound = _similar(F.least("rest", "c.rest"), F.col("n"), F.col("c.n"), least)
    return met.where(other & bound).select(F.greatest("node", "c.node").alias("u"), F.least("node", "c.node").alias("v")).distinct()


def _turn(left: DataFrame, turn: int, least: float) -> DataFrame:
    """Pairs of each group's cleanest member, of those that the turn deals together, with members of other classes."""
    clean = F.struct((F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1 + turn)) == 0).alias("dealt"), (F.col("rest") / F.col("n")).alias("share"), "node", "n", "rest", "root")
    hubs = staged(left.groupBy("h").agg(F.max(clean).alias("c")), "hubs")
    return _across(left.join(hubs, "h"), F.col("root") != F.col("c.root"), least)


def _roots(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(u, v) of the links' classes (node, root)."""
    ends = links.join(classes.select(F.col("node").alias("u"), F.col("root").alias("a")), "u").join(classes.select(F.col("node").alias("v"), F.col("root").alias("b")), "v")
    return ends.select(F.col("a").alias("u"), F.col("b").alias("v"))


def _merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """classes (node, root) after links between roots."""
    moved = stars(links)
    out = classes.join(moved.select(F.col("u").alias("root"), F.col("v").alias("to")), "root", "left")
    out = staged(out.select("node", F.coalesce("to", "root").alias("root")), "classes")
    discard(moved)
    return out


def near_duplicates(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """(doc_id, class_id, class_size) of every row of docs."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
    kind = docs.schema["doc_id"].dataType.simpleString()
    sketches = staged(texts.mapInArrow(released(_sketch(words, least)), f"doc_id {kind}, h1 long, h2 long, n int, some int, bands array<long>, firsts array<long>"), "sketches")
    # aggregates are written before they are joined, so that a hot key's partition can be split in the join
    same = staged(_texts(sketches), "same")
    stands = F.col("alive") & (F.col("doc_id") == F.col("rep"))
    copies = sketches.select("doc_id", "h1", "h2", "n", "bands").join(same, ["h1", "h2"])
    # n and bands are kept for the one document that stands for a text, where it is compared at all
    copies = staged(copies.select("doc_id", "rep", F.when(stands, F.col("n")).alias("n"), F.when(stands, F.col("bands")).alias("bands")), "copies")
    discard(sketches, same)
    lone = copies.where("n is not null").select(F.col("doc_id").alias("node"), "n", "bands")
    sets = staged(texts.join(lone.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").mapInArrow(released(_sets(words)), f"doc_id {kind}, s array<long>"), "sets")

    keys = lone.select("node", "n", F.explode("bands").alias("bucket"))
    first = staged(keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct(_rank().alias("r"), "node", "n")).alias("c")).where("members > 1").select("bucket", "c"), "first")
    pairs = staged(_pairs(keys.join(first, "bucket"), F.col("node") != F.col("c.node"), least).distinct(), "pairs")
    links = staged(_verified(pairs, sets, least), "links")
    classes = _merged(lone.select("node", F.col("node").alias("root")).distinct(), links)  # each node is its own root
    discard(first, pairs, links)

    entries = _entries(sets.withColumnRenamed("doc_id", "node"), least)
    left = _several(entries, classes, least)
    discard(entries)
    for turn in range(TURNS):
        pairs = staged(_turn(left, turn, least), "pairs")
        links = staged(_verified(pairs, sets, least), "links")
        if links.isEmpty():
            break
        again = pairs.count() * WORTH >= left.count()
        classes, before = _merged(classes, _roots(classes, links)), left
        left = _several(before.drop("root"), classes, least)
        discard(before)
        if not again:
            break
    pairs = staged(_across(left.join(left.select("h", F.struct("node", "n", "rest", "root").alias("c")), "h"), F.col("root") > F.col("c.root"), least), "pairs")
    classes = _merged(classes, _roots(classes, staged(_verified(pairs, sets, least), "links")))

    rooted = copies.join(classes.select(F.col("node").alias("rep"), "root"), "rep", "left").select("doc_id", F.coalesce("root", "rep").alias("class_id"))
    rooted = staged(rooted.groupBy("doc_id").agg(F.min("class_id").alias("class_id")), "rooted")
    sizes = staged(rooted.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size")), "sizes")
    out = docs.select("doc_id").join(rooted.join(sizes, "class_id"), "doc_id", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))


def keep_one(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """docs without the near-duplicates: of each class all rows of the document that names it stay, and rows without doc_id."""
    classes = near_duplicates(docs.select("doc_id", "text"), words, least).where("doc_id is not null and doc_id != class_id").select("doc_id").distinct()
    return docs.join(classes, "doc_id", "left_anti")
