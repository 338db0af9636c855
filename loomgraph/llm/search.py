"""Ranked lexical search by three uniform-threshold rounds over term-partitioned postings.

Postings are written once, in the order of (term, contribution), so that a long list lies in many files and its head in
one of them. Every item is a query; its lists are those of its distinct terms.

1. Heads: the first k postings of every list. Added up by document, the k-th best sum of an item is a lower bound of its
   k-th best score.
2. Threshold: of every list, all postings that contribute at least the bound over the number of the item's lists. A
   document that no list reports is below the bound. Postings travel once, however many items want them, and what they
   give to each item is added up where they arrive, first for the k best sums of each task, whose k-th best over all
   tasks is known before any candidate is written. A document stays a candidate if it can still reach that, were each
   list that did not report it at its own maximum or just below the threshold.
3. Look-up: the exact score of each candidate, from all of its item's lists.

All is integer arithmetic but the weight of a term. A document is a row: rows that are repeated, or share a doc_id, rank on
their own. Null text has no term, and documents without terms do not count. Items that share an item_id are one item, with
the terms of all; null items, and items without terms, have no rows. Rows without doc_id rank before others of equal
score. Texts of any length are split piece by piece. Extra columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, released, staged
from .terms import Splitter, values

#: Rows up to which lists (some dozen bytes each) and candidate documents (eight bytes) are sent to all tasks. Beyond, the
#: same steps are joins that shuffle.
SMALL = 200_000
#: Postings that a task hands on at once, and sums of documents and items that it holds.
BATCH, CELLS = 1 << 16, 1 << 21

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, text) -> (item_id, term, times)."""
    split = Splitter(digits=True)
    for batch in batches:
        for i, text in enumerate(values(batch.column(1))):
            found = split.counts(text)
            yield pa.RecordBatch.from_pydict({"item_id": batch.column(0).take(pa.array([i] * len(found), pa.int32())), "term": pa.array(list(found), pa.binary()), "times": pa.array(list(found.values()), pa.int64())})


def _postings(wanted: dict[bytes, int] | None) -> Run:
    """(row, doc_id, text) -> (row, doc_id, n, term, tf) of the wanted terms, by their numbers if these are given; a row without term, but with the doc_id, for each document that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(digits=True)
        rows, ids, sizes, terms, times = [], [], [], [], []
        kind = pa.null()

        def told() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pydict({"row": pa.array(rows, pa.int64()), "doc_id": pa.array(ids, kind), "n": pa.array(sizes, pa.int64()), "term": pa.array(terms, pa.binary() if wanted is None else pa.int64()), "tf": pa.array(times, pa.int64())})
            for x in (rows, ids, sizes, terms, times):
                x.clear()
            return made

        for batch in batches:
            kind = batch.schema.field(1).type
            for row, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), values(batch.column(2)), strict=True):
                found = split.counts(text)
                if not found:
                    continue
                n, mine = found.total(), found.keys() if wanted is None else found.keys() & wanted.keys()
                ids += [doc] + [None] * len(mine)
                terms.append(None)
                times.append(None)
                terms += mine if wanted is None else [wanted[t] for t in mine]
                times += [found[t] for t in mine]
                rows += [row] * (len(mine) + 1)
                sizes += [n] * (len(mine) + 1)
                if len(rows) >= BATCH:
                    yield told()
        if rows:
            yield told()

    return run


def _first(k: int) -> Run:
    """Postings in the order of (tid, falling part) -> the first k of each list in each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tid = batch.column(0).to_numpy()
            start = np.flatnonzero(np.append(True, tid[1:] != tid[:-1])) if len(tid) else np.zeros(0, np.int64)
            yield batch.filter(pa.array(np.arange(len(tid)) - np.repeat(start, np.diff(np.append(start, len(tid)))) < k))

    return run


@dataclass
class Lists:
    """The lists of all items as arrays in the order of tid, and each item's bound and number of lists."""

    first: np.ndarray  # of each tid's entries, and the end
    item: np.ndarray
    weight: np.ndarray
    cap: np.ndarray  # the most that an entry adds to a document which it did not report
    lists: np.ndarray
    bound: np.ndarray
    whole: np.ndarray  # the sum of an item's caps
    reach: np.ndarray  # the k-th best sum of an item, as far as it is known
    k: int

    def best(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(row, tid, part) in the order of row -> (item, low): the k best sums of each item."""
        best = np.zeros((0, len(self.lists)))
        for _, low, _ in self._sums(batches):
            best = self._kept(best, low)
        at, item = np.nonzero(best)
        yield pa.RecordBatch.from_pydict({"item": item.astype(np.int32), "low": best[at, item].astype(np.int64)})

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(row, tid, part) in the order of row -> (item, row, low, high) of what may still be among an item's k best."""
        for names, low, high in self._sums(batches):
            doc, item = np.nonzero((low > 0) & (high >= self.reach))
            yield pa.RecordBatch.from_pydict({"item": item.astype(np.int32), "row": names[doc], "low": low[doc, item].astype(np.int64), "high": high[doc, item].astype(np.int64)})

    def _kept(self, best: np.ndarray, low: np.ndarray) -> np.ndarray:
        both = np.concatenate([best, low])
        return np.partition(both, len(both) - self.k, axis=0)[-self.k :] if len(both) > self.k else both

    def _sums(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Some documents at a time: their rows, their sums for each item, and what these can be at most."""
        items = len(self.lists)

        def summed(row: np.ndarray, tid: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            names, at = np.unique(row, return_inverse=True)
            times = self.first[tid + 1] - self.first[tid]
            which = np.repeat(np.arange(len(tid)), times)
            entry = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + self.first[tid][which]
            item, gain = self.item[entry], self.weight[entry] * part[which]
            told = gain * self.lists[item] >= self.bound[item]
            cell, shape = (at[which] * items + item)[told], (len(names), items)
            # sums of integers far below 2**53
            low = np.bincount(cell, gain[told], len(names) * items).reshape(shape)
            high = low + self.whole - np.bincount(cell, self.cap[entry[told]], len(names) * items).reshape(shape)
            return names, low, high

        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            held.append(tuple(c.to_numpy() for c in batch.columns))
            if not batch.num_rows:
                continue
            row, tid, part = (np.concatenate(c) for c in zip(*held, strict=True))
            starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            # documents together until they have CELLS sums or summands; the last may go on in the next batch
            each = np.maximum(np.add.reduceat(self.first[tid + 1] - self.first[tid], starts), items)
            block = np.cumsum(each)[:-1] // CELLS
            cuts = [0, *starts[1:][np.flatnonzero(np.append(block[1:] != block[:-1], True))].tolist()] if len(block) else [0]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                yield summed(row[lo:hi], tid[lo:hi], part[lo:hi])
            held = [(row[cuts[-1] :], tid[cuts[-1] :], part[cuts[-1] :])]
        if held and len(held[0][0]):
            yield summed(*(np.concatenate(c) for c in zip(*held, strict=True)))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL else df


def _kth(sums: DataFrame, k: int) -> DataFrame:
    """(item, bound): the k-th best sum of each item that has as many."""
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("low")))
    return sums.withColumn("place", place).where(F.col("place") == k).select("item", F.col("low").alias("bound"))


def contribution(tf: Column, n: Column, docs: int, terms: int) -> Column:
    """What one occurrence of a term in the query gets from a document, before the term's weight."""
    tf, n = tf.cast("long"), n.cast("long")
    # wider than 64 bits in between, since length times number of documents grows with both
    size = F.lit(100 - 75) + F.expr(f"(cast(75 * n as decimal(20,0)) * cast({docs}L as decimal(18,0))) div cast({max(terms, 1)}L as decimal(18,0))")
    return F.call_function("div", F.lit(1_000_000_000) * tf, F.lit(1000) * tf + F.lit(8) * size)


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """df with gapless numbers from 0; staged."""
    placed = staged(df.withColumn("at", F.monotonically_increasing_id()), f"{name}-placed")
    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # one row a task that wrote
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    made = placed.join(F.broadcast(before), part == F.col("part")).withColumn(name, F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    made = staged(made.drop("at", "part", "before"), name)
    discard(placed)
    return made


def index(docs: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(names, postings, weights) of the wanted (tid, term): (row, doc_id), (tid, part, row) in the order of tid and falling part, (tid, weight)."""
    known = wanted.limit(SMALL + 1).collect()
    held = {bytes(r.term): r.tid for r in known} if len(known) <= SMALL else None
    # rows are numbered once, on their way into the table that all else is read from
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    kind, term = docs.schema["doc_id"].dataType.simpleString(), "binary" if held is None else "long"
    hits = staged(rows.mapInArrow(released(_postings(held)), f"row long, doc_id {kind}, n long, term {term}, tf long"), "hits", "zstd")
    names = staged(hits.where("term is null").select("row", "doc_id"), "names", "zstd")
    total = hits.where("term is null").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    met = hits.where("term is not null")
    met = met.withColumnRenamed("term", "tid") if held is not None else met.join(wanted, "term").drop("term")
    weights = met.groupBy("tid").agg(F.count(F.lit(1)).alias("df")).select("tid", F.floor(1000 * F.log((2.0 * total.docs + 2) / (2.0 * F.col("df") + 1))).cast("long").alias("weight"))
    weights = staged(weights.where("weight > 0"), "weights")
    parts = met.select("tid", contribution(F.col("tf"), F.col("n"), total.docs, total.terms).alias("part"), "row").where("part > 0")
    postings = staged(parts.repartitionByRange("tid", F.desc("part")).sortWithinPartitions("tid", F.desc("part")), "postings", "zstd")
    discard(hits)
    return names, postings, weights


def _cap() -> Column:
    """What a list that did not report a document can add to it at most: its best posting, or just less than the threshold."""
    return F.least(F.col("weight") * F.col("top"), F.greatest(F.expr("(bound - 1) div lists"), F.lit(0)))


def _arrays(lists: DataFrame, k: int) -> Lists:
    """Of few lists: the whole table as arrays; tids count from 0."""
    t = lists.select("tid", "item", "weight", _cap().alias("cap"), "lists", "bound").orderBy("tid").toArrow()
    tid, item, weight, cap, number, bound = (t[c].to_numpy() for c in t.column_names)
    items, tids = int(item.max(initial=-1)) + 1, int(tid.max(initial=-1)) + 1
    each, bounds = np.ones(items, np.int64), np.zeros(items, np.int64)
    each[item], bounds[item] = number, bound
    return Lists(np.searchsorted(tid, np.arange(tids + 1)), item, weight, cap, each, bounds, np.bincount(item, cap, items), bounds, k)


def _reported(postings: DataFrame, lists: DataFrame, number: int, k: int) -> DataFrame:
    """(item, row, low, high): sums of the postings that reach their thresholds, and what the whole sums can be at most."""
    gain = F.col("weight") * F.col("part")
    if number > SMALL:
        met = postings.join(lists, "tid").where(gain * F.col("lists") >= F.col("bound")).withColumn("cap", _cap())
        sums = met.groupBy("item", "row").agg(F.sum(gain).alias("low"), F.sum("cap").alias("seen"))
        whole = lists.groupBy("item").agg(F.sum(_cap()).alias("whole"))
        return sums.join(whole, "item").select("item", "row", "low", (F.col("low") + F.col("whole") - F.col("seen")).alias("high"))
    least = F.broadcast(lists.groupBy("tid").agg(F.min(F.ceil(F.col("bound") / (F.col("lists") * F.col("weight"))) - 1).alias("least")))
    fetched = postings.join(least, "tid").where("part >= least").select("row", "tid", "part")
    dealt, arrays = fetched.repartition("row").sortWithinPartitions("row"), _arrays(lists, k)
    sums = staged(dealt.mapInArrow(released(arrays.best), "item int, low long"), "sums")
    known, reach = _kth(sums, k).toArrow(), arrays.bound.copy()
    reach[known["item"].to_numpy()] = np.maximum(reach[known["item"].to_numpy()], known["bound"].to_numpy())
    discard(sums)
    return dealt.mapInArrow(released(replace(arrays, reach=reach).run), "item int, row long, low long, high long")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item with a score above 0, equal scores by doc_id."""
    kind = items.schema["item_id"].dataType.simpleString()
    asked = items.where("item_id is not null").select("item_id", "text").mapInArrow(_item_terms, f"item_id {kind}, term binary, times long")
    asked = staged(asked.groupBy("item_id", "term").agg(F.sum("times").alias("times")), "item_terms")
    terms = _numbered(asked.select("term").distinct(), "tid")
    numbers = _numbered(asked.select("item_id").distinct(), "item")
    names, postings, weights = index(docs, terms)

    place = F.row_number().over(Window.partitionBy("tid").orderBy(F.desc("part")))
    heads = staged(postings.mapInArrow(_first(k), postings.schema).withColumn("place", place).where(F.col("place") <= k), "heads")
    tops = heads.where("place = 1").select("tid", F.col("part").alias("top"))
    lists = asked.join(terms, "term").join(weights, "tid").join(numbers, "item_id").join(tops, "tid")
    lists = lists.select(F.col("item").cast("int").alias("item"), F.col("tid").cast("int").alias("tid"), (F.col("times") * F.col("weight")).alias("weight"), "top")
    bare = staged(lists.withColumn("lists", F.count(F.lit(1)).over(Window.partitionBy("item"))), "lists")  # an item's distinct terms
    number, gain = bare.count(), F.col("weight") * F.col("part")
    first = _kth(heads.join(_small(bare, number), "tid").groupBy("item", "row").agg(F.sum(gain).alias("low")), k)
    lists = staged(bare.join(first, "item", "left").withColumn("bound", F.coalesce("bound", F.lit(0))), "bounds")

    seen = staged(_reported(postings, lists, number, k), "seen")
    better = _kth(seen, k)
    candidates = staged(seen.join(better, "item", "left").where(F.col("high") >= F.coalesce("bound", F.lit(0))).select("item", "row"), "candidates")

    some = candidates.select("row").distinct()
    near = postings.join(_small(some, candidates.count()), "row", "left_semi")
    wanted = candidates.join(_small(lists.select("item", "tid", "weight"), number), "item")
    scores = wanted.join(near, ["row", "tid"]).groupBy("item", "row").agg(F.sum(gain).alias("score"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
    best = scores.join(names, "row").withColumn("rank", rank).where(F.col("rank") <= k)
    best = staged(best.join(numbers, "item").select("item_id", "rank", "doc_id", "score"), "found")
    discard(asked, terms, numbers, names, postings, weights, heads, bare, lists, seen, candidates)
    return best
