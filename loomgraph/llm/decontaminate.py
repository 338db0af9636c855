"""Benchmark decontamination by the q-gram lemma.

A passage within k edits of an item of m characters shares at least m + 1 - q (k + 1) of its q-grams, and their diagonals
(position in the text less position in the item) lie within k of each other. Shared q-grams are counted for each text
and item in diagonal bands of k + 1 diagonals that overlap by half; bands that reach the bound are aligned, banded, with
the true characters, and a text is a leak of an item where at most k edits turn some passage of it into the item.

Texts and items are lower-cased and runs of white space count as one space. k is ``rate`` of the item's length; q is Q, or
less for short items so that the bound stays positive, down to the whole item where k is 0, which is then an exact
search. q-grams are hashes of code points, so any script is searched alike. Shared q-grams are expanded a bounded number
at a time. Items are broadcast in blocks of at most BLOCK_BYTES, each block in one pass over the texts, so a benchmark of
any size is searched.

Defined results: for each place where a passage can end, the one of fewest edits counts (then the shortest), and of those
of one item in one text that overlap, the one of fewest edits (then the shortest, then the first); null text has no leaks; items that are null or without characters are
left out; several equal items are all reported; rows that share a doc_id are reported each. Extra columns are ignored.
Empty tables give empty results.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp as tn
from .common import released

Q = 8
#: UTF-8 bytes of benchmark items in one broadcast block.
BLOCK_BYTES = 4 << 20
#: Characters searched, shared q-grams expanded, and cells of alignment tables at once.
_CHUNK, _EXPANDED, _CELLS = 1 << 20, 1 << 20, 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C15)


def clean(text: str) -> str:
    return " ".join(text.lower().split())


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(data: np.ndarray, q: int) -> np.ndarray:
    """Hashes of the q code points from each position."""
    out = np.zeros(max(0, len(data) - q + 1), np.uint64)
    for j in range(q):
        out = out * _BASE + data[j : j + len(out)].astype(np.uint64) + np.uint64(1)
    return tn.mix(out)


class Family:
    """The items of one q, by their q-grams."""

    def __init__(self, q: int, items: list[tuple[int, np.ndarray]]):
        self.q = q
        key = np.concatenate([grams(p, q) for _, p in items])
        size = np.array([len(p) - q + 1 for _, p in items])
        order = np.argsort(key, kind="stable")
        self.item = np.repeat([n for n, _ in items], size)[order]
        self.at = (np.arange(len(key)) - np.repeat(np.cumsum(size) - size, size))[order]
        self.key, self.first, self.count = np.unique(key[order], return_index=True, return_counts=True)
        self.some = np.zeros(1 << 20, bool)
        self.some[self.key >> np.uint64(44)] = True

    def shared(self, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(position in the text, item, position in the item) of the shared q-grams, a bounded number at a time."""
        g = grams(data, self.q)
        pos = np.flatnonzero(self.some[g >> np.uint64(44)])
        place = np.minimum(np.searchsorted(self.key, g[pos]), len(self.key) - 1)
        hit = self.key[place] == g[pos]
        pos, place = pos[hit], place[hit]
        total = np.cumsum(self.count[place])
        lo = 0
        while lo < len(pos):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + _EXPANDED, "right")))
            times = self.count[place[lo:hi]]
            entry = np.repeat(self.first[place[lo:hi]], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            yield np.repeat(pos[lo:hi], times), self.item[entry], self.at[entry]
            lo = hi


class Index:
    """q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        items = [(i, t) for i, t in items if t]
        self.ids, self.texts = [i for i, _ in items], [t for _, t in items]
        self.points = [points(t) for t in self.texts]
        self.size = np.array([len(p) for p in self.points], np.int64)
        self.budget = (self.size * rate + 1e-9).astype(np.int64)
        q = np.clip(self.size // (self.budget + 1), 1, Q)
        self.bound = np.maximum(1, self.size + 1 - q * (self.budget + 1))
        of = defaultdict(list)
        for n, p in enumerate(self.points):
            of[int(q[n])].append((n, p))
        self.families = [Family(q, mine) for q, mine in sorted(of.items())]

    def bands(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, first diagonal within the row) of the bands that reach their item's bound. Rows are off[i]:off[i+1] and end in 0."""
        # a diagonal's band number is at least -size and at most the length of the longest row
        low, span = -int(self.size.max(initial=0)) - 2, int(np.diff(off).max(initial=0)) + int(self.size.max(initial=0)) + 4
        codes, counts, held = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            code, back = np.unique(np.concatenate([*codes, np.zeros(0, np.int64)]), return_inverse=True)
            return code, np.bincount(back, np.concatenate([*counts, np.zeros(0, np.int64)]), len(code)).astype(np.int64)

        for family in self.families:
            for pos, item, at in family.shared(data):
                row = np.searchsorted(off, pos, "right") - 1
                band = (pos - off[row] - at) // (self.budget[item] + 1)
                base = (row * len(self.size) + item) * span - low
                code, count = np.unique(np.concatenate([base + band, base + band - 1]), return_counts=True)
                codes.append(code)
                counts.append(count)
                held += len(code)
                if held > 4 * _EXPANDED:
                    code, count = merged()
                    codes, counts, held = [code], [count], 0
        code, count = merged()
        item = code // span % max(1, len(self.size))
        good = count >= self.bound[item] if len(code) else np.zeros(0, bool)
        code, item = code[good], item[good]
        return code // span // max(1, len(self.size)), item, (code % span + low) * (self.budget[item] + 1)


def ends(texts: list[np.ndarray], items: list[np.ndarray], diagonals: np.ndarray, budgets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(alignments, edits, start, end) of the best passage for each end, of texts against whole items among the two bands from the diagonal on, with the budget's margin on both sides; a row an alignment, a column an end.

    All alignments of the call advance together, one item character a step. A cell holds its cost above the column in
    which its path began, counted from the right, so that of equal costs the shortest passage wins.
    """
    n, longest, k = len(texts), max(map(len, items)), int(budgets.max())
    width = 4 * (k + 1) + 1
    lo = diagonals - k - 1
    window = np.full((n, longest + width), 0xFFFFFFFF, np.uint32)
    pattern = np.full((n, longest), 0xFFFFFFFE, np.uint32)
    for i, (t, p) in enumerate(zip(texts, items, strict=True)):
        a, b = max(0, lo[i]), min(len(t), lo[i] + len(p) + width)
        if a < b:
            window[i, a - lo[i] : b - lo[i]] = t[a:b]
        pattern[i, : len(p)] = p
    size, steps, one = np.array([len(p) for p in items]), np.arange(width), np.int64(1) << 32
    inside = (lo[:, None] + steps >= 0) & (lo[:, None] + steps <= np.array([len(t) for t in texts])[:, None])
    # a path begins within its own budget of its bands, however wide the tables of the call are
    spare = (k - budgets)[:, None]
    inside &= (steps >= spare) & (steps <= spare + 4 * (budgets[:, None] + 1))
    cost = np.where(inside, width - steps, one << 20)
    for i in range(longest):
        step = cost + (window[:, i : i + width] != pattern[:, i : i + 1]) * one
        step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + one)
        cost = np.minimum.accumulate(step - steps * one, 1) + steps * one
        done = np.flatnonzero(size == i + 1)
        if len(done):
            cell, from_ = cost[done], lo[done][:, None]
            yield done, cell >> 32, from_ + width - (cell & (one - 1)), np.broadcast_to(from_ + i + 1 + steps, cell.shape)


def align(texts: list[np.ndarray], items: list[np.ndarray], diagonals: np.ndarray, budgets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edits, start, end) of the best passage of each alignment, of equal ones the shortest."""
    found = np.zeros((3, len(texts)), np.int64)
    for done, *cells in ends(texts, items, diagonals, budgets):
        edits, start, end = cells
        at = (edits * (1 << 32) + end - start).argmin(1)
        found[:, done] = np.stack([c[np.arange(len(done)), at] for c in cells])
    return found[0], found[1], found[2]


def apart(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of passages (edits, start, end) that overlap, the one of fewest edits, then the shortest, then the first; by start."""
    kept: list[tuple[int, int, int]] = []
    for edits, start, end in sorted(set(found), key=lambda f: (f[0], f[2] - f[1], f[1])):
        at = bisect_left(kept, (start, end, edits))
        if not (at and kept[at - 1][1] > start) and not (at < len(kept) and kept[at][0] < end):
            kept.insert(at, (start, end, edits))
    return [(edits, start, end) for start, end, edits in kept]


def _leaks(index: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def search(ids: list, texts: list[np.ndarray], ix: Index) -> pa.RecordBatch | None:
        off = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        data = np.zeros(off[-1], np.uint32)
        for t, a in zip(texts, off[:-1].tolist(), strict=True):
            data[a : a + len(t)] = t
        row, item, diagonal = ix.bands(data, off)
        order = np.argsort(ix.size[item], kind="stable")
        row, item, diagonal = row[order], item[order], diagonal[order]
        met, lo = [], 0
        while lo < len(row):
            hi = lo + 1
            while hi < len(row) and (hi + 1 - lo) * (2 * ix.size[item[hi]] + 4 * ix.budget[item[hi]]) <= _CELLS:
                hi += 1
            r, t = row[lo:hi], item[lo:hi]
            for done, edits, start, end in ends([texts[i] for i in r], [ix.points[i] for i in t], diagonal[lo:hi], ix.budget[t]):
                at, column = np.nonzero((edits <= ix.budget[t[done]][:, None]) & (end > start))
                met.append(np.stack([r[done[at]], t[done[at]], end[at, column], edits[at, column], start[at, column]]))
            lo = hi
        whole = np.concatenate(met, 1) if met else np.zeros((5, 0), np.int64)
        # of the passages with one end, in whatever band, the best
        order = np.lexsort((-whole[4], whole[3], whole[2], whole[1], whole[0]))
        whole = whole[:, order]
        best = np.ones(whole.shape[1], bool)
        best[1:] = (whole[:3, 1:] != whole[:3, :-1]).any(0)
        out = defaultdict(list)
        for r, t, end, edits, start in whole[:, best].T.tolist():
            out[r, t].append((edits, start, end))
        if not out:
            return None
        rows = [(ids[r], ix.ids[t], *f) for (r, t), found in sorted(out.items()) for f in apart(found)]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()], strict=True)], ["doc_id", "item_id", "edits", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = Index(*index.value)
        for batch in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                ids.append(i.as_py())
                texts.append(points(clean(t.as_py() or "")))
                size += len(texts[-1])
                if size > _CHUNK:
                    if (found := search(ids, texts, ix)) is not None:
                        yield found
                    ids, texts, size = [], [], 0
            if texts and (found := search(ids, texts, ix)) is not None:
                yield found

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, shortest: int = 1) -> DataFrame:
    """(doc_id, item_id, edits, start, end) of every passage of a text that leaks an item of at least ``shortest`` cleaned characters; positions are those of the cleaned text."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    blocks = max(1, -(-int(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    found = []
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        texts = [(i, t) for i, t in ((r["item_id"], clean(r["text"])) for r in mine.orderBy("item_id", "text").collect()) if len(t) >= shortest]
        index = docs.sparkSession.sparkContext.broadcast((texts, rate))
        found.append(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(_leaks(index)), "doc_id long, item_id long, edits int, start long, end long"))
    return reduce(DataFrame.unionByName, found)


def decontaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, shortest: int = Q) -> DataFrame:
    """The rows of docs that leak no item of at least ``shortest`` cleaned characters; shorter ones are words that any text may have."""
    bad = leaks(docs, benchmark, rate, shortest).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)
