"""Suffix-array dedup on run-length indexes: bytes that a long enough string covers which also starts elsewhere are removed.

A corpus has no one suffix array here; its windows (``window`` consecutive bytes of one text) are dealt so that equal ones
meet, and each small share of them gets an index of its own.

1. Every window is named by its anchor: of all its substrings of ANCHOR bytes the one with the smallest hash. Neighbouring
   windows with the same anchor are one segment. Anchors that occur once are dropped; equal segments become one entry with
   a number, so that a thousand copies weigh as much as two.
2. Entries whose anchor has others too travel, with their bytes, to their anchor's block. There they get a suffix array,
   and of its Burrows-Wheeler transform the runs are kept, with samples at the runs' two ends: the text position there and
   how long it agrees with the neighbour across the end. A repetitive block has few runs.
3. Matching statistics stream along the text: between samples, the length that a position has in common with its nearest
   neighbour falls by one a byte, so each position has it from the last sample before it. Windows with at least
   ``window`` are repeated, as are all of an entry that occurs more than once.
4. The marks go back to all segments that have the entry, and what their windows cover is cut out of the texts.

An anchor with more than CROWD entries is split: its entries are texts of a second pass of the same kind, in which
strings that more than CROWD of them have are anchors only of windows without any other, so that what differs deals them
out. Nothing is left out at any size; only the order of the work changes.

Defined results: null text counts as empty, texts shorter than a window keep all. Rows are documents of their own, with or
without doc_id, and however often they are repeated. Very long texts are cut into overlapping pieces for the hashing, which
changes no window. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, discard, released, staged
from .textnp import buffers

ANCHOR = 64
#: Entries of an anchor from which it is split, and strings at most that are held back in its second pass.
CROWD, HELD = 4096, 1 << 20
#: Bytes hashed at once; a text that is longer is cut.
CHUNK, CUT = 1 << 17, 1 << 20
#: Bytes of a block; three ranks below 2**21 fit into one number.
BLOCK = 1 << 20
_PLACE = np.uint64((1 << 22) - 1)
_STEPS = ((8, 0x9E3779B97F4A7C15), (16, 0xC2B2AE3D27D4EB4F), (32, 0x165667B19E3779F9))

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def anchor_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ANCHOR bytes from each position on, by doubling from eight."""
    if len(data) < ANCHOR:
        return np.zeros(0, np.uint64)
    h = _mix(np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), 0, (1,)))
    for step, factor in _STEPS:
        left = h[:-step] * np.uint64(factor)
        left += h[step:]
        left ^= left >> np.uint64(29)
        h = left
    return _mix(h)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of values[i:i+width] for each i."""
    step = 1
    while step * 2 <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    return np.minimum(values[: len(values) - (width - step)], values[width - step :]) if width > step else values


class Segments:
    """Segments of the texts in one chunk: first window, number of windows, anchor, and a hash of the content."""

    def __init__(self, data: np.ndarray, off: np.ndarray, window: int, avoid: np.ndarray | None):
        hashes = anchor_hashes(data)
        self.start = self.size = np.zeros(0, np.int64)
        windows = len(data) - window + 1
        if windows < 1:
            return
        order = hashes >> np.uint64(1)
        if avoid is not None and len(avoid):
            at = np.minimum(np.searchsorted(avoid, hashes), len(avoid) - 1)
            order |= np.where(avoid[at] == hashes, np.uint64(1 << 63), np.uint64(0))
        order = (order & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
        best = (_least(order, window - ANCHOR + 1) & _PLACE).astype(np.int64)
        first, last = off[:-1], np.maximum(off[1:] - window + 1, off[:-1])
        step = np.zeros(len(data) + 1, np.int8 if len(off) < 100 else np.int32)
        np.add.at(step, first, 1)
        np.add.at(step, last, -1)
        valid = np.cumsum(step[:windows], dtype=np.int32) > 0
        opens = valid.copy()
        opens[1:] &= ~(valid[:-1] & (best[1:] == best[:-1]))
        start = np.flatnonzero(opens)
        stops = np.flatnonzero(np.append(opens | ~valid, True))
        end = stops[np.searchsorted(stops, start, "right")]
        length = end - start + window - 1
        content = _mix(hashes[start] + length.astype(np.uint64))
        for j in range(1, (2 * window) // ANCHOR + 1):
            content = _mix(content * np.uint64(_STEPS[0][1]) + hashes[np.minimum(start + ANCHOR * j, end + window - 1 - ANCHOR)])
        self.start, self.size, self.anchor, self.content = start, end - start, hashes[best[start]], content


def _chunks(col: pa.Array, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, their first bytes in the text, bytes, offsets): some short texts together, or one piece of a long one."""
    data, off = buffers(col)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = min(max(int(np.searchsorted(off, off[lo] + CHUNK, "right")) - 1, lo + 1), n)
        if off[hi] - off[lo] <= CUT:
            yield np.arange(lo, hi), np.zeros(hi - lo, np.int64), data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        else:
            for at in range(int(off[lo]), int(off[hi]), CUT):
                part = data[at : min(at + CUT + window - 1, off[hi])]
                yield np.array([lo]), np.array([at - off[lo]]), part, np.array([0, len(part)])
        lo = hi


def _segments(window: int, avoid: np.ndarray | None, full: bool) -> Run:
    """(row, text) -> the anchors of all segments, or the segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for rows, base, data, off in _chunks(batch.column(1), window):
                s = Segments(data, off, window, avoid)
                if not len(s.size):
                    continue
                out = {"anchor": s.anchor.view(np.int64)}
                if full:
                    row = np.searchsorted(off, s.start, "right") - 1
                    out |= {"content": s.content.view(np.int64), "row": keys[rows[row]], "pos": s.start - off[row] + base[row], "size": s.size.astype(np.int32)}
                yield pa.RecordBatch.from_pydict(out)

    return run


def _entries(window: int) -> Run:
    """(text, asked (anchor, content, n, pos, size)) -> the entries with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, asked in zip(batch.column(0), batch.column(1), strict=True):
                raw, flat = text.as_buffer(), asked.values
                pos, size = flat.field("pos").to_numpy(), flat.field("size").to_numpy()
                parts = [raw.slice(p, s + window - 1).to_pybytes() for p, s in zip(pos.tolist(), size.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({**{c: flat.field(c) for c in ("anchor", "content", "n", "size")}, "bytes": pa.array(parts, pa.binary())})

    return run


class RunIndex:
    """The runs of the transform of some strings, with their ends sampled.

    Suffixes end with their string; equal ones stand in the order of the strings.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray):
        n = len(data)
        self.off, self.n = off, n
        rest = np.repeat(off[1:], np.diff(off)) - np.arange(n)
        # seven symbols to begin with, then several ranks to one
        bits, parts = (21, 3) if n < 1 << 21 else (31, 2)
        pad = np.concatenate([data.astype(np.int64) + 1, np.zeros(7, np.int64)])
        key = np.zeros(n, np.int64)
        for i in range(7):
            key <<= 9
            key |= np.where(rest > i, pad[i : n + i], 0)
        self.ranks: list[tuple[int, np.ndarray]] = []
        length, longest = 7, int(np.diff(off).max(initial=0))
        while True:
            at = np.argsort(key)
            new = np.ones(n, np.int64)
            new[1:] = key[at[1:]] != key[at[:-1]]
            rank = np.empty(n, np.int64)
            rank[at] = np.cumsum(new)
            self.ranks.append((length, rank))
            last = length * (parts - 1) >= longest
            key = rank << bits * (parts - 1)
            for k in range(1, parts):
                if last and k == parts - 1:
                    key |= np.arange(n)
                    break
                ahead = np.zeros(n, np.int64)
                ahead[: max(n - k * length, 0)] = rank[k * length :]
                ahead[rest <= k * length] = 0
                key |= ahead << bits * (parts - 1 - k)
            if last:
                break
            length *= parts
        sa = np.argsort(key)
        before = data[sa - 1].astype(np.int16) if n else np.zeros(0, np.int16)
        first = np.zeros(n, bool)
        first[off[:-1][np.diff(off) > 0]] = True
        before[first[sa]] = -1
        ends = (before[1:] != before[:-1]) | (before[1:] < 0)
        self.runs = int(ends.sum()) + (n > 0)
        # both sides of every place where a run ends and the next begins
        self.tail, self.head = sa[:-1][ends], sa[1:][ends]
        self.common = self._agreement(data, rest)

    def _agreement(self, data: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes on both sides have in common, from the ranks by their first symbols."""
        a, b, left = self.tail.copy(), self.head.copy(), np.minimum(rest[self.tail], rest[self.head])
        out = np.zeros(len(a), np.int64)
        for length, rank in [*reversed(self.ranks), (1, data)]:
            at = np.arange(len(a))
            while True:
                at = at[left[at] >= length]
                at = at[rank[a[at]] == rank[b[at]]]
                if not len(at):
                    break
                for x in (a, b, out):
                    x[at] += length
                left[at] -= length
                at = at[left[at] > 0]
        return out

    def statistics(self) -> np.ndarray:
        """For each position, the longest string from there that also starts at another."""
        best = np.zeros(self.n, np.int64)
        for at in (self.head, self.tail):
            known = np.full(self.n, -1, np.int64)
            known[self.off[:-1][np.diff(self.off) > 0]] = 0
            known[at] = self.common
            where = np.maximum.accumulate(np.where(known >= 0, np.arange(self.n), 0))
            np.maximum(best, known[where] - (np.arange(self.n) - where), out=best)
        return best


def _index(window: int) -> Run:
    """(anchor, content, n, size, bytes) in the order of anchor -> (anchor, content, start, end): ranges of windows that also start elsewhere."""

    def block(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        data, off = buffers(table["bytes"].chunk(0))
        data, off = data[off[0] : off[-1]], off - off[0]
        n, size = table["n"].to_numpy(), table["size"].to_numpy()
        met = RunIndex(data, off).statistics() >= window
        # positions behind an entry's last window have too little left to reach a window's length
        step = np.diff(met.astype(np.int8), prepend=0, append=0)
        start, end = np.flatnonzero(step > 0), np.flatnonzero(step < 0)
        row = np.searchsorted(off, start, "right") - 1
        once = n[row] == 1
        row, start, end = row[once], (start - off[row])[once], (end - off[row])[once]
        more = np.flatnonzero(n > 1)
        row, start, end = np.concatenate([row, more]), np.concatenate([start, np.zeros(len(more), np.int64)]), np.concatenate([end, size[more]])
        return pa.RecordBatch.from_pydict({"anchor": table["anchor"].chunk(0).take(pa.array(row)), "content": table["content"].chunk(0).take(pa.array(row)), "start": start.astype(np.int32), "end": end.astype(np.int32)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            anchors = batch.column(0).to_numpy()
            at = 0
            # an anchor's entries stay together, also across batches
            for cut in [*(np.flatnonzero(anchors[1:] != anchors[:-1]) + 1).tolist(), len(anchors)]:
                begins = not held or held[-1].column(0)[-1].as_py() != anchors[at]
                if begins and size >= BLOCK:
                    yield block(held)
                    held, size = [], 0
                part = batch.slice(at, cut - at)
                held.append(part)
                size += int(part.column(3).to_numpy().sum()) + (window - 1) * part.num_rows
                at = cut
        if held:
            yield block(held)

    return run


def _strings(window: int) -> Run:
    """(row, text) -> the hashes of the strings as long as an anchor, with the number of texts that have each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, off in _chunks(batch.column(1), window):
                hashes = anchor_hashes(data)
                at = np.arange(len(hashes))
                row = np.searchsorted(off, at, "right") - 1
                inside = at + ANCHOR <= off[row + 1]
                each = np.unique(np.stack([row[inside], hashes[inside].view(np.int64)]), axis=1)[1]
                found, times = np.unique(each, return_counts=True)
                yield pa.RecordBatch.from_pydict({"hash": found, "n": times})

    return run


def _common(texts: DataFrame, window: int, crowd: int) -> np.ndarray:
    """Hashes of the strings that more than crowd of the texts have, or, where those are too many, more than some multiple of that."""
    counts = staged(texts.select("row", "text").mapInArrow(released(_strings(window)), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") > crowd), "strings")
    while counts.where(F.col("n") > crowd).count() > HELD:
        crowd *= 2
    found = np.array([r.hash for r in counts.where(F.col("n") > crowd).select("hash").collect()], np.int64).view(np.uint64)
    discard(counts)
    return np.sort(found)


def repeated(texts: DataFrame, window: int = 200, crowd: int = CROWD, avoid: np.ndarray | None = None, split: bool = True) -> DataFrame:
    """(row, start, end): ranges of windows of the texts (row, text), by their first bytes, that also start elsewhere; staged."""
    if window < 2 * ANCHOR:
        raise ValueError(f"a window has at least {2 * ANCHOR} bytes")
    pair = ["anchor", "content"]
    texts = texts.select("row", "text")
    # aggregates are written before they are joined, so that a hot key's partition can be split in the join
    counted = staged(texts.mapInArrow(released(_segments(window, avoid, False)), "anchor long").groupBy("anchor").count().where("count > 1").select("anchor"), "anchors")
    every = texts.mapInArrow(released(_segments(window, avoid, True)), "anchor long, content long, row long, pos long, size int")
    pieces = staged(every.join(counted, "anchor", "left_semi"), "segments", "zstd")
    named = staged(pieces.groupBy(*pair).agg(F.min(F.struct("row", "pos", "size")).alias("src"), F.count(F.lit(1)).alias("n")), "named", "zstd")
    others = staged(named.groupBy("anchor").count().withColumnRenamed("count", "entries"), "others")

    alone = named.join(others.where("entries = 1"), "anchor", "left_semi").select(*pair, F.lit(0).alias("start"), F.col("src.size").alias("end"))
    asked = named.join(others.where("entries > 1"), "anchor", "left_semi").groupBy(F.col("src.row").alias("row")).agg(F.collect_list(F.struct(*pair, "n", F.col("src.pos").alias("pos"), F.col("src.size").alias("size"))).alias("asked"))
    entries = staged(texts.join(asked, "row").select("text", "asked").mapInArrow(released(_entries(window)), "anchor long, content long, n long, size int, bytes binary"), "entries", "zstd")
    few = entries
    marks = [alone]
    hot = others.where(F.col("entries") > crowd).select("anchor")
    if split and not hot.isEmpty():
        few = entries.join(hot, "anchor", "left_anti")
        many = staged(entries.join(hot, "anchor", "left_semi").withColumn("row", F.monotonically_increasing_id()).withColumnRenamed("bytes", "text"), "crowds")
        deep = repeated(many, window, crowd, _common(many, window, crowd), False)
        marks.append(many.where("n = 1").select(*pair, "row").join(deep, "row").select(*pair, F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")))
        marks.append(many.where("n > 1").select(*pair, F.lit(0).alias("start"), F.col("size").alias("end")))
    dealt = few.repartition("anchor").sortWithinPartitions("anchor")
    marks.append(dealt.mapInArrow(released(_index(window)), "anchor long, content long, start int, end int"))
    marked = marks[0]
    for m in marks[1:]:
        marked = marked.unionByName(m)
    marked = staged(marked, "marks", "zstd")
    out = staged(pieces.join(marked, pair).select("row", (F.col("pos") + F.col("start")).alias("start"), (F.col("pos") + F.col("end")).alias("end")), "repeats", "zstd")
    discard(counted, pieces, named, others, entries, marked)
    return out


def _cut(window: int) -> Run:
    """(doc_id, text, ranges) -> what is left once the bytes of the windows in the ranges are gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, removed, spans, kept = [], [], [], []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                raw = text.as_buffer()
                cuts, parts, gone, at = [], [], 0, 0
                if found.is_valid:
                    flat = found.values
                    start, end = flat.field("start").to_numpy(), flat.field("end").to_numpy() + (window - 1)
                    order = np.argsort(start)
                    start, end = start[order], np.maximum.accumulate(end[order])
                    opens = np.append(True, start[1:] > end[:-1])
                    cuts = list(zip(start[opens].tolist(), end[np.append(np.flatnonzero(opens[1:]), len(end) - 1)].tolist(), strict=True))
                for lo, hi in cuts:
                    parts.append(raw.slice(at, lo - at).to_pybytes())
                    gone, at = gone + hi - lo, hi
                parts.append(raw.slice(at).to_pybytes())
                size.append(raw.size)
                removed.append(gone)
                spans.append(len(cuts))
                kept.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, window: int = 200, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): the bytes that are in no window that also starts elsewhere, and how many runs of bytes went."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    # numbers by partition and place in it: a task that runs again gives the same ones
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    texts = bucketed(rows.repartition("row"), "row", "texts")
    found = repeated(texts, window, crowd)
    cuts = found.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    left = texts.join(cuts, "row", "left").select("doc_id", "text", "ranges")
    return left.mapInArrow(released(_cut(window)), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
