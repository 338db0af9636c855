"""Substring dedup on a compacted De Bruijn graph of word windows.

An edge is a window of ``window`` consecutive words of one document. Edges travel through Spark in pieces: consecutive
edges that share their smallest anchor (a hashed k-mer of words), named by (anchor, content), two independent 64-bit
hashes.

1. Anchors are counted, and only pieces whose anchor repeats go on.
2. Equal pieces meet their first source coordinates (doc_id, start) in a join. An anchor with several different pieces
   is a junction: there the pieces' single edges are hashed from the text at their source coordinates and compared.
3. Compaction: what follows and precedes each piece, over all its occurrences, gives its degrees out and in. Pieces
   between which the path does not branch are linked, and links are followed by joins that double their reach, until
   every piece knows the head of its path (``paths``). The occurrences of a path's pieces make one span.
4. Every span is verified: the words at its source coordinates are read again, and their SHA-256 must be that of the
   span's own words. Then all words under a verified span are removed (``remove_repeats``).

Defined results: null text counts as no words; documents shorter than a window keep all; of equal windows the one with
the smallest (doc_id, start) stays. doc_id is meant to be unique: rows that share one are versions of one document whose
equal positions are the same window, so they are not repeats of each other; a span is verified against, and removed
from, the versions that have its words. Rows without doc_id keep all and are nobody's source. Extra columns are ignored.
Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp as tn
from .common import bucketed, discard, released, staged

#: Words in an anchor; window - anchor + 1 must be a power of two.
ANCHOR = 5
_CONTENT, _AGAIN = 0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25


class Pieces:
    """Path pieces of the documents in one chunk of text."""

    def __init__(self, data: np.ndarray, off: np.ndarray, window: int, anchor: int):
        self.window = window
        starts, ends, self.first = tn.words(data, off)
        n = len(starts)
        self.size = np.zeros(0, np.int64)
        if n < window:
            self.anchor = self.content = np.zeros(0, np.uint64)
            self.row = self.pos = self.size
            return
        hashes = tn.word_hashes(data, starts, ends)
        row = np.repeat(np.arange(len(off) - 1), np.diff(self.first))
        at = np.arange(n - anchor + 1)
        kmers = tn.mix(tn.ranges_hash(tn.prefix(hashes), at, at + anchor))
        best = tn.sliding_argmin(kmers, window - anchor + 1)
        valid = row[: n - window + 1] == row[window - 1 :]
        opens = valid.copy()
        opens[1:] &= ~(valid[:-1] & (best[1:] == best[:-1]))
        start = np.flatnonzero(opens)
        stops = np.flatnonzero(np.append(opens | ~valid, True))
        end = stops[np.searchsorted(stops, start, "right")]
        self.hashes = hashes
        self._sums = tn.prefix(tn.mix(hashes + np.uint64(0x51ED27)), _CONTENT)
        self.content = tn.ranges_hash(self._sums, start, end + window - 1, _CONTENT)
        self.anchor, self.row, self.pos, self.size = kmers[best[start]], row[start], start - self.first[row[start]], end - start

    def edges(self, rows: np.ndarray, pos: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the asked piece, two edge hashes) of each edge of the pieces at (rows, pos) of that many edges."""
        which = np.repeat(np.arange(len(size)), size)
        shift = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
        start = (self.first[rows] + pos)[which] + shift
        other = tn.prefix(tn.mix(self.hashes ^ np.uint64(0x2545F4914F6CDD1D)), _AGAIN)
        return which, tn.ranges_hash(self._sums, start, start + self.window, _CONTENT), tn.ranges_hash(other, start, start + self.window, _AGAIN)


def _pieces(window: int, anchor: int, full: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for lo, hi, data, off in tn.chunks(batch.column(1)):
                p = Pieces(data, off, window, anchor)
                if not len(p.size):
                    continue
                out = {"anchor": p.anchor.view(np.int64)}
                if full:
                    out |= {"content": p.content.view(np.int64), "key": keys.slice(lo, hi - lo).take(pa.array(p.row)), "pos": p.pos.astype(np.int32), "size": p.size.astype(np.int32)}
                yield pa.RecordBatch.from_pydict(out)

    return run


def _asked(part: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """(row, fields) of the structs in a list column."""
    counts = np.diff(part.offsets.to_numpy())
    flat = part.flatten()
    return np.repeat(np.arange(len(part)), counts), [flat.field(i) for i in range(flat.type.num_fields)]


def _edges(window: int, anchor: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, text, pieces) -> the single edges of the listed pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for lo, hi, data, off in tn.chunks(batch.column(1)):
                rows, (pos, size) = _asked(batch.column(2).slice(lo, hi - lo))
                pos, size = pos.to_numpy().astype(np.int64), size.to_numpy().astype(np.int64)
                if not len(rows):
                    continue
                p = Pieces(data, off, window, anchor)
                fits = p.first[rows] + pos + size + window - 1 <= p.first[rows + 1]
                rows, pos, size = rows[fits], pos[fits], size[fits]
                if not len(rows):
                    continue
                which, edge, other = p.edges(rows, pos, size)
                shift = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
                yield pa.RecordBatch.from_pydict({"edge": edge.view(np.int64), "other": other.view(np.int64), "key": keys.slice(lo, hi - lo).take(pa.array(rows[which])), "pos": (pos[which] + shift).astype(np.int32)})

    return run


def _digest(words: list[bytes], start: int, n: int) -> bytes:
    return hashlib.sha256(b" ".join(words[start : start + n])).digest()


def _sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text, spans (start, words)) -> the SHA-256 of the words of each span."""
    for batch in batches:
        for lo, hi, data, off in tn.chunks(batch.column(1)):
            raw, offs = data.tobytes(), off.tolist()
            rows, (start, words) = _asked(batch.column(2).slice(lo, hi - lo))
            digests, at, mine = [], -1, []
            for row, s, n in zip(rows.tolist(), start.to_pylist(), words.to_pylist(), strict=True):
                if row != at:
                    at, mine = row, raw[offs[row] : offs[row + 1]].split()
                digests.append(_digest(mine, s, n))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(rows)), start, words, pa.array(digests, pa.binary())], ["src_key", "src_start", "words", "digest"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans (start, words, digest)) -> (doc_id, n_words, n_removed, kept text)."""
    for batch in batches:
        ids, spans = batch.column(0), batch.column(2)
        for lo, hi, data, off in tn.chunks(batch.column(1)):
            raw, offs = data.tobytes(), off.tolist()
            total, removed, kept = [], [], []
            for i, cuts in enumerate(spans.slice(lo, hi - lo).to_pylist()):
                words = raw[offs[i] : offs[i + 1]].split()
                gone = np.zeros(len(words), bool)
                for cut in cuts or ():
                    if cut["digest"] == _digest(words, cut["start"], cut["words"]):
                        gone[cut["start"] : cut["start"] + cut["words"]] = True
                n = int(gone.sum())
                total.append(len(words))
                removed.append(n)
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if n else words))
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])


def _flat(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("text"))


def repeated_runs(texts: DataFrame, window: int = 20, anchor: int = ANCHOR) -> DataFrame:
    """(key, pos, size, src_key, src_pos): runs of ``size`` edges from word ``pos`` on that also start earlier, at the source; staged."""
    if (window - anchor + 1) & (window - anchor):
        raise ValueError("window - anchor + 1 must be a power of two")
    kind = texts.schema["key"].dataType.simpleString()
    # aggregates are written before they are joined, so that a hot key's partition can be split in the join
    counted = staged(texts.mapInArrow(released(_pieces(window, anchor, False)), "anchor long").groupBy("anchor").count().where("count > 1").select("anchor"), "anchors")
    every = texts.mapInArrow(released(_pieces(window, anchor, True)), f"anchor long, content long, key {kind}, pos int, size int")
    pieces = staged(every.join(counted, "anchor", "left_semi"), "pieces")

    named = staged(pieces.groupBy("anchor", "content").agg(F.min(F.struct("key", "pos", "size")).alias("src"), F.count(F.lit(1)).alias("n")), "named")
    again = pieces.join(named.where("n > 1").select("anchor", "content", "src"), ["anchor", "content"]).where((F.col("key") != F.col("src.key")) | (F.col("pos") != F.col("src.pos")))
    again = again.select("key", "pos", "size", F.col("src.key").alias("src_key"), F.col("src.pos").alias("src_pos"))

    junctions = named.groupBy("anchor").count().where("count > 1").select("anchor")
    asked = named.join(junctions, "anchor", "left_semi").select("src.*").groupBy("key").agg(F.collect_list(F.struct("pos", "size")).alias("pieces"))
    edges = staged(texts.join(asked, "key").select("key", "text", "pieces").mapInArrow(released(_edges(window, anchor)), f"edge long, other long, key {kind}, pos int"), "edges")
    firsts = staged(edges.groupBy("edge", "other").agg(F.min(F.struct("key", "pos")).alias("src"), F.count(F.lit(1)).alias("n")).where("n > 1"), "firsts")
    single = edges.join(firsts.select("edge", "other", "src"), ["edge", "other"]).where((F.col("key") != F.col("src.key")) | (F.col("pos") != F.col("src.pos")))
    single = single.select("key", "pos", F.lit(1).alias("size"), F.col("src.key").alias("src_key"), F.col("src.pos").alias("src_pos"))
    runs = staged(again.unionByName(single), "runs")
    discard(counted, pieces, named, edges, firsts)
    return runs


_PIECE = ["src_key", "src_pos", "size"]


def paths(runs: DataFrame) -> DataFrame:
    """(src_key, src_pos, size, head): every repeated piece, by its source coordinates, and where the path begins that runs through it without branching; staged.

    A piece is linked to the one behind it if that is the only one that follows it, in all its occurrences, if it is
    itself the only one before that, and if they touch at the source, so that links never form a ring.
    """
    ahead = runs.select("key", F.col("pos").alias("next"), *(F.col(c).alias(f"n_{c}") for c in _PIECE))
    behind = runs.withColumn("next", F.col("pos") + F.col("size")).join(ahead, ["key", "next"], "left").select(*_PIECE, "n_src_key", "n_src_pos", "n_size")
    target = F.struct("n_src_key", "n_src_pos", "n_size")
    after = F.when(F.col("n_src_key").isNotNull(), target)
    out = behind.groupBy(*_PIECE).agg(F.min(after).alias("lo"), F.max(after).alias("hi"), F.count(after).alias("n"), F.count(F.lit(1)).alias("all"))
    out = staged(out, "degrees_out")
    only = out.where((F.col("lo") == F.col("hi")) & (F.col("n") == F.col("all")))
    # a piece's occurrences are those counted on its way out; all of them must come from the one piece before it
    link = only.select(*(F.col(c).alias(f"p_{c}") for c in _PIECE), F.col("lo.n_src_key").alias("src_key"), F.col("lo.n_src_pos").alias("src_pos"), F.col("lo.n_size").alias("size"), F.col("n").alias("came"))
    link = link.where((F.col("p_src_key") == F.col("src_key")) & (F.col("p_src_pos") + F.col("p_size") == F.col("src_pos")))
    joined = out.select(*_PIECE, "all").join(link, _PIECE, "left").groupBy(*_PIECE, "all").agg(F.max(F.when(F.col("came") == F.col("all"), F.struct(F.col("p_src_pos").alias("pos"), F.col("p_size").alias("size")))).alias("before"))
    # to: the piece that this one is known to be reached from; done where that is the head
    here = F.struct(F.col("src_pos").alias("pos"), F.col("size"))
    state = staged(joined.select(*_PIECE, F.coalesce("before", here).alias("to"), F.col("before").isNull().alias("done")), "path")
    while not state.where("not done").isEmpty():
        step = state.select("src_key", F.col("src_pos").alias("pos"), F.col("size").alias("long"), F.col("to").alias("on"), F.col("done").alias("ended"))
        met = state.alias("s").join(step.alias("t"), F.expr("s.src_key = t.src_key and s.to.pos = t.pos and s.to.size = t.long"))
        before, state = state, staged(met.select("s.src_key", "s.src_pos", "s.size", F.col("t.on").alias("to"), F.col("t.ended").alias("done")), "path")
        discard(before)
    discard(out)
    return state.select(*_PIECE, F.col("to").alias("head"))


def spans(runs: DataFrame, window: int) -> DataFrame:
    """(key, start, words, src_key, src_start) of the occurrences of compacted paths; staged."""
    compact = paths(runs)
    whole = runs.join(compact, _PIECE).groupBy("key", "src_key", (F.col("pos") - F.col("src_pos")).alias("diagonal"), "head")
    found = whole.agg(F.min("pos").alias("start"), (F.max(F.col("pos") + F.col("size")) - F.min("pos") + (window - 1)).alias("words"), F.min("src_pos").alias("src_start"))
    out = staged(found.select("key", "start", "words", "src_key", "src_start"), "spans")
    discard(compact)
    return out


def repeated_spans(docs: DataFrame, window: int = 20, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, start, end, src_doc_id, src_start) in words of the repeated spans, before verification."""
    found = spans(repeated_runs(_flat(docs).where("key is not null"), window, anchor), window)
    return found.select(F.col("key").alias("doc_id"), "start", (F.col("start") + F.col("words")).alias("end"), F.col("src_key").alias("src_doc_id"), "src_start")


def remove_repeats(docs: DataFrame, window: int = 20, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept is the UTF-8 of the words that stay, joined by one space."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    # dealt by doc_id once, for the junctions, the sources and the removal
    texts = bucketed(_flat(docs).where("key is not null").repartition("key"), "key", "texts")
    runs = repeated_runs(texts, window, anchor)
    found = spans(runs, window)
    discard(runs)
    source = found.select("src_key", "src_start", "words").distinct().groupBy(F.col("src_key").alias("key")).agg(F.collect_list(F.struct(F.col("src_start").alias("start"), "words")).alias("spans"))
    proven = staged(texts.join(source, "key").select("key", "text", "spans").mapInArrow(released(_sources), f"src_key {kind}, src_start int, words int, digest binary").distinct(), "digests")
    cuts = found.join(proven, ["src_key", "src_start", "words"]).groupBy("key").agg(F.collect_list(F.struct("start", "words", "digest")).alias("spans"))
    schema = f"doc_id {kind}, n_words long, n_removed long, kept binary"
    nobody = _flat(docs).where("key is null").withColumn("spans", F.lit(None).cast("array<struct<start:int,words:int,digest:binary>>"))
    return texts.join(cuts, "key", "left").select("key", "text", "spans").unionByName(nobody).mapInArrow(released(_kept), schema)
