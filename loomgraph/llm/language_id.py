"""Language identification by segmentation-marginalised unigram models.

A fixed public vocabulary of subword pieces (plus every single byte) is given; per language only the piece
probabilities are learned, by expectation maximisation over the words of a bounded sample of labelled texts. A word's
probability is the sum over all its segmentations into pieces, computed by the forward algorithm in logarithms over the
whole word, however long; a text is scored by its words. Words are lower-cased and start with a space, as the pieces do.

Training takes about ``max_docs`` documents a language, chosen by a hash of doc_id and text, of at most ``max_bytes``
bytes each; prediction reads every text whole.

Defined results: text that is null or has no letter is ``und`` with score 0; ties go to the language first in
alphabetical order; rows without lang are never trained on; with no labelled row every text is ``und``; equal rows are
sampled together. Extra columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp as tn
from .common import released

UNKNOWN = "und"
ROUNDS = 3
#: Expected count that every piece has before training.
PRIOR = 0.01
#: Nats a byte by which a learned language must explain a text better than pieces that were never met do, for accepted() to keep it.
GAIN = 0.5
#: Words whose scores a task keeps, numbers in a table of the forward algorithm, bytes looked up at once, and bytes of words whose lattices are kept.
KEPT, CELLS, SLAB, HELD = 200_000, 1 << 25, 1 << 16, 4 << 20
_SPACE_MARK = "▁"


def vocabulary(path: str) -> list[bytes]:
    """Pieces of a sentencepiece model as bytes, and all single bytes, without repeats, in order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usable = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
    return list(dict.fromkeys([bytes([b]) for b in range(256)] + [p.replace(_SPACE_MARK, " ").lower().encode() for p in usable]))


class Words:
    """Words in one buffer, shortest first: number ``order[i]`` of those given is word i here."""

    def __init__(self, words: list[bytes]):
        size = np.array([len(w) for w in words], np.int64)
        self.order = np.argsort(size, kind="stable")
        self.size = size[self.order]
        data = np.frombuffer(b"".join(words[i] for i in self.order.tolist()), np.uint8)
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size
        self.sums = tn.prefix(data.astype(np.uint64) + np.uint64(1))


class Pieces:
    """Piece lookup by 64-bit hash, vectorised. Pieces with a space inside never fit into a word."""

    def __init__(self, pieces: list[bytes]):
        self.longest = max((len(p) for p in pieces if b" " not in p[1:]), default=1)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        hashes = tn.ranges_hash(tn.prefix(data.astype(np.uint64) + np.uint64(1)), ends - [len(p) for p in pieces], ends)
        self.ids = np.argsort(hashes)
        self.hashes = hashes[self.ids]
        self.some = np.zeros(1 << 20, bool)
        self.some[hashes >> np.uint64(44)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which hashes are pieces, their ids)."""
        at = np.flatnonzero(self.some[hashes >> np.uint64(44)])
        place = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        hit = self.hashes[place] == hashes[at]
        return at[hit], self.ids[place[hit]]

    def edges(self, words: Words, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(end, word, length, piece) of the lattice edges that end after byte lo up to byte hi of their word, by end and word."""
        live = int(np.searchsorted(words.size, lo, "right"))
        n = np.minimum(words.size[live:], hi) - lo
        word = np.repeat(np.arange(live, len(words.size)), n)
        end = lo + 1 + np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
        stop, found = words.start[word] + end, []
        for length in range(1, min(self.longest, hi) + 1):
            fits = np.flatnonzero(end >= length) if length > lo + 1 else np.arange(len(end))
            at, ids = self.find(tn.ranges_hash(words.sums, stop[fits] - length, stop[fits]))
            at = fits[at]
            found.append((end[at], word[at], np.full(len(at), length), ids))
        end, word, length, piece = (np.concatenate(x).astype(np.int32) for x in zip(*found, strict=True))
        order = np.lexsort((word, end))
        return end[order], word[order], length[order], piece[order]


def _runs(step: np.ndarray, word: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(where runs of one step and word begin, with the end; the range of runs of each step from first to last)."""
    new = np.ones(len(step), bool)
    new[1:] = (step[1:] != step[:-1]) | (word[1:] != word[:-1])
    at = np.flatnonzero(new)
    return np.append(at, len(step)), np.searchsorted(step[at], np.arange(first, last + 2))


def forward(table: Pieces, words: Words, logs: np.ndarray) -> np.ndarray:
    """(words, languages): logarithm of the summed probability of all segmentations of each word, in the order given."""
    ring, n = table.longest + 1, len(words.size)
    alpha, out = np.full((ring, n, logs.shape[1]), -np.inf), np.zeros((n, logs.shape[1]))
    alpha[0] = 0
    longest = int(words.size[-1]) if n else 0
    width = max(table.longest, SLAB // max(1, n))
    for lo in range(0, longest, width):
        hi = min(lo + width, longest)
        end, word, length, piece = table.edges(words, lo, hi)
        at, steps = _runs(end, word, lo + 1, hi)
        for e in range(lo + 1, hi + 1):
            a, b = steps[e - lo - 1], steps[e - lo]
            now = alpha[e % ring]
            now[:] = -np.inf
            if a < b:
                s = slice(at[a], at[b])
                now[word[at[a:b]]] = np.logaddexp.reduceat(alpha[(e - length[s]) % ring, word[s]] + logs[piece[s]], at[a:b] - at[a], axis=0)
            done = slice(*np.searchsorted(words.size, (e, e + 1)))
            out[done] = now[done]
    back = np.empty_like(out)
    back[words.order] = out
    return back


def blocks(raw: list[bytes], cells: int) -> Iterator[list[int]]:
    """Numbers of the words in blocks of like length whose lattice tables stay within some cells (a longer word is one block)."""
    order, lo = sorted(range(len(raw)), key=lambda i: len(raw[i])), 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * (len(raw[order[hi]]) + 1) <= cells:
            hi += 1
        yield order[lo:hi]
        lo = hi


def expected(end: np.ndarray, word: np.ndarray, length: np.ndarray, piece: np.ndarray, size: np.ndarray, logs: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected counts of the pieces over all segmentations of the words, by the forward-backward algorithm."""
    longest, n = int(size.max()), len(size)
    alpha, beta = np.full((longest + 1, n), -np.inf), np.full((longest + 1, n), -np.inf)
    alpha[0] = 0
    beta[size, np.arange(n)] = 0
    gain = logs[piece]
    at, steps = _runs(end, word, 1, longest)
    for e in range(1, longest + 1):
        a, b = steps[e - 1], steps[e]
        if a < b:
            s = slice(at[a], at[b])
            alpha[e, word[at[a:b]]] = np.logaddexp.reduceat(alpha[e - length[s], word[s]] + gain[s], at[a:b] - at[a])
    start = end - length
    order = np.lexsort((word, start))
    w, stop, g = word[order], end[order], gain[order]
    at, steps = _runs(start[order], w, 0, longest)
    for x in range(longest - 1, -1, -1):
        a, b = steps[x], steps[x + 1]
        if a < b:
            s = slice(at[a], at[b])
            beta[x, w[at[a:b]]] = np.logaddexp(beta[x, w[at[a:b]]], np.logaddexp.reduceat(g[s] + beta[stop[s], w[s]], at[a:b] - at[a]))
    total = alpha[size, np.arange(n)]
    return np.bincount(piece, weight[word] * np.exp(alpha[start, word] + gain + beta[end, word] - total[word]), len(logs))


def train(words: pd.DataFrame, pieces: list[bytes], rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """(languages, piece probabilities by language) from (lang, word, n); words are UTF-8 without the leading space."""
    langs, table = sorted(words["lang"].unique()), Pieces(pieces)
    probs = np.full((len(pieces), len(langs)), 1.0 / len(pieces))
    for g, lang in enumerate(langs):
        part = words[words["lang"] == lang]
        raw, weight = [b" " + bytes(w) for w in part["word"]], part["n"].to_numpy(float)

        def lattice(block: list[int], raw: list[bytes] = raw, weight: np.ndarray = weight) -> tuple:
            own = Words([raw[i] for i in block])
            return *table.edges(own, 0, int(own.size[-1])), own.size, weight[block][own.order]

        dealt = list(blocks(raw, SLAB))
        # a small sample's lattices are made once
        kept = [lattice(block) for block in dealt] if sum(map(len, raw)) <= HELD else None
        p = np.full(len(pieces), 1.0 / len(pieces))
        # single bytes start low, so that pieces win where they can
        p[:256] *= 0.05
        for _ in range(rounds):
            counts = np.full(len(pieces), PRIOR)
            for *edges, size, times in kept if kept is not None else map(lattice, dealt):
                counts += expected(*edges, size, np.log(p), times)
            p = counts / counts.sum()
        probs[:, g] = p
    return langs, probs


def score_words(table: Pieces, raw: list[bytes], logs: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw), logs.shape[1]))
    for block in blocks(raw, min(SLAB, CELLS // ((table.longest + 1) * logs.shape[1]))):
        out[block] = forward(table, Words([raw[i] for i in block]), logs)
    return out


def _predict(langs: list[str], probs: object, pieces: object, text: int = 1, gain: float | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Predictions of the rows, or with a gain the rows themselves that a learned language explains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, logs, names = Pieces(pieces.value), np.log(probs.value), np.array([*langs, UNKNOWN])
        if gain is not None and langs:
            # one more column, of a language in which every piece is as rare as one that was never met
            logs = np.concatenate([logs, np.full((len(logs), 1), logs.min())], 1)
        known, score = np.zeros(0, np.uint64), np.zeros((0, logs.shape[1]))
        for batch in batches:
            letters = pc.fill_null(pc.match_substring_regex(batch.column(text), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            for lo, hi, data, off in tn.chunks(pc.utf8_lower(batch.column(text)), tn.CHUNK_BYTES // 4):
                starts, ends, first = tn.words(data, off)
                row = np.repeat(np.arange(hi - lo), np.diff(first))
                hashes = tn.word_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
                distinct, at, back = np.unique(hashes, return_index=True, return_inverse=True)
                place = np.minimum(np.searchsorted(known, distinct), max(0, len(known) - 1))
                have = known[place] == distinct if len(known) else np.zeros(len(distinct), bool)
                each = np.zeros((len(distinct), logs.shape[1]))
                each[have] = score[place[have]]
                fresh = np.flatnonzero(~have)
                if len(fresh) and langs:
                    raw = data.tobytes()
                    each[fresh] = score_words(table, [b" " + raw[a:b] for a, b in zip(starts[at[fresh]].tolist(), ends[at[fresh]].tolist(), strict=True)], logs)
                    if len(known) + len(fresh) > KEPT:
                        known, score = known[:0], score[:0]
                    # words of very many chunks would not fit, so that a task starts anew from time to time
                    merged = np.concatenate([known, distinct[fresh][:KEPT]])
                    order = np.argsort(merged)
                    known, score = merged[order], np.concatenate([score, each[fresh][:KEPT]])[order]
                total = np.stack([np.bincount(row, each[back, g], hi - lo) for g in range(logs.shape[1])], 1) if langs else np.zeros((hi - lo, 0))
                good = letters[lo:hi] & bool(langs)
                if gain is not None:
                    size = np.bincount(row, ends - starts + 1, hi - lo)
                    good = good & (total[:, :-1].max(1) - total[:, -1] >= gain * size) if langs else good
                    yield batch.slice(lo, hi - lo).filter(pa.array(good))
                    continue
                best = total.argmax(1) if langs else np.zeros(hi - lo, int)
                sure = 1 / np.exp(np.minimum(total - total.max(1, keepdims=True), 0)).sum(1) if langs else np.zeros(hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(names[np.where(good, best, len(langs))]), pa.array(np.where(good, sure, 0.0))], ["doc_id", "lang_pred", "score"])

    return run


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, pieces: list[bytes], max_docs: int = 1000, max_bytes: int = 20000) -> tuple[list[str], np.ndarray]:
    """Learn from rows of (doc_id, text, lang); at most about max_docs documents a language reach the driver, as word counts.

    They are those of at most max_bytes, or, of a language that has only longer ones, its shortest.
    """
    told = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    size = F.octet_length("text")
    longest = {r["lang"]: max(max_bytes, r["least"]) for r in told.groupBy("lang").agg(F.min(size).alias("least")).collect()}
    if not longest:
        return [], np.zeros((len(pieces), 0))
    bound = F.create_map(*[F.lit(x) for kv in longest.items() for x in kv])
    labelled = told.where(size <= bound[F.col("lang")])
    share = {r["lang"]: min(1.0, max_docs / r["count"]) for r in labelled.groupBy("lang").count().collect()}
    limit = F.create_map(*[F.lit(x) for kv in share.items() for x in kv])
    # a hash is even over [-1, 1), of whatever size the share is
    place = F.xxhash64("doc_id", "text", F.lit("language sample")).cast("double") / float(1 << 63)
    chosen = labelled.where(place < limit[F.col("lang")] * 2 - 1)
    words = chosen.select("lang", F.explode(F.split(F.lower("text"), "[ \\t-\\r]+")).alias("word")).where("word != ''")
    return train(words.groupBy("lang", F.encode("word", "UTF-8").alias("word")).agg(F.count(F.lit(1)).alias("n")).toArrow().to_pandas().sort_values(["lang", "word"]), pieces)


def predict(docs: DataFrame, langs: list[str], probs: np.ndarray, pieces: list[bytes]) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of docs; score is the posterior of the predicted language."""
    context = docs.sparkSession.sparkContext
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(released(_predict(langs, context.broadcast(probs), context.broadcast(pieces))), f"doc_id {kind}, lang_pred string, score double")


def accepted(docs: DataFrame, langs: list[str], probs: np.ndarray, pieces: list[bytes], gain: float = GAIN) -> DataFrame:
    """The rows of docs, unchanged, that have a letter and that some learned language explains: by ``gain`` nats a byte better than untrained pieces."""
    context = docs.sparkSession.sparkContext
    run = _predict(langs, context.broadcast(probs), context.broadcast(pieces), docs.columns.index("text"), gain)
    return docs.mapInArrow(released(run), docs.schema)
