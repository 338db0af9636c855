"""Language-model scores from a probabilistic suffix tree over words.

The symbols are the tokens: words, lower-cased in A-Z, and one end a text. A context is the last 1 to ``depth`` tokens
within the text, its start included. The tree's nodes are the contexts whose next words repeat in the training texts;
a node is retained if its next words coincide more often than those of its suffix do, by SIGNIFICANCE deviations (a
test of the divergence of order 2 that needs only counts). A next word that a node saw twice or more keeps its count
less DISCOUNT; what is discounted, and all that came once, weighs the suffix's distribution. The root is the words'
frequencies, with the share of words seen once kept for words never seen. A token is scored by its longest retained
context. All bounds are counts of occurrences, so rows that are added prune nothing and the tree grows with the corpus.

Texts are dealt into chunks of some DEALT bytes, each one row of a bucketed table that every pass reads where it lies.
A chunk's distinct grams go, with their counts in its training texts, to groups by context; there counts are summed, and
each chunk gets back the numbers of its own grams, in its own order: first one bit each, whether it occurs twice, and for
scoring the counts of those that do. A context is asked for only where it occurs twice, a gram where its suffix does, too.
Contexts that are more frequent than a share of 1 / HOT of the text are split among SPLIT groups.
No group, task or driver holds more than its share: the driver sees sums, and at most some 4,000 hot contexts a level.

Defined results: null text is empty and scores its end only; every row is scored by itself, whatever its doc_id, so
repeated rows get equal rows; rows without doc_id train (crc32 of nothing is not the held-out rest) and are scored; with
no training row counts are 0. Extra columns are ignored. Empty tables give empty results. Words are identified by 64-bit
hashes; contexts within a group by 48 bits, of which a group asks some million, and next words within a context by 40.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp as tn
from .common import bucketed, discard, released, staged

DEPTH = 2
DISCOUNT = 0.75
SIGNIFICANCE = 4.0
#: Bytes of text in a chunk, and bytes of text whose grams make up a group.
DEALT, GROUPED = 12 << 20, 4 << 20
HOT, SPLIT = 1000, 64
START, STOP = np.uint64(0x1D8AF4C36B92E575), np.uint64(0x62B7D1F08C3E49AB)
_FORWARD, _BACK = "chunk long, bucket int, blob binary", "chunk long, level int, bucket int, often binary, blob binary"
#: Rows of a group's answer that are for the driver.
_SUMS, _NEXT_HOT, _HOT_STATS = -1, -2, -3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob; the first bytes of all numbers come first, then the second ones and so on."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays]
    raw = b"".join([np.array([len(arrays), *map(len, planes)], np.int64).tobytes(), *planes])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes, kinds: str) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    at, out = 8 * (n + 1), []
    for size, kind in zip(np.frombuffer(raw, np.int64, n, 8).tolist(), map(np.dtype, kinds.split()), strict=True):
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(kind.itemsize, size // kind.itemsize)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += size
    return out


def _bits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(train, doc_id, text) -> chunks: one row with the ids, sizes and compressed texts of some DEALT bytes."""
    number, held, size = TaskContext.get().partitionId() << 32, [], 0

    def flush() -> pa.RecordBatch:
        train, ids = (pa.concat_arrays([h[i] for h in held]) for i in (0, 1))
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        sizes, text = np.concatenate([h[2] for h in held]), b"".join(h[3] for h in held)
        columns = [pa.array([number]), one(train), one(ids), one(pa.array(sizes)), pa.array([pack(np.frombuffer(text, np.uint8))], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["chunk", "train", "ids", "sizes", "text"])

    for batch in batches:
        for lo, hi, data, off in tn.chunks(batch.column(2), DEALT):
            if held and size + len(data) > DEALT:
                yield flush()
                number, held, size = number + 1, [], 0
            held.append((batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), np.diff(off), data.tobytes()))
            size += len(data)
    if held:
        yield flush()


class Chunk:
    """The token sequences of a chunk: every text opens with START and ends with STOP."""

    def __init__(self, row: pa.Table):
        self.number = row.column("chunk")[0].as_py()
        self.ids = row.column("ids").combine_chunks().flatten()
        train = row.column("train").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        sizes = row.column("sizes").combine_chunks().flatten().to_numpy()
        (data,) = unpack(row.column("text")[0].as_py(), "u1")
        off = np.concatenate([[0], np.cumsum(sizes)])
        parts, self.words, lo = [], [], 0
        while lo < len(sizes):
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + (1 << 20), "right")) - 1)
            lower = _LOWER[data[off[lo] : off[hi]]]
            starts, ends, first = tn.words(lower, off[lo : hi + 1] - off[lo])
            parts.append(tn.word_hashes(lower, starts, ends) if len(starts) else np.zeros(0, np.uint64))
            self.words.append(np.diff(first))
            lo = hi
        self.words = np.concatenate(self.words)
        self.row = np.repeat(np.arange(len(sizes)), self.words + 2)
        begin = np.cumsum(self.words + 2) - self.words - 2
        self.place = np.arange(len(self.row)) - begin[self.row]
        self.token = np.empty(len(self.row), np.uint64)
        inside = (self.place > 0) & (self.place <= self.words[self.row])
        self.token[inside] = np.concatenate(parts)
        self.token[begin] = START
        self.token[begin + self.words + 1] = STOP
        self.train = train[self.row]
        self.keys = [self.token >> np.uint64(16)]

    def key(self, level: int) -> np.ndarray:
        """By position, the gram of level + 1 tokens that ends there (rubbish where the text is shorter)."""
        while len(self.keys) <= level:
            before, k = self.keys[-1], np.zeros(len(self.token), np.uint64)
            k[1:] = gram_key(before[:-1], self.token[1:] >> np.uint64(24))
            self.keys.append(k)
        return self.keys[level]


def gram_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return tn.mix(context * np.uint64(0x9E3779B97F4A7C15) + word * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(16)


def _bucket(context: np.ndarray, bits: int, word: np.ndarray | None, hot: np.ndarray, buckets: int) -> np.ndarray:
    """Groups of contexts of so many bits: ranges of them, but for the hot ones, which are dealt by their next words."""
    bucket = (((context >> np.uint64(bits - 32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
    if word is not None and len(hot):
        at = np.minimum(np.searchsorted(hot, context), len(hot) - 1)
        hit = np.flatnonzero(hot[at] == context)
        bucket[hit] = tn.mix(context[hit] + (word[hit] % np.uint64(SPLIT) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(buckets)
    return bucket


class Asked:
    """What a chunk asks of a level: its contexts, with next words, in the order of their groups.

    Level 0 asks for the words themselves as contexts. ``often`` marks the positions whose gram of the level below occurs
    twice; by position, ``context`` and ``gram`` index the answers (-1 for none).
    """

    def __init__(self, chunk: Chunk, level: int, hot: np.ndarray, buckets: int, often: np.ndarray | None = None):
        n = len(chunk.token)
        self.level = level
        if level == 0:
            self.keys, self.context = np.unique(chunk.token, return_inverse=True)
            self.bucket = _bucket(self.keys, 64, None, hot, buckets)
            self.counts = np.bincount(self.context, chunk.train, len(self.keys)).astype(np.int64)
            self.grams, self.word, self.gram_counts = np.zeros(len(self.keys), np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
            return
        self.context, self.gram = np.full(n, -1), np.full(n, -1)
        seen = chunk.place >= level
        seen[1:] &= often[:-1]
        at = np.flatnonzero(seen)
        context, word = chunk.key(level - 1)[at - 1], chunk.token[at] >> np.uint64(24)
        # contexts or words that share all of these bits are only asked for twice
        order = np.argsort(context >> np.uint64(16) << np.uint64(32) | word >> np.uint64(8))
        bucket = _bucket(context[order], 48, word[order], hot, buckets)
        if len(hot):
            again = np.argsort(bucket, kind="stable")
            order, bucket = order[again], bucket[again]
        at, context, word = at[order], context[order], word[order]
        new = np.ones(len(at), bool)
        new[1:] = (context[1:] != context[:-1]) | (bucket[1:] != bucket[:-1])
        fresh = new.copy()
        fresh[1:] |= word[1:] != word[:-1]
        self.context[at] = np.cumsum(new) - 1
        self.keys, self.bucket = context[new], bucket[new]
        number = np.cumsum(fresh) - 1
        first = np.flatnonzero(fresh)
        wanted = often[at[first]]
        self.gram[at] = np.where(wanted, np.cumsum(wanted) - 1, -1)[number]
        first = first[wanted]
        self.word = word[first]
        self.grams = np.bincount(self.context[at[first]], minlength=len(self.keys))
        some = self.gram[at] >= 0
        self.gram_counts = np.bincount(self.gram[at][some], chunk.train[at][some], len(self.word)).astype(np.int64)

    def slices(self) -> Iterator[tuple[int, slice, slice]]:
        """(bucket, its contexts, its grams)."""
        ends = np.concatenate([[0], np.cumsum(self.grams)])
        edges = np.concatenate([np.flatnonzero(np.diff(self.bucket, prepend=-1)), [len(self.bucket)]])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield int(self.bucket[a]), slice(a, b), slice(int(ends[a]), int(ends[b]))

    def blobs(self, chunk: int) -> pa.Table:
        buckets, blobs = [], []
        for bucket, c, g in self.slices():
            buckets.append(bucket)
            key = np.diff(self.keys[c], prepend=np.uint64(0))
            if self.level == 0:
                blobs.append(pack(key, self.counts[c].astype(np.uint32)))
                continue
            planes = [(self.word[g] >> np.uint64(8 * j)).astype(np.uint8) for j in range(5)]
            blobs.append(pack(key, self.grams[c].astype(np.uint32), *planes, self.gram_counts[g].astype(np.uint32)))
        return pa.table({"chunk": pa.array([chunk] * len(buckets), pa.int64()), "bucket": pa.array(buckets, pa.int32()), "blob": pa.array(blobs, pa.binary())})


class Answer:
    """The numbers of an Asked: the words' counts (level 0), by context its next words that repeat, their occurrences and coincidences, by gram its count if it repeats.

    Without ``whole``, counts are 2 for what occurs twice, and nothing else is there.
    """

    def __init__(self, asked: Asked, rows: dict[tuple[int, int], tuple[bytes, ...]], hot: dict[str, np.ndarray], whole: bool):
        n, m = len(asked.keys), len(asked.word)
        self.repeated, self.occurrences, self.pairs, self.counts = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(m if asked.level else n, np.int64)
        for bucket, c, g in asked.slices():
            often, *blob = rows[asked.level, bucket]
            at = g if asked.level else c
            often = _bits(often, at.stop - at.start)
            if not whole:
                self.counts[at] = 2 * often
            elif asked.level == 0:
                (self.counts[at],) = unpack(*blob, "u8")
            else:
                some, repeated, occurrences, pairs, counts = unpack(*blob, "u1 u4 u8 f8 u8")
                some = np.flatnonzero(_bits(some, c.stop - c.start)) + c.start
                self.repeated[some], self.occurrences[some], self.pairs[some] = repeated, occurrences, pairs
                self.counts[np.flatnonzero(often) + g.start] = counts
        if len(hot["key"]) and n:
            at = np.minimum(np.searchsorted(hot["key"], asked.keys), len(hot["key"]) - 1)
            hit = hot["key"][at] == asked.keys
            for name in ("repeated", "occurrences", "pairs"):
                getattr(self, name)[hit] = hot[name][at[hit]]


def _rows(table: pa.Table) -> dict[tuple[int, int], tuple[bytes, ...]]:
    level, bucket, *blobs = (table.column(c).to_pylist() for c in table.column_names if c != "chunk")
    return dict(zip(zip(level, bucket, strict=True), zip(*blobs, strict=True), strict=True))


def _grouped(level: int, hot: np.ndarray, hot_from: float) -> Callable[[pa.Table], pa.Table]:
    """All chunks' blobs of a bucket -> each chunk's answer."""

    def run(table: pa.Table) -> pa.Table:
        chunks, bucket = table.column("chunk").to_pylist(), table.column("bucket")[0].as_py()
        keys, grams, words, times = [], [], [], []
        for blob in table.column("blob"):
            if level == 0:
                (key, n), size, word = unpack(blob.as_py(), "u8 u4"), np.zeros(0, np.int64), np.zeros(0, np.uint64)
            else:
                key, size, *planes, n = unpack(blob.as_py(), "u8 u4 u1 u1 u1 u1 u1 u4")
                word = sum((p.astype(np.uint64) << np.uint64(8 * j) for j, p in enumerate(planes)), np.zeros(len(n), np.uint64))
            keys.append(np.cumsum(key, dtype=np.uint64))
            grams.append(size.astype(np.int64))
            words.append(word)
            times.append(n.astype(np.int64))
        ends, gram_ends = np.cumsum([0, *map(len, keys)]), np.cumsum([0, *map(len, words)])
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        if level == 0:
            return counted(chunks, bucket, key, back, ends, np.bincount(back, np.concatenate(times), len(key)).astype(np.int64))
        of = np.repeat(back, np.concatenate(grams))
        word, n = np.concatenate(words), np.concatenate(times)
        order = np.argsort(of.astype(np.uint64) << np.uint64(40) | word) if len(key) < 1 << 24 else np.lexsort((word, of))
        new = np.ones(len(order), bool)
        new[1:] = (of[order][1:] != of[order][:-1]) | (word[order][1:] != word[order][:-1])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        each = np.bincount(number, n, int(new.sum())).astype(np.int64)
        first = order[new]
        context, often = of[first], each > 1
        pick = lambda x: np.bincount(context[often], x[often], len(key))
        repeated, occurrences, pairs = pick(np.ones(len(each))), pick(each), pick(each * (each - 1) / 2)
        some, out = repeated > 0, []
        for i, chunk in enumerate(chunks):
            b, g = back[ends[i] : ends[i + 1]], number[gram_ends[i] : gram_ends[i + 1]]
            mask, values = some[b], each[g][often[g]]
            b = b[mask]
            out.append((chunk, np.packbits(often[g]).tobytes(), pack(np.packbits(mask), repeated[b].astype(np.uint32), occurrences[b].astype(np.uint64), pairs[b], values.astype(np.uint64))))
        following = gram_key(key[context], word[first])[each >= hot_from]
        if len(following):
            out.append((_NEXT_HOT, b"", pack(following)))
        at = np.isin(key, hot)
        if at.any():
            out.append((_HOT_STATS, b"", pack(key[at], repeated[at], occurrences[at], pairs[at])))
        return told(bucket, out)

    def counted(chunks: list[int], bucket: int, key: np.ndarray, back: np.ndarray, ends: np.ndarray, total: np.ndarray) -> pa.Table:
        own = [back[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        out = [(chunk, np.packbits(total[b] > 1).tobytes(), pack(total[b].astype(np.uint64))) for chunk, b in zip(chunks, own, strict=True)]
        real = (key != START) & (total > 0)
        out.append((_SUMS, b"", pack(np.array([total[real].sum(), real.sum(), (total[real] == 1).sum(), (total[real] * (total[real] - 1.0)).sum()], np.float64))))
        following = key[total >= hot_from] >> np.uint64(16)
        if len(following):
            out.append((_NEXT_HOT, b"", pack(following)))
        return told(bucket, out)

    def told(bucket: int, out: list[tuple[int, bytes, bytes]]) -> pa.Table:
        chunk, often, blob = (list(x) for x in zip(*out, strict=True))
        return pa.table({"chunk": pa.array(chunk, pa.int64()), "level": pa.array([level] * len(out), pa.int32()), "bucket": pa.array([bucket] * len(out), pa.int32()), "often": pa.array(often, pa.binary()), "blob": pa.array(blob, pa.binary())})

    return run


def _hot_stats(blobs: list[bytes]) -> dict[str, np.ndarray]:
    """The parts of split contexts, added up."""
    parts = [unpack(b, "u8 f8 f8 f8") for b in blobs]
    if not parts:
        return {"key": np.zeros(0, np.uint64)}
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
    key, back = np.unique(columns[0], return_inverse=True)
    return {"key": key} | {name: np.bincount(back, c, len(key)) for name, c in zip(("repeated", "occurrences", "pairs"), columns[1:], strict=True)}


class Lookup:
    """A chunk's answers, level by level, as arrays by position."""

    def __init__(self, chunk: Chunk, hots: list[np.ndarray], stats: list[dict], buckets: int):
        self.chunk, self.hots, self.stats, self.buckets = chunk, hots, stats, buckets
        self.counts: list[np.ndarray] = []  # by level, of the gram that ends at a position
        self.nodes: list[tuple[np.ndarray, ...]] = []  # (total, repeated, occurrences, pairs) of the context before it

    def asked(self, level: int) -> Asked:
        return Asked(self.chunk, level, self.hots[level], self.buckets, self.counts[level - 1] > 1 if level else None)

    def take(self, level: int, rows: dict[tuple[int, int], tuple[bytes, ...]], whole: bool) -> None:
        asked = self.asked(level)
        got = Answer(asked, rows, self.stats[level], whole)
        if level == 0:
            self.counts.append(got.counts[asked.context])
            return
        fill = lambda values, at: np.where(at >= 0, values[at], 0) if len(values) else np.zeros(len(at))
        total = np.zeros(len(self.chunk.token))
        total[1:] = self.counts[level - 1][:-1]
        self.counts.append(fill(got.counts, asked.gram).astype(np.int64))
        if whole:
            self.nodes.append((np.where(self.chunk.place >= level, total, 0), *(fill(v, asked.context) for v in (got.repeated, got.occurrences, got.pairs))))


def probabilities(look: Lookup, sums: np.ndarray) -> np.ndarray:
    """By position, the tree's probability of the token; from the root to the longest retained context."""
    n, _, once, coincide = sums
    unseen, c = (once + 1) / (n + 2), look.counts[0]
    p = np.where(c > 0, (1 - unseen) * c / max(n, 1), unseen)
    rate = np.full(len(p), coincide / (n * (n - 1)) if n > 1 else 0.0)
    for level, (total, repeated, occurrences, pairs) in enumerate(look.nodes, 1):
        room = total * (total - 1) / 2
        expected = room * rate
        kept = (repeated > 0) & (pairs > expected + SIGNIFICANCE * np.sqrt(expected))
        size, gram = np.maximum(total, 1), look.counts[level]
        rest = (DISCOUNT * repeated + total - occurrences) / size
        p = np.where(kept, np.where(gram > 1, (gram - DISCOUNT) / size, 0) + rest * p, p)
        rate = np.where(room > 0, pairs / np.maximum(room, 1), 0)
    return p


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def scores(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select((~held_out()).alias("train"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt = bucketed(rows.mapInArrow(released(_deal), f"chunk long, train array<boolean>, ids array<{kind}>, sizes array<long>, text binary"), "chunk", "dealt", "uncompressed")
    size = dealt.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets, hot_from = max(1, int(size) // GROUPED), max(2.0, size / (8 * HOT))
    hots, stats, answers, sums = [np.zeros(0, np.uint64)], [{"key": np.zeros(0, np.uint64)}], [], np.zeros(4)

    def with_answers(f: Callable[[Lookup], pa.Table], schema: str, whole: bool) -> DataFrame:
        """f over every chunk, after the answers so far are taken; they are read whole or only in bits."""
        known_hots, known_stats, levels = list(hots), list(stats), len(answers)

        def one(row: pa.Table, back: pa.Table | None = None) -> pa.Table:
            look, got = Lookup(Chunk(row), known_hots, known_stats, buckets), _rows(back) if back is not None else {}
            for level in range(levels):
                look.take(level, got, whole)
            return f(look)

        if not answers:
            return dealt.groupBy("chunk").applyInArrow(lambda row: one(row), schema)
        parts = [a.where("chunk >= 0").select("chunk", "level", "bucket", "often", *["blob"] * whole) for a in answers]
        return dealt.groupBy("chunk").cogroup(reduce(DataFrame.unionByName, parts).groupBy("chunk")).applyInArrow(lambda row, got: one(row, got), schema)

    for level in range(depth + 1):
        forward, given = with_answers(lambda look, level=level: look.asked(level).blobs(look.chunk.number), _FORWARD, False), hots[level]
        answer = staged(forward.groupBy("bucket").applyInArrow(_grouped(level, given, hot_from), _BACK), "answers", "uncompressed")
        answers.append(answer)
        told = [(r["chunk"], bytes(r["blob"])) for r in answer.where("chunk < 0").collect()]
        if level == 0:
            sums = sum((unpack(b, "f8")[0] for c, b in told if c == _SUMS), np.zeros(4))
        else:
            stats.append(_hot_stats([b for c, b in told if c == _HOT_STATS]))
        hots.append(np.unique(np.concatenate([*(unpack(b, "u8")[0] for c, b in told if c == _NEXT_HOT), np.zeros(0, np.uint64)])))

    scale, train_tokens = sums[0] + sums[1] + 1, int(sums[0])

    def scored(look: Lookup) -> pa.Table:
        chunk, n = look.chunk, len(look.chunk.words)
        told = chunk.place > 0
        row, c = chunk.row[told], look.counts[0][told]
        base, score = np.log10((c + 1) / scale), np.log10(probabilities(look, sums)[told])
        columns = [chunk.ids, pa.array(chunk.words + 1), pa.array(np.bincount(row, c > 0, n).astype(np.int64)), pa.array(np.bincount(row, base, n)), pa.array(np.bincount(row, score, n))]
        return pa.Table.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    out = staged(with_answers(scored, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double", True), "scores")
    discard(dealt, *answers)
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
