"""How far the sources of a language diverge: every two of them, and each from its language, by a systolic rotation.

1. Occurrences of terms are counted inside the tasks and added up by (lang, source, term); a language keeps the terms
   that at least ``least`` of its documents hold.
2. A group is a (lang, source). Its counts are cut into slices of the language's terms, and groups sit on a few seats a
   language. What sits on one seat in one slice is a station: one group of rows of a table bucketed by station, which
   all rounds read where it lies. A vector in it is compressed: differences of term numbers and counts.
3. In a round of a round-robin tournament every seat meets one other. The vectors of one of the two travel to the other's
   station, which evaluates both directions of each meeting; after seats - 1 rounds all have met. Round 0 is played at
   home: the groups of a seat among each other, and each against its language, where a heap keeps the slice's best terms.
4. Sums over slices and heaps meet by group.

All arithmetic is on 64-bit integers and exact. A station holds about STATION entries whatever a source's share of the
rows is, since rows are added up before anything is dealt; so no seat, source or language meets in one task.

Defined results: null text, lang or source counts as ''. A group without terms still takes part; where a language keeps
no term, pairs have the value 0. Rows that are repeated are documents of their own. Texts of any length are split into
terms piece by piece. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucketed, discard, released, staged
from .terms import Splitter, values

SCALE = 1_000_000_000
#: Terms in a slice, and vector entries at a station, at about which another slice is begun.
SLICE_TERMS, STATION = 1 << 15, 1 << 20
#: Seats of a language; even.
SEATS = 8
#: Entries that a task adds up before it hands them on.
HELD = 200_000


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> (lang, source, term, count, docs), added up over some thousand documents."""
    split = Splitter(digits=False)
    count: dict[tuple[str, str], Counter[bytes]] = defaultdict(Counter)
    docs: dict[tuple[str, str], Counter[bytes]] = defaultdict(Counter)
    held = 0

    def told() -> Iterator[pa.RecordBatch]:
        for (lang, source), found in count.items():
            mine = docs[lang, source]
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(found), pa.string()), "source": pa.array([source] * len(found), pa.string()), "term": pa.array(list(found), pa.binary()), "count": pa.array(list(found.values()), pa.int64()), "docs": pa.array([mine[t] for t in found], pa.int64())})
        count.clear()
        docs.clear()

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), values(batch.column(2)), strict=True):
            found = split.counts(text)
            mine, before = count[lang, source], len(count[lang, source])
            mine.update(found)
            docs[lang, source].update(found.keys())
            held += len(mine) - before
            if held > HELD:
                yield from told()
                held = 0
    yield from told()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(..., entries of (tid, count) in the order of tid) -> (..., vec): the compressed vector."""
    for batch in batches:
        rows = []
        for entries in batch.column("entries"):
            flat = entries.values if entries.is_valid else None
            ids = np.asarray(flat.field("tid")) if flat is not None else np.zeros(0, np.int32)
            counts = np.asarray(flat.field("count")) if flat is not None else np.zeros(0, np.int64)
            raw = np.diff(ids, prepend=0).astype(np.int32).tobytes() + counts.astype(np.int64).tobytes()
            rows.append(len(ids).to_bytes(4, "little") + (bytes(pa.compress(raw, "zstd", asbytes=True)) if len(ids) else b""))
        rest = batch.drop_columns(["entries"])
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(rows, pa.binary())], [*rest.schema.names, "vec"])


def share(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE * count / total) for counts up to total, three digits at a time, so that nothing leaves 64 bits."""
    found, rest = np.zeros_like(count), count.copy()
    for _ in range(3):
        rest = rest * 1000
        found = found * 1000 + rest // total
        rest %= total
    # the first step finds more than 999 only if count is total
    return found + 1


@dataclass
class Vector:
    source: str
    ids: np.ndarray
    counts: np.ndarray
    p: np.ndarray  # of all terms of the slice
    none: int  # p of a term that does not occur


def _vector(row: dict) -> Vector:
    n, total, terms = int.from_bytes(row["vec"][:4], "little"), row["n"] + row["v"], row["terms"]
    raw = pa.decompress(row["vec"][4:], 12 * n, "zstd", asbytes=True) if n else b""
    ids, counts = np.cumsum(np.frombuffer(raw, np.int32, n)), np.frombuffer(raw, np.int64, n, 4 * n)
    none = int(share(np.ones(1, np.int64), total)[0]) if total else 1
    p = np.full(terms, none, np.int64)
    if n:
        p[ids] = share(counts + 1, total)
    return Vector(row["source"], ids, counts, p, none)


def distances(a: Vector, b: Vector) -> tuple[int, int]:
    """(from a with b's shares below, the other way round), summed over the slice; terms of neither are as many equal summands."""
    at = np.union1d(a.ids, b.ids)
    p, q = a.p[at], b.p[at]
    square, rest, both = (p - q) ** 2, len(a.p) - len(at), (a.none - b.none) ** 2
    return int((square // q).sum()) + rest * (both // b.none), int((square // p).sum()) + rest * (both // a.none)


_PAIR = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.binary()), ("value", pa.int64())])
_OUT = "lang string, source string, part string, item binary, value long"


def _told(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _PAIR, strict=True)], schema=_PAIR) if rows else _PAIR.empty_table()


def _at_home(top: int):
    def run(table: pa.Table) -> pa.Table:
        groups, whole = [], None
        for row in table.to_pylist():
            if row["source"] is None:
                whole, words = _vector(row), row["words"]
            else:
                groups.append(_vector(row))
        lang, out = table["lang"][0].as_py(), []
        for i, a in enumerate(groups):
            for b in groups[:i]:
                there, back = distances(a, b)
                out += [(lang, a.source, "pair", b.source.encode(), there), (lang, b.source, "pair", a.source.encode(), back)]
            if whole is not None and len(a.ids):
                p, q = a.p[a.ids], whole.p[a.ids]
                more = p > q
                values = (p - q)[more] ** 2 // q[more]
                best = heapq.nsmallest(top, zip((-values).tolist(), (words[i] for i in a.ids[more].tolist()), strict=True))
                out += [(lang, a.source, "term", word, -value) for value, word in best]
        return _told(out)

    return run


def _meet(home: pa.Table, away: pa.Table) -> pa.Table:
    if not home.num_rows or not away.num_rows:
        return _PAIR.empty_table()
    guests, lang, out = [_vector(row) for row in away.to_pylist()], home["lang"][0].as_py(), []
    for row in home.to_pylist():
        a = _vector(row)
        for b in guests:
            there, back = distances(a, b)
            out += [(lang, a.source, "pair", b.source.encode(), there), (lang, b.source, "pair", a.source.encode(), back)]
    return _told(out)


def opponent(seat: Column, turn: int, seats: int = SEATS) -> Column:
    """The seat that a seat meets in this round, by the circle method: numbers that add up to the round, modulo seats - 1, meet; the one left over meets the last seat."""
    ring = seats - 1
    other = F.pmod(F.lit(turn) - seat, F.lit(ring))
    return F.when(seat == ring, F.lit(turn * (seats // 2) % ring)).when(other == seat, F.lit(ring)).otherwise(other).cast("int")


def _station(seat: Column) -> Column:
    return F.concat_ws("|", "slice", seat, "lang")


def stations(docs: DataFrame, least: int = 3, seats: int = SEATS) -> DataFrame:
    """(station, lang, slice, seat, source, n, v, terms, vec, words), bucketed by station; the row of the language itself has no source, and the slice's words."""
    text = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = staged(text.mapInArrow(released(_counts), "lang string, source string, term binary, count long, docs long").groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")), "counts")
    totals = staged(counted.groupBy("lang", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("entries")).where(F.col("docs") >= least), "totals")
    groups = text.select("lang", "source").distinct()
    per = totals.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("count").alias("whole"), F.sum("entries").alias("entries"))
    langs = groups.select("lang").distinct().join(per, "lang", "left").fillna(0)
    langs = staged(langs.withColumn("slices", F.ceil(F.greatest(F.lit(1), F.col("v") / SLICE_TERMS, F.col("entries") / (seats * STATION))).cast("int")), "langs")

    numbered = totals.select("lang", "term", "count").join(langs.select("lang", "slices"), "lang").withColumn("slice", F.pmod(F.xxhash64("term"), F.col("slices")).cast("int"))
    numbered = staged(numbered.withColumn("tid", (F.row_number().over(Window.partitionBy("lang", "slice").orderBy("term")) - 1).cast("int")), "numbered")
    held = counted.select("lang", "source", "term", "count").join(numbered.select("lang", "term", "slice", "tid"), ["lang", "term"])
    entry = F.array_sort(F.collect_list(F.struct("tid", "count")))  # a slice's terms at most
    vectors = held.groupBy("lang", "slice", "source").agg(entry.alias("entries"), F.sum("count").alias("part"))
    vectors = staged(vectors, "vectors")
    sizes = vectors.groupBy("lang", "source").agg(F.sum("part").alias("n"))
    sized = numbered.groupBy("lang", "slice").agg(F.count(F.lit(1)).cast("int").alias("terms"), F.transform(entry, lambda e: F.struct(e["tid"].alias("tid"), e["count"].alias("count"))).alias("entries"), F.transform(F.array_sort(F.collect_list(F.struct("tid", "term"))), lambda e: e["term"]).alias("words"))
    sized = staged(sized, "slices")

    rooms = langs.select("lang", "v", "whole", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")).join(sized, ["lang", "slice"], "left").withColumn("terms", F.coalesce("terms", F.lit(0)))
    seated = groups.join(sizes, ["lang", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("seat", F.pmod(F.xxhash64("source"), F.lit(seats)).cast("int"))
    own = seated.join(rooms.select("lang", "slice", "v", "terms"), "lang").join(vectors.drop("part"), ["lang", "slice", "source"], "left")
    shape = ["lang", "slice", "seat", "source", "n", "v", "terms", "words", "entries"]
    own = own.withColumn("words", F.lit(None).cast("array<binary>")).select(*shape)
    common = rooms.withColumnRenamed("whole", "n").withColumn("seat", F.explode(F.sequence(F.lit(0), F.lit(seats - 1)))).withColumn("source", F.lit(None).cast("string")).select(*shape)
    every = own.unionByName(common).select(_station(F.col("seat")).alias("station"), *shape)
    packed = every.mapInArrow(_pack, "station string, lang string, slice int, seat int, source string, n long, v long, terms int, words array<binary>, vec binary")
    made = bucketed(packed, "station", "stations")
    discard(counted, totals, langs, numbered, vectors, sized)
    return made


def divergences(docs: DataFrame, top: int = 200, least: int = 3, seats: int = SEATS) -> DataFrame:
    """(lang, source, part, item, value, rank): parts pair (all other sources of the language) and term (the top terms of the source against its language)."""
    resident = stations(docs, least, seats)
    found = resident.groupBy("station").applyInArrow(_at_home(top), _OUT)
    groups = resident.where("source is not null").drop("words")
    for turn in range(1, seats):
        other = opponent(F.col("seat"), turn, seats)
        # of two seats that meet, which of them travels changes from round to round
        travels = (F.col("seat") < other) == F.lit(turn % 2 == 0)
        moving = groups.where(travels).withColumn("station", _station(other))
        found = found.unionByName(groups.where(~travels).groupBy("station").cogroup(moving.groupBy("station")).applyInArrow(_meet, _OUT))
    # a group has one row a slice and pair, and no more than top rows a slice and term
    added = staged(found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")), "divergences")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = added.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top))
    discard(resident)
    return ranked.select("lang", "source", "part", F.decode("item", "UTF-8").alias("item"), "value", "rank")
