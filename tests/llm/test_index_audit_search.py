"""Run-length index, source audit and ranked search against brute force: nulls, empty and long texts, ties, repeats, clashing columns, empty tables."""

import math
import random
import re
from collections import Counter
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import run_index, search, source_audit
from loomgraph.llm.terms import Splitter

SCHEMA = "doc_id long, text string, lang string, source string, row int, anchor string, term string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "a", "t", 2) for r in rows], SCHEMA)


def test_run_index_statistics_are_exact():
    rng = np.random.default_rng(5)
    for trial in range(20):
        parts = [rng.integers(0, 2 + trial % 3, rng.integers(0, 30)).astype(np.uint8) for _ in range(8)]
        parts += [parts[0], parts[1][:7]]
        off = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        index = run_index.RunIndex(np.concatenate(parts), off)
        strings = [p.tobytes() for p in parts]
        places = [(i, j) for i, s in enumerate(strings) for j in range(len(s))]

        def agree(a, b):
            k = 0
            while strings[a[0]][a[1] + k : a[1] + k + 1] == strings[b[0]][b[1] + k : b[1] + k + 1] != b"":
                k += 1
            return k

        assert index.statistics().tolist() == [max(agree(a, b) for b in places if b != a) for a in places]
        assert index.runs <= len(places)


def texts_with_repeats():
    rng = random.Random(2)
    some = lambda n: "".join(rng.choice("abcdefghij klmno é") for _ in range(n))
    passage, line = some(700), some(90)
    near = [passage[:i] + "X" + passage[i + 1 :] for i in range(40, 640, 15)]
    long = some(200_000)
    rows = [None, "", "short", passage, passage, some(3000), some(150) + passage[100:420] + some(150), "=" * 700, some(100) + "=" * 230, passage[:199], "ab" * 300]
    rows += near + [some(120) + line + some(120) for _ in range(12)] + [long, some(50) + long[70_000:70_300], long[5_000:5_250] + line]
    return rows


def brute_cut(rows, window=200):
    raw = [(t or "").encode() for t in rows]
    seen = Counter(r[p : p + window] for r in raw for p in range(len(r) - window + 1))
    for r in raw:
        gone = bytearray(len(r))
        for p in range(len(r) - window + 1):
            if seen[r[p : p + window]] > 1:
                gone[p : p + window] = b"\1" * window
        yield len(r), sum(gone), sum(k for k, _ in groupby(gone)), bytes(b for b, g in zip(r, gone, strict=True) if not g)


@pytest.mark.parametrize("crowd", [4096, 3])
def test_run_index_cut(spark, monkeypatch, crowd):
    """With a small crowd every anchor of some entries goes through the second pass; short cuts try the pieces of a long text."""
    rows = texts_with_repeats()
    docs = frame(spark, [(i if i != 6 else None, t, "en", "s") for i, t in enumerate(rows)] + [(3, None, None, None)])
    monkeypatch.setattr(run_index, "CUT", 1 << 15)
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in run_index.remove_repeats(docs.repartition(3), crowd=crowd).collect())
    assert got == sorted(brute_cut([*rows, None]))


def test_run_index_of_nothing(spark):
    assert run_index.remove_repeats(frame(spark, [])).count() == 0
    alone = run_index.remove_repeats(frame(spark, [(1, "x" * 199, None, None)])).collect()
    assert [(r.n_removed, bytes(r.kept)) for r in alone] == [(0, b"x" * 199)]


def test_terms_of_long_texts(monkeypatch):
    monkeypatch.setattr("loomgraph.llm.terms.SLICE", 16)
    text = "Été 12abc ÉTÉ, straße-STRASSE; naïve " * 30 + "x" * 100
    for digits, pattern in ((False, r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"), (True, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")):
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        assert Splitter(digits).counts(text.encode()) == Counter(t.encode() for t in re.findall(pattern, lower))


def audit_rows():
    rng = random.Random(4)
    words = [f"w{'abcdefgh'[i % 8]}{'xyz'[i % 3]}{'é' * (i % 2)}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(words[: 10 + i % 30]) for _ in range(rng.randint(0, 60))), ["en", "fr", None][i % 3], ["a", "b", "c", "d", None, "é"][i % 6]) for i in range(90)]
    return rows + [(1, None, "en", "none"), (1, "12 ... 34", "en", "none"), (2, "once", "xx", "only"), (2, "once", "xx", "other"), (5, rows[5][1], *rows[5][2:]), (5, rows[5][1], *rows[5][2:])]


def brute_audit(rows, top):
    split, docs, counts, groups = Splitter(False), Counter(), Counter(), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = split.counts((text or "").encode())
        for t, n in found.items():
            docs[lang, t] += 1
            counts[lang, source, t] += n
    out = []
    for lang in {g[0] for g in groups}:
        terms = sorted(t for (x, t), n in docs.items() if x == lang and n >= 3)
        sources = sorted(s for x, s in groups if x == lang)
        share = lambda c, whole: [1 + 10**9 * (x + 1) // (whole + len(terms)) for x in c]  # noqa: E731, B023
        of = {s: [counts[lang, s, t] for t in terms] for s in sources}
        p = {s: share(c, sum(c)) for s, c in of.items()}
        whole = [sum(c) for c in zip(*of.values(), strict=True)]
        q = share(whole, sum(whole))
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(-sum(f(a, b) for a, b in zip(p[s], p[o], strict=True)), o.encode()) for o in sources if o != s]
            own = [(-f(a, b), t) for a, b, t, c in zip(p[s], q, terms, of[s], strict=True) if c and a > b]
            out += [(lang, s, part, item.decode(), -v, k) for part, found in (("pair", sorted(pairs)), ("term", sorted(own)[:top])) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("slice_terms", [1 << 15, 3])
def test_audit(spark, monkeypatch, slice_terms):
    """Small slices deal a language's terms out to many stations."""
    monkeypatch.setattr(source_audit, "SLICE_TERMS", slice_terms)
    monkeypatch.setattr(source_audit, "HELD", 50)
    rows = audit_rows()
    got = sorted(map(tuple, source_audit.divergences(frame(spark, rows).repartition(3), top=4).select("lang", "source", "part", "item", "value", "rank").collect()))
    assert got == brute_audit(rows, 4)


def test_audit_of_nothing_and_shares(spark):
    assert source_audit.divergences(frame(spark, [])).count() == 0
    for total in (1, 7, 10**15 + 37):
        for count in {1, total // 3 + 1, total}:
            assert source_audit.share(np.array([count]), total)[0] == 1 + 10**9 * count // total


def test_every_two_seats_meet_once(spark):
    seats = spark.range(8).select(F.col("id").cast("int").alias("s"))
    met = [(r.s, r.o) for turn in range(1, 8) for r in seats.select("s", source_audit.opponent(F.col("s"), turn).alias("o")).collect()]
    assert sorted(met) == [(a, b) for a in range(8) for b in range(8) if a != b]


def search_rows():
    rng = random.Random(6)
    words = [f"t{i}" for i in range(60)]
    rows = [(i, " ".join(words[min(int(rng.expovariate(0.08)), 59)] for _ in range(rng.randint(1, 80))), "en", "s") for i in range(150)]
    rows += [(i, None, None, None) for i in (1, 2)] + [(3, "", "en", "s"), (4, "?!", "en", "s"), (7, rows[7][1], "en", "s"), (900, rows[7][1], "en", "s"), (None, rows[7][1], "en", "s")]
    items = [(i, " ".join(rng.choice(words) for _ in range(12))) for i in range(8)]
    return rows, [*items, (8, rows[7][1]), (9, None), (10, "unheard of"), (11, "T3 t3 T3"), (12, "t1"), (12, "t5 t40"), (None, "t1")]


def brute_search(rows, items, k):
    split = Splitter(True)
    docs = [(i, found) for i, found in ((r[0], split.counts((r[1] or "").encode())) for r in rows) if found]
    total, asked, df = sum(f.total() for _, f in docs), {}, Counter(t for _, f in docs for t in f)
    for i, text in items:
        if i is not None:
            asked.setdefault(i, Counter()).update(split.counts((text or "").encode()))
    out = []
    for i, terms in asked.items():
        scored = []
        for doc, f in docs:
            m = 100 - 75 + 75 * f.total() * len(docs) // total
            score = sum(n * math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[t] + 1))) * (10**9 * f[t] // (1000 * f[t] + 8 * m)) for t, n in terms.items() if f[t])
            if score > 0:
                scored.append((-score, -1 if doc is None else doc))
        out += [(i, rank, None if doc == -1 else doc, -s) for rank, (s, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=lambda r: r[:2])


@pytest.mark.parametrize("small", [200_000, 0])
def test_search(spark, monkeypatch, small):
    """Without room for broadcasts the same joins shuffle."""
    monkeypatch.setattr(search, "SMALL", small)
    rows, items = search_rows()
    asked = spark.createDataFrame([(*i, 1, 2) for i in items], "item_id long, text string, row int, doc_id int")
    got = sorted(map(tuple, search.search(frame(spark, rows).repartition(3), asked, 5).collect()))
    assert got == brute_search(rows, items, 5)


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert search.search(frame(spark, search_rows()[0]), none).count() == 0
    assert search.search(frame(spark, []), spark.createDataFrame([(1, "t1")], "item_id long, text string")).count() == 0


def test_the_threshold_round_writes_no_more_than_can_still_win(spark):
    """One item of one list over several tasks: what is below the third best of all tasks is not written."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        postings = spark.range(4000).select(F.lit(0).cast("long").alias("tid"), (F.col("id") * 7919 % 4001 + 1).alias("part"), F.col("id").alias("row"))
        lists = spark.createDataFrame([(0, 0, 5, 4001, 1, 0)], "item int, tid int, weight long, top long, lists long, bound long")
        got = sorted(r.low for r in search._reported(postings, lists, 1, 3).collect())
        best = sorted(r.part * 5 for r in postings.collect())[-3:]
    finally:
        spark.conf.set(name, before)
    assert got == best
