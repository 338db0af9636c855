"""Each operator against brute force on small rows that hold nulls, empty and long texts, repeats, and extra columns."""

import base64
import glob
import gzip
import hashlib
import math
import os
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import chat_format, decontaminate, language_id, media, mixing, near_dedup, queries, sharding, substring_dedup, suffix_lm, warc
from loomgraph.llm import components as steps
from loomgraph.llm.common import new_path, staged, text_bytes
from loomgraph.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, count int"
LOREM = [f"w{(i * 7919) % 211}x" for i in range(400)]


def texts():
    base = " ".join(LOREM[:120])
    near = " ".join([*LOREM[:60], "changed", *LOREM[61:120]])
    return {1: base, 2: base, 3: near, 4: None, 5: "", 6: "  \n ", 7: "one two", 8: "one two", 9: " ".join(LOREM[200:300]) + " " + " ".join(LOREM[10:50]), 10: "été größer " * 3000, 11: "the cat sat on the mat", 12: "!!! 123 ..."}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], ["a", "a", None][i % 3], 0, 1, 2) for i, t in texts().items()]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_substring_dedup(docs, empty):
    got = {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept)) for r in substring_dedup.remove_repeats(docs).collect()}
    seen = set()
    for i, t in sorted(texts().items()):
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - 19):
            w = tuple(words[k : k + 20])
            if w in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(w)
        assert got[i] == (len(words), sum(gone), b" ".join(w for w, g in zip(words, gone, strict=True) if not g)), i
    assert substring_dedup.remove_repeats(empty).count() == 0
    spans = {(r.doc_id, r.src_doc_id): (r.start, r.end) for r in substring_dedup.repeated_spans(docs.where("doc_id in (1, 2)")).collect()}
    assert spans[2, 1] == (0, 120)


def test_substring_dedup_with_repeated_and_missing_ids(spark):
    long = " ".join(LOREM[:40])
    rows = spark.createDataFrame([(1, long), (1, long), (1, "a b"), (None, long), (2, long)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in substring_dedup.remove_repeats(rows).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (1, 0), (2, 40)]


def test_near_duplicates(docs, empty):
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert len(got) == len(texts())
    assert got[2] == 1 and got[3] == 1 and got[8] == 7
    assert all(got[i] == i for i in (1, 4, 5, 6, 7, 9, 10, 11, 12))
    assert near_dedup.near_duplicates(empty).count() == 0
    assert {r.doc_id for r in near_dedup.keep_one(docs).collect()} == set(texts()) - {2, 3, 8}


def test_near_duplicates_of_a_drifted_group(spark):
    """Copies that drift in steps from copy to copy; held against all pairs."""
    rng, group = np.random.default_rng(7), [[f"v{i}" for i in range(150)]]
    while len(group) < 60:
        copy = list(group[int(rng.integers(max(0, len(group) - 8), len(group)))])
        for at in rng.integers(0, 150, int(rng.integers(1, 4))):
            copy[at] = f"n{int(rng.integers(1 << 40))}"
        group.append(copy)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in group]
    root = list(range(60))
    for i in range(60):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(group)], "doc_id long, text string")).collect()}
    assert got == dict(enumerate(root))


def test_near_duplicates_that_share_no_band(spark):
    """Pairs that have 36 of 44 shingles in common, but whose registers mostly own words that one of them repeats; no link is lost."""
    rows = []
    for i in range(60):
        words = [f"p{i}w{j}" for j in range(37)]
        rows += [(2 * i + k, " ".join([*words, *[f"p{i}r{k}"] * 3000, *[f"p{i}s{k}"] * 3000])) for k in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs, 2).collect()} == {i: i - i % 2 for i in range(120)}
    # what the pipeline's stage calls
    assert sorted(r.doc_id for r in near_dedup.keep_one(docs, 2).collect()) == list(range(0, 120, 2))


def test_near_duplicates_of_other_sizes_at_high_thresholds(spark):
    words = [f"v{i}" for i in range(104)]
    for size, least in ((24, 0.95), (104, 0.99)):
        docs = spark.createDataFrame([(1, " ".join(words[:size])), (2, " ".join(words[: size - 1]))], "doc_id long, text string")
        assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs, 5, least).collect()} == {1: 1, 2: 1}


def test_near_duplicates_against_all_pairs(spark):
    """Of texts that drift from common ones, repeated rows and documents of two texts, under a bound at which registers meet rarely."""
    rng, rows = np.random.default_rng(3), []
    for i in range(120):
        words = [f"g{i % 12}w{j}" for j in range(90)]
        for at in rng.integers(0, 90, int(rng.integers(2, 9))):
            words[at] = f"n{int(rng.integers(1 << 40))}"
        rows.append((i, " ".join(words[: int(rng.integers(60, 91))])))
    rows += [rows[5], rows[5], (7, rows[20][1]), (130, rows[8][1])]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (r[1].split() for r in rows)]
    for least in (0.5, 0.8):
        root = {r[0]: r[0] for r in rows}
        for a, s in zip(rows, sets, strict=True):
            for b, t in zip(rows, sets, strict=True):
                if len(s & t) >= least * len(s | t) and root[a[0]] != root[b[0]]:
                    x, y = sorted((root[a[0]], root[b[0]]))
                    root = {k: x if r == y else r for k, r in root.items()}
        got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, least).collect()}
        assert got == root, least


def test_prob_min_hash_estimates_weighted_similarity():
    key = np.arange(1, 301, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b = slice(0, 200), slice(100, 300)
    row = np.repeat([0, 1], 200)
    owner = near_dedup.prob_min_hash(row, np.concatenate([key[a], key[b]]), np.ones(400), 2, 1024)
    assert abs((owner[0] == owner[1]).mean() - 1 / 3) < 0.06


def test_stars_stop_once_every_node_hangs_on_its_root(spark, monkeypatch):
    made = []
    monkeypatch.setattr(steps, "staged", lambda df, name: made.append(name) or staged(df, name))
    for edges, rounds in (([(i, 0) for i in range(1, 40)] + [(0, 7), (50, 41)], 0), ([(9, 1), (9, 2), (9, 3)], 1)):
        made.clear()
        got = {(r.u, r.v) for r in steps.stars(spark.createDataFrame(edges, "u long, v long")).collect()}
        root = {0: {(i, 0) for i in range(1, 40)} | {(50, 41)}, 1: {(2, 1), (3, 1), (9, 1)}}[rounds]
        assert got == root and made == ["edges"] + ["stars"] * rounds


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_warc_round_trip(spark):
    rows = [(1, "http://a/\r\nb", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://c", None), (4, "u", ""), (5, "u", "WARC/1.1\r\n\r\n\r\n\r\nContent-Length: 3"), (6, "u", "ü" * 100000), (None, "n", "<p>x</p>")]
    path = new_path(spark, "t-warc")
    warc.write_archives(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int"), path)
    records = warc.read_archives(spark, path).collect()
    by = {r.page_id: r for r in records}
    assert len(records) == 7
    assert bytes(by[5].payload).decode() == rows[4][2] and bytes(by[6].payload).decode() == rows[5][2]
    assert by[1].record_type == "revisit" and by[2].record_type == "response" and by[1].refers_to == by[2].record_id
    assert by[3].record_type == "revisit" and by[4].record_type == "response" and by[None].record_type == "response"
    assert by[2].digest == base64.b32encode(hashlib.sha1(b"<p>x</p>").digest()).decode()
    members = 0
    for name in glob.glob(f"{path.removeprefix('file://')}/part-*"):
        data = open(name, "rb").read()
        for record in warc._records(data):
            members += 1
            assert record.startswith(b"WARC/1.1\r\n") and record.count(b"WARC-Record-ID") == 1
        assert gzip.decompress(data).count(b"WARC-Record-ID") == sum(1 for _ in warc._records(data))
    assert members == 7
    empty_path = new_path(spark, "t-warc")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), empty_path)
    assert warc.read_archives(spark, empty_path).count() == 0


def test_warc_of_one_page_with_several_payloads_and_repeats(spark):
    rows = [(5, "A"), (5, "B"), (9, "A"), (9, "B"), (9, "B"), (2, "B")]
    path = new_path(spark, "t-warc")
    warc.write_archives(spark.createDataFrame([(p, "u", h) for p, h in rows], "page_id long, url string, html string"), path)
    records = warc.read_archives(spark, path).withColumn("payload_bytes", F.octet_length("payload")).withColumn("payload_digest", warc.base32_sha1(F.col("payload")))
    digest = {h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode() for h in "AB"}
    got = sorted((r.page_id, r.payload_digest, r.record_type, r.refers_to or 0) for r in warc.resolved(records).collect())
    assert got == sorted((p, digest[h], "response" if p == 9 else "revisit", 0 if p == 9 else 9) for p, h in rows)


def test_warc_members_end_in_zero():
    for data in (b"", b"x" * 1000, os.urandom(17 << 20)):
        (batch,) = warc._members([pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["record"])])
        assert gzip.decompress(batch.column(0)[0].as_py() + b"\0") == data


def test_media(docs, empty):
    stored = media.features(media.encode(docs.union(docs.where("doc_id = 1"))))
    got = {r.doc_id: r for r in stored.collect()}
    told = {r.doc_id: r for r in media.described(stored).collect()}
    for i, t in texts().items():
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = told[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_sha256 == hashlib.sha256(media.wav(payload)).hexdigest()
        mel, energy = mel_of(payload)
        table = media.read_tensors(bytes(got[i].tensors))
        flat = table.column("log_mel").combine_chunks().storage.flatten().to_numpy().reshape(-1, media.BANDS)[: got[i].frames]
        assert got[i].frames == len(mel) and np.abs(flat - mel).max() < 0.02
        runs = runs_of(energy)
        step = 1000 * media.HOP * 1.5 / media.RATE
        assert [(round(s.start_ms / step), round(s.end_ms / step)) for s in got[i].segments] == runs
        assert r.feature.startswith(f"{len(mel)}x{media.BANDS}/{len(runs)}/")
    assert told[1].feature == told[2].feature != told[3].feature
    assert media.read_tensors(bytes(got[1].tensors)).schema.field("log_mel").type.shape == [media.PATCH, media.BANDS]
    assert media.described(media.features(media.encode(empty))).count() == 0


def mel_of(payload):
    """Log-mel frames and energies by plain sums: zeros put in, low-pass by convolution, every third sample kept, one transform a frame."""
    x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    wide = np.zeros(len(x) * media.UP)
    wide[:: media.UP] = x
    y = np.convolve(wide, media._PHASES.T.ravel())[: len(wide)][:: media.DOWN]
    mels, energies = [], []
    for lo in range(0, len(y) - media.FRAME + 1, media.HOP):
        f = y[lo : lo + media.FRAME]
        bins = np.array([abs(sum(f * media._WINDOW * np.exp(-2j * np.pi * k * np.arange(media.FRAME) / media.FFT))) ** 2 for k in range(media.FFT // 2 + 1)])
        mels.append(np.log(bins @ media._MEL + 1e-6))
        energies.append(10 * np.log10(np.mean(f * f) + 1e-9))
        if len(mels) >= 40:
            rest = [y[a : a + media.FRAME] for a in range(lo + media.HOP, len(y) - media.FRAME + 1, media.HOP)]
            mels += [np.log(np.abs(np.fft.rfft(r * media._WINDOW, media.FFT)) ** 2 @ media._MEL + 1e-6) for r in rest]
            energies += [10 * np.log10(np.mean(r * r) + 1e-9) for r in rest]
            break
    return np.array(mels), np.array(energies)


def runs_of(energy):
    level, out, first, high = np.round(energy - np.median(energy), 6), [], None, False
    for i, v in enumerate([*level, -99.0]):
        if v > media.STAY_DB:
            first, high = (i if first is None else first), high or v > media.OPEN_DB
        elif first is not None:
            out += [(first, i)] if high else []
            first, high = None, False
    return out


def test_long_signals_in_stretches():
    samples = np.random.default_rng(1).integers(0, 256, 576 * 40).astype(np.uint8)
    whole, parts = media.analysed(samples, 1 << 30), media.analysed(samples, 300)
    assert np.allclose(whole[0], parts[0]) and np.allclose(whole[1], parts[1])


def test_resampling_keeps_a_tone():
    t = np.arange(3000) / media.RATE
    y = media.resample(np.sin(2 * np.pi * 500 * t))
    assert abs(np.argmax(np.abs(np.fft.rfft(y))) * media.RATE * 2 / 3 / len(y) - 500) < 8


@pytest.mark.parametrize("n", [1, 2, 7, 100, 1001])
def test_feistel_is_a_permutation(n):
    assert sorted(sharding.permute(np.arange(n), n, 5)) == list(range(n))


def test_sharding(docs, empty):
    got = sharding.shard_rows(docs.union(docs.where("doc_id = 1")), 5).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == 13 and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    again = sharding.shard_rows(docs.union(docs.where("doc_id = 1")).repartition(3), 5).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in got) == sorted((r.doc_id, r.shard, r.slot) for r in again)
    assert sharding.shard_rows(empty, 5).count() == 0
    assert docs.select(text_bytes("text").alias("n")).where("n is null").count() == 0


def test_sharding_with_other_names_and_without_ids(spark):
    names = ["_hash", "_block", "_at", "_row", "_rows", "_offset", "shard", "slot", "a.b", "r", "n", "part", "number"]
    rows = spark.createDataFrame([(None if i % 3 else i, *range(len(names))) for i in range(50)], ", ".join(["doc_id long", *(f"`{n}` int" for n in names)]))
    got = sharding.shard_rows(rows, 4)
    assert sorted(got.columns) == sorted(rows.columns)
    found = got.collect()
    assert all(r["_rows"] == 4 and r["a.b"] == 8 and r["number"] == 12 for r in found)
    sizes = Counter(r.shard for r in found)
    assert sum(sizes.values()) == 50 and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in found if r.shard == k) == list(range(n)) for k, n in sizes.items())


def test_decontamination(spark, docs, empty):
    item = "The quick brown fox jumps over the lazy dog and then sleeps under the old oak tree by the river bank"
    bench = spark.createDataFrame([(1, item, 9), (2, None, 9), (3, "short", 9), (4, item, 9)], "item_id long, text string, doc_id long")
    typo = item.replace("jumps", "jumpz").replace("sleeps", "sleps").upper()
    more = spark.createDataFrame([(100, "x y z\n" + item.replace(" ", "\n ") + " tail"), (101, "lead " + typo), (102, item[:50]), (103, None), (104, "")], "doc_id long, text string")
    got = decontaminate.leaks(more.unionByName(docs.select("doc_id", "text")), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.edits) for r in got) == [(100, 1, 0), (100, 4, 0), (101, 1, 2), (101, 4, 2)]
    assert {r.doc_id for r in decontaminate.decontaminated(more, bench).collect()} == {102, 103, 104}
    assert decontaminate.leaks(empty, bench).count() == 0
    assert decontaminate.leaks(more, bench.limit(0)).count() == 0


def test_reading_archives_is_linear():
    members = b"".join(gzip.compress(f"WARC/1.1 {i}".encode()) for i in range(64_000))
    began = time.process_time()
    assert [int(m.split()[1]) for m in warc._records(members)] == list(range(64_000))
    assert time.process_time() - began < 10
    assert list(warc._records(gzip.compress(b"x" * 3_000_000) + gzip.compress(b"") + gzip.compress(b"y"))) == [b"x" * 3_000_000, b"y"]


def test_alignment_equals_full_dynamic_programme():
    rng = np.random.default_rng(3)
    for _ in range(20):
        item = "".join(rng.choice(list("abcd"), 60))
        text = list("".join(rng.choice(list("abcd"), 20)) + item + "".join(rng.choice(list("abcd"), 20)))
        for _ in range(4):
            p = rng.integers(20, len(text) - 20)
            text[p] = "ab"[rng.integers(2)] * int(rng.integers(0, 3))
        text = "".join(text)
        edits, start, end = decontaminate.align([decontaminate.points(text)], [decontaminate.points(item)], np.array([16]), np.array([8]))
        assert edits[0] == least_edits(text, item) == distance(text[start[0] : end[0]], item)


def least_edits(text, item):
    """Of the best passage of the text."""
    row = [0] * (len(text) + 1)
    for a in item:
        new = [row[0] + 1]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def distance(a, b):
    row = list(range(len(a) + 1))
    for x in b:
        new = [row[0] + 1]
        for j, y in enumerate(a, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def every_passage(text, item):
    """(edits, start, end): for each end the best passage within the budget, then those that no better one overlaps."""
    budget, n = int(len(item) * 0.1 + 1e-9), len(text)
    row = [(0, -j) for j in range(n + 1)]  # edits, then the latest start
    for i, a in enumerate(item, 1):
        new = [(i, 0)]
        for j, b in enumerate(text, 1):
            new.append(min((row[j - 1][0] + (a != b), row[j - 1][1]), (row[j][0] + 1, row[j][1]), (new[-1][0] + 1, new[-1][1])))
        row = new
    kept = []
    for edits, size, start, end in sorted((e, j + s, -s, j) for j, (e, s) in enumerate(row) if e <= budget and j + s > 0):
        if all(end <= a or start >= b for _, a, b in kept):
            kept.append((edits, start, end))
    return sorted(kept)


def test_every_passage_is_told(spark):
    rng = np.random.default_rng(11)
    items = {1: "a", 2: "aa", 3: "=" * 20, 4: "abcabcabcabcabcabcabcabc", 5: "no such text anywhere at all"}
    texts = {1: "aaaa", 2: "=" * 100, 3: "abc" * 40, 4: "aab" * 9 + "=" * 41, 5: "abcabcabxabcabcabcabcabc " * 4, 6: "".join(rng.choice(list("abc="), 300)), 7: "abc" * 7 + "x" + "abc" * 9}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = decontaminate.leaks(docs, spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    found = sorted((r.doc_id, r.item_id, r.edits, r.start, r.end) for r in got)
    assert found == sorted((d, i, *f) for d, t in texts.items() for i, item in items.items() for f in every_passage(decontaminate.clean(t), item))
    assert sum((r.doc_id, r.item_id) == (1, 1) for r in got) == 4 and sum((r.doc_id, r.item_id) == (2, 3) for r in got) == 5


def test_padded_items_are_as_short_as_they_are(spark):
    docs = spark.createDataFrame([(1, "a cat"), (2, "an answer")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "       a   "), (2, "an      answer")], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.decontaminated(docs, items).collect()] == [1]


def test_leaks_equal_brute_force(spark):
    """Items of all lengths and scripts, whole, with edits, several times, and with too many edits."""
    rng = np.random.default_rng(5)
    han = [chr(0x4E00 + int(i)) for i in rng.integers(0, 3000, 400)]
    items = {1: "yes", 2: "hello", 3: "ab cd ef gh", 4: "the quick brown fox jumps", 5: "".join(han[:40]), 6: "".join(han[100:112]), 7: " ", 8: "Ünïcode ßtring of some length here", 9: "aaaaaaaaaaaaaaaaaaaa"}

    def edited(t, k):
        t = list(t)
        for p in rng.choice(len(t), k, replace=False):
            t[p] = ["", "x", t[p] + "q"][rng.integers(3)]
        return "".join(t)

    texts, cleaned = {}, {i: decontaminate.clean(t) for i, t in items.items()}
    for n in range(60):
        parts = []
        for _ in range(3):
            i = int(rng.choice([2, 3, 4, 5, 6, 8, 9]))
            k = int(rng.integers(0, len(items[i]) // 10 + 2))
            parts += ["".join(rng.choice(list("zwvuk "), 30)), edited(items[i], min(k, 3))]
        texts[n] = " ".join(parts)
    texts |= {100: None, 101: "", 102: "a" * 3000, 103: "hello hello", 104: "".join(han) * 3}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = decontaminate.leaks(docs, spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    want = {(d, i) for d, t in texts.items() for i, item in cleaned.items() if item and least_edits(decontaminate.clean(t or ""), item) <= int(len(item) * 0.1 + 1e-9)}
    assert found == want
    for r in got:
        assert distance(decontaminate.clean(texts[r.doc_id])[r.start : r.end], cleaned[r.item_id]) == r.edits
    for key in {(r.doc_id, r.item_id) for r in got}:
        spans = sorted((r.start, r.end) for r in got if (r.doc_id, r.item_id) == key)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    whole = sorted((r.doc_id, r.item_id, r.edits, r.start, r.end) for r in got)
    assert whole == sorted((d, i, *f) for d, t in texts.items() for i, item in cleaned.items() if item for f in every_passage(decontaminate.clean(t or ""), item))
    assert sorted((r.start, r.end) for r in got if (r.doc_id, r.item_id) == (103, 2)) == [(0, 5), (6, 11)]
    assert sum((r.doc_id, r.item_id) == (104, 5) for r in got) == 3


def test_decontamination_of_one_script_stays_small():
    """6,000 characters outside Latin-1 against 200 items of 300: shared grams are few."""
    rng = np.random.default_rng(2)
    han = lambda n: "".join(chr(0x4E00 + int(i)) for i in rng.integers(0, 5000, n))
    index = decontaminate.Index([(i, han(300)) for i in range(200)], 0.1)
    text = decontaminate.points(han(6000) + index.texts[7])
    row, item, _ = index.bands(np.append(text, 0).astype(np.uint32), np.array([0, len(text) + 1]))
    assert set(item.tolist()) == {7} and set(row.tolist()) == {0}


def test_a_deleted_word_does_not_shift_the_start(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs = spark.createDataFrame([(1, "xx " + item.replace("two ", ""))], "doc_id long, text string")
    r = decontaminate.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).first()
    assert (r.edits, r.start) == (4, 3)


def check_schedule(got, epochs, limit):
    """The scheduled rows against sums, weights and cuts reckoned one by one."""
    tokens, docs = Counter(), Counter()
    for r in got:
        tokens[r.source] += r.tokens
        docs[r.source] += 1
    some = {s: n for s, n in tokens.items() if n}
    share = lambda e: {s: n**e / sum(x**e for x in some.values()) for s, n in some.items()}

    def repeats(e):
        w = share(e)
        budget = epochs * sum(some.values()) if epochs else max(n / w[s] for s, n in some.items())
        return max(w[s] * budget / n for s, n in some.items()), budget

    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if repeats(mid)[0] <= limit else (mid, high)
    e = 0.0 if repeats(0.0)[0] <= limit else high
    budget = repeats(e)[1]
    for s in tokens:
        mine = sorted((r for r in got if r.source == s), key=lambda r: (r.block, r.place))
        assert len({r.block for r in mine}) <= max(1, math.isqrt(docs[s])) and all(0 <= r.block < max(1, math.isqrt(docs[s])) for r in mine)
        if not tokens[s]:
            assert all(r.copies == 1 for r in mine)
            continue
        spent = sum(r.copies * r.tokens for r in mine)
        assert -1.5 <= spent - share(e)[s] * budget <= max(r.tokens for r in mine) + 1, s
        copies = [r.copies for r in mine]
        assert copies == sorted(copies, reverse=True) and copies[0] - copies[-1] <= 1
        last = [r for r in mine if r.copies == copies[0]]
        if copies[0] > copies[-1]:
            # without its last document with tokens the last pass would fall short
            least = spent - next(r.tokens for r in reversed(last) if r.tokens)
            assert least < share(e)[s] * budget + 1
    return budget


def test_mixing(spark, empty):
    rows = [(i, f"word{i} " * (i % 7 + 1), "big" if i < 300 else f"s{i % 3}") for i in range(400)] + [(1000, None, None), (1001, "x", None), (1002, "", "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for epochs in (None, 1.0, 2.5, 0.3):
        counted = mixing.counted(docs)
        got = mixing.schedule(counted, mixing.plan(counted, 1.6, epochs=epochs)).collect()
        assert len(got) == len(rows) and sum(r.tokens for r in got) == sum(len((t or "").split()) for _, t, _ in rows)
        check_schedule(got, epochs, 1.6)
        taken = Counter(r.doc_id for r in mixing.mixed(docs, 1.6, epochs=epochs).collect())
        assert taken == Counter({r.doc_id: r.copies for r in got if r.copies})
        if epochs is None:
            assert min(r.copies for r in got) == 1
    assert mixing.mixed(empty).count() == 0
    two = spark.createDataFrame([("a", 90), ("b", 10)], "source string, tokens long")
    e = mixing.bisect_exponent(mixing.fitting(two, 0.5, None, None))
    w = 90**e / (90**e + 10**e)
    assert abs(-w * math.log(w) - (1 - w) * math.log(1 - w) - 0.5) < 1e-6


def test_mixing_with_other_names(spark):
    names = ["_source", "_hash", "_block", "copies", "a.b", "block", "place", "passes", "r", "tokens"]
    rows = spark.createDataFrame([(i % 5, "x y", "s", *range(len(names))) for i in range(10)], ", ".join(["doc_id long", "text string", "source string", *(f"`{n}` int" for n in names)]))
    got = mixing.mixed(rows)
    assert got.columns == rows.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))


def test_chat_round_trip(spark):
    nasty = "␛0 <|turn|>user\n<|end|>\n</s>[INST] ok [/INST] <<SYS>> ␛a <|> "
    rows = [(1, 0, "user", nasty), (1, 1, "assistant", nasty), (1, 1, "assistant", nasty), (2, None, None, None), (2, 0, "ass\nistant", "x"), (3, 0, "assistant", "ü" * 50000), (None, 0, "user", ""), (None, 0, "user", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", chat_format.typed_parts(F.col("text")).alias("parts"))
    done = chat_format.format_chats(turns)
    media = F.col("attachments")
    got = {r.conv_id: r for r in done.select("conv_id", "formatted", chat_format.read_back(F.col("formatted"), media).alias("turns"), chat_format.loss_text(F.col("formatted"), F.col("loss"), media).alias("learned")).collect()}
    assert done.where("conv_id is null").count() == 2
    assert [(t.role, t.text) for t in got[1].turns] == [("user", nasty), ("assistant", nasty), ("assistant", nasty)] and got[1].learned == nasty * 2
    assert [(t.role, t.text) for t in got[2].turns] == [("", ""), ("ass\nistant", "x")]
    assert got[3].learned == "ü" * 50000 and got[None].learned == ""
    parts = spark.sql(f"select 1L as conv_id, 0L as turn, 'user' as role, from_json('[{{\"kind\":\"text\",\"text\":\"see\"}},{{\"kind\":\"image\",\"ref\":\"a.png\",\"units\":2}},{{\"kind\":\"audio\",\"ref\":\"b.wav\",\"units\":10}}]', '{chat_format.PARTS}') as parts")
    r = chat_format.format_chats(parts).first()
    assert r.formatted == "<|turn|>user\nsee<|image|><|audio|><|end|>\n"
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [("image", "a.png", 512), ("audio", "b.wav", 250)] and r.attachment_tokens == 762


def test_links_become_image_parts_and_come_back(spark):
    said = ["see ![a cat](http://x/a.png) and ![](b) <|image|>", "![x](y)![z](w)", "none ![ ](", ""]
    rows = [(1, i, ["user", "assistant"][i % 2], t) for i, t in enumerate(said)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", chat_format.typed_parts(F.col("text")).alias("parts"))
    done = chat_format.format_chats(turns)
    r = done.select("*", chat_format.read_back(F.col("formatted"), F.col("attachments")).alias("turns"), chat_format.loss_text(F.col("formatted"), F.col("loss"), F.col("attachments")).alias("learned")).first()
    assert [t.text for t in r.turns] == said and r.learned == said[1] + said[3]
    assert [(a.turn, a.kind, a.ref, a.tokens) for a in r.attachments] == [(0, "image", "![a cat](http://x/a.png)", 256), (0, "image", "![](b)", 256), (1, "image", "![x](y)", 256), (1, "image", "![z](w)", 256)]
    assert r.attachment_tokens == 1024 and r.formatted.count("<|image|>") == 4


def test_suffix_lm(docs, empty):
    both = docs.union(docs.where("doc_id = 1"))
    got = suffix_lm.scores(both).collect()
    assert len(got) == 13
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    rows = [*texts().items(), (1, texts()[1])]
    held = {i for i in texts() if zlib.crc32(str(i).encode()) % 7 == 2}
    count, ends = Counter(), 0
    for i, t in rows:
        if i not in held:
            count.update((t or "").encode().translate(lower).split())
            ends += 1
    n, v = sum(count.values()) + ends, len(count) + 1
    for r in got:
        words = (texts()[r.doc_id] or "").encode().translate(lower).split()
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words) + math.log10((ends + 1) / (n + v + 1))
        assert r.held_out == (r.doc_id in held) and r.train_tokens == n and r.n_tokens == len(words) + 1
        assert r.n_known == sum(count[w] > 0 for w in words) + 1
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
        assert r.score < 0
    assert suffix_lm.scores(empty).count() == 0


def suffix_scores(learnt, asked, depth):
    """log10 scores of texts by a suffix tree of the learnt texts, context by context."""
    sequence = lambda t: ["<", *(t or "").translate({i: i + 32 for i in range(65, 91)}).encode().split(), ">"]
    count = Counter()
    for t in learnt:
        s = sequence(t)
        for i in range(len(s)):
            for k in range(1, min(depth + 1, i + 1) + 1):
                count[tuple(s[i - k + 1 : i + 1])] += 1
    words = {g[0]: n for g, n in count.items() if len(g) == 1 and g[0] != "<"}
    total, once = sum(words.values()), sum(n == 1 for n in words.values())
    unseen = (once + 1) / (total + 2)
    following = {}
    for g, n in count.items():
        if len(g) > 1 and n > 1:
            following.setdefault(g[:-1], []).append(n)
    root = sum(n * (n - 1) for n in words.values()) / (total * (total - 1)) if total > 1 else 0.0
    coincide = lambda c: sum(n * (n - 1) / 2 for n in following.get(c, ()))
    out = []
    for t in asked:
        s, score = sequence(t), 0.0
        for i in range(1, len(s)):
            p = (1 - unseen) * words[s[i]] / total if s[i] in words else unseen
            rate = root
            for k in range(1, min(depth, i) + 1):
                c = tuple(s[i - k : i])
                n, repeats = count[c], following.get(c, ())
                # a context of several words counts for its own suffix only where it repeats itself
                n = n if k == 1 or n > 1 else 0
                room = n * (n - 1) / 2
                if repeats and coincide(c) > room * rate + suffix_lm.SIGNIFICANCE * math.sqrt(room * rate):
                    seen = count[(*c, s[i])]
                    p = max(0, (seen - suffix_lm.DISCOUNT) / n if seen > 1 else 0) + (suffix_lm.DISCOUNT * len(repeats) + n - sum(repeats)) / n * p
                rate = coincide(c) / room if room else 0.0
            score += math.log10(p)
        out.append(score)
    return out


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_suffix_lm_equals_brute_force(spark, monkeypatch, depth):
    """Several chunks and groups, with contexts that are split among groups, empty texts and copies."""
    monkeypatch.setattr(suffix_lm, "DEALT", 900)
    monkeypatch.setattr(suffix_lm, "GROUPED", 700)
    some = texts() | {i: f"The cat {i * 37 % 11} sat on the mat w{i}x " * (i % 4 + 1) for i in range(20, 90)} | {i: [None, "", " \n "][i % 3] for i in range(90, 120)} | {200: some_text(), 201: some_text(), 202: some_text() + " end"}
    got = suffix_lm.scores(spark.createDataFrame(list(some.items()), "doc_id long, text string").repartition(3), depth).collect()
    held = {r.doc_id for r in got if r.held_out}
    assert 0 < len(held) < len(some) == len(got)
    want = dict(zip(some, suffix_scores([t for i, t in some.items() if i not in held], some.values(), depth), strict=True))
    for r in got:
        assert abs(r.score - want[r.doc_id]) < 1e-6 * max(1, abs(r.score)), r.doc_id


def some_text():
    return " ".join(f"q{(i * i) % 97}" for i in range(80))


def test_suffix_tree_keeps_its_contexts_as_the_corpus_grows(spark):
    told = "zab three qab one zab three qab one"
    few = [(i, told) for i in range(40)]
    more = [(i, f"other words {i % 97} come along {i % 89} here") for i in range(100, 3000)]
    scores = [{r.doc_id: r.score for r in suffix_lm.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}[2] for rows in (few, few + more)]
    assert scores[1] > scores[0] - 9 * 0.7 and scores[1] > -6


def test_suffix_lm_beats_its_base_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    r = suffix_lm.scores(docs).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert r.s / r.n > r.b / r.n + 0.3


def test_language_id(spark, empty):
    en, fr = "the cat and the dog are in the house with that man", "le chat et le chien sont dans la maison avec cet homme"
    rows = [(i, (en if i % 2 else fr) + f" {i}", "en" if i % 2 else "fr") for i in range(40)] + [(50, None, "en"), (51, "12 34 !", "fr"), (52, "", None), (53, "THE DOG AND THE MAN", None), (54, "x" * 5000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    pieces = language_id.vocabulary(queries.vocabulary_path())
    langs, probs = language_id.fit(docs, pieces)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, langs, probs, pieces).collect()}
    assert all(got[i][0] == ("en" if i % 2 else "fr") for i in range(40)) and got[53][0] == "en"
    assert [got[i][0] for i in (50, 51, 52)] == ["und"] * 3 and all(0 <= s <= 1 for _, s in got.values())
    assert {r.doc_id for r in language_id.accepted(docs, langs, probs, pieces).collect()} == {*range(40), 53}
    other = spark.createDataFrame([(60, "漢字假名" * 50, None), (61, "chat", None)], docs.schema)
    assert {r.doc_id for r in language_id.accepted(other, langs, probs, pieces).collect()} == {61}
    assert language_id.fit(empty, pieces)[0] == [] and language_id.predict(docs, [], np.zeros((len(pieces), 0)), pieces).where("lang_pred = 'und'").count() == 45


def test_forward_and_training_sum_over_all_segmentations():
    pieces = [bytes([b]) for b in range(256)] + [b"ab", b"bc", b"abc", b" a"]
    rng = np.random.default_rng(1)
    p = rng.random((len(pieces), 2))
    ids = {w: i for i, w in enumerate(pieces)}

    def segmentations(s):
        return [[]] if not s else [[s[:k], *rest] for k in range(1, 4) if s[:k] in ids and k <= len(s) for rest in segmentations(s[k:])]

    words, table = [b" abcab", b" a", b" bcabcabc", b"abc"], language_id.Pieces(pieces)
    got = language_id.forward(table, language_id.Words(words), np.log(p))
    counts = np.zeros(len(pieces))
    for w, g in zip(words, got, strict=True):
        each = {tuple(s): np.prod([p[ids[x]] for x in s], axis=0) for s in segmentations(w)}
        total = sum(each.values())
        assert np.allclose(g, np.log(total))
        for s, v in each.items():
            for x in s:
                counts[ids[x]] += 3 * v[0] / total[0]
    own = language_id.Words(words)
    assert np.allclose(language_id.expected(*table.edges(own, 0, int(own.size[-1])), own.size, np.log(p[:, 0]), np.full(len(words), 3.0)), counts)


def test_a_word_of_ten_thousand_bytes_is_read_whole(monkeypatch):
    """A word without spaces, in slabs and at once, against the plain forward algorithm; what stands at its end counts."""
    pieces = [bytes([b]) for b in range(256)] + [b"ab", b"bca", b"cab", "漢字".encode()]
    p = np.random.default_rng(4).random((len(pieces), 2))
    p /= p.sum(0)
    word = (b"abcabca" * 1000 + "漢字假名".encode() * 250)[:10000]
    table = language_id.Pieces(pieces)
    once = language_id.forward(table, language_id.Words([word, b"ab"]), np.log(p))
    monkeypatch.setattr(language_id, "SLAB", 64)
    slabs = language_id.forward(table, language_id.Words([word, b"ab"]), np.log(p))
    ids, alpha = {w: i for i, w in enumerate(pieces)}, [np.zeros(2)]
    for e in range(1, len(word) + 1):
        alpha.append(np.logaddexp.reduce([alpha[e - k] + np.log(p[ids[word[e - k : e]]]) for k in range(1, min(e, 6) + 1) if word[e - k : e] in ids]))
    assert np.allclose(once[0], alpha[-1]) and np.allclose(once, slabs)
    other = language_id.forward(table, language_id.Words([word[:-4] + b"zzzz"]), np.log(p))
    assert not np.allclose(other[0], once[0])


def test_language_samples_without_ids_are_even(spark):
    rows = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("the cat number "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    langs, probs = language_id.fit(rows, language_id.vocabulary(queries.vocabulary_path()), max_docs=300)
    assert langs == ["en"] and np.isclose(probs.sum(), 1)
