"""Every op query, and the pipeline, over small whole tables: against their SQL, or against brute force."""

import hashlib
import importlib.util
import math
import random
import tempfile
import zlib
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from loomgraph.llm import decontaminate, mixing, queries, sharding

DATA = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"


def word(rng):
    return "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7)))


@pytest.fixture(scope="module")
def made(spark):
    """Documents with copies, near copies, leaks, junk, nulls and a hot source; a benchmark; a few conversations."""
    rng = random.Random(3)
    speech = {"en": ["the", "and", "of", "to", "is"], "fr": ["le", "et", "une", "dans", "est"]}
    vocabulary = {lang: [word(rng) + lang for _ in range(300)] for lang in speech}

    def text(lang, n):
        return " ".join(rng.choice(speech[lang]) if rng.random() < 0.4 else rng.choice(vocabulary[lang]) for _ in range(n))

    bench = {i: text("en", 40) for i in range(4)}
    rows = {}
    for i in range(120):
        lang = ["en", "fr"][i % 2]
        rows[i] = (text(lang, rng.randint(30, 120)), lang if i % 5 else None, "hot" if i % 3 else f"s{i % 7}")
    for i, of in ((200, 5), (201, 5), (202, 9)):
        rows[i] = (rows[of][0], "en", "hot")
    near = rows[11][0].split()
    rows[203] = (" ".join([*near[:3], "changed", *near[4:]]), "fr", "s1")
    rows[204] = (rows[20][0] + " " + bench[1] + " tail", "en", "hot")
    rows[205] = (bench[2].upper().replace(" ", "\n", 3), "en", "hot")
    rows |= {206: (None, None, None), 207: ("", "en", "hot"), 208: ("12 34 ...", "en", "hot"), 209: (text("fr", 4000), "fr", "hot")}
    path = tempfile.mkdtemp(prefix="spark-made-")
    spark.createDataFrame([(i, *r, len(r[0] or "")) for i, r in rows.items()], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(bench.items()), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, bench


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
@pytest.mark.parametrize("data", [DATA, SMALL])
def test_query_equals_its_sql(spark, name, data):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    got = queries.queries()[name](spark, data)
    want = con.execute(queries.oracle_sql()[name]).fetchall()
    columns = [d[0] for d in con.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, want))


def test_thirteen_queries_are_registered():
    names = __spark_entry__.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14)) and "pipeline" in names


def test_media_query(spark, made):
    path, rows, _ = made
    got = {r.doc_id: r for r in queries.op2_media(spark, path).collect()}
    assert set(got) == set(rows)
    for i, (t, *_) in rows.items():
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (got[i].payload_sha256, got[i].tail_crc32, got[i].payload_bytes) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(payload))
    assert got[5].feature == got[200].feature


def leaked(rows, bench):
    return {i for i, (t, *_) in rows.items() for b in bench.values() if decontaminate.clean(b) in decontaminate.clean(t or "")}


def test_decontamination_query(spark, made):
    path, rows, bench = made
    got = queries.op4_decontaminate(spark, path).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(204, 1), (205, 2)} and {r.doc_id for r in got} == leaked(rows, bench)


def test_mixing_query(spark, made):
    from test_llm import check_schedule

    path, rows, _ = made
    got = queries.op6_mixing(spark, path).collect()
    assert {r.doc_id: (r.source, r.tokens) for r in got} == {i: (s or "", len((t or "").split())) for i, (t, _, s) in rows.items()}
    check_schedule(got, 1.0, 2.0)


def classes(rows):
    """Components of the pairs of at least 0.8 Jaccard similarity of five-word shingles."""
    sets = {}
    for i, t in rows.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in rows}
    for i in rows:
        for j in rows:
            if i < j and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()}
    return root


def test_near_duplicate_query(spark, made):
    path, rows, _ = made
    got = {r.doc_id: (r.class_id, r.class_size) for r in queries.op8_near_duplicates(spark, path).collect()}
    want = classes({i: r[0] for i, r in rows.items()})
    size = Counter(want.values())
    assert got == {i: (c, size[c]) for i, c in want.items()}


def test_recall_of_near_duplicates(spark):
    """Every document against all rows: at least nine in ten links are kept, and no class is joined without them."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r.doc_id: r.class_id for r in queries.op8_near_duplicates(spark, SMALL).collect()}
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := (t or "").lower().split()) else frozenset() for i, t in docs.items()}
    kept = links = 0
    for i in docs:
        if sets[i]:
            for j in docs:
                if i != j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    links, kept = links + 1, kept + (got[i] == got[j])
    assert links > 100 and kept >= 0.9 * links
    want = classes({i: t for i, t in docs.items() if Counter(got.values())[got[i]] > 1})
    assert all(len({want[i] for i in docs if got[i] == c}) == 1 for c, n in Counter(got.values()).items() if n > 1)


def test_language_query(spark, made):
    path, rows, _ = made
    got = {r.doc_id: r for r in queries.op10_language(spark, path).collect()}
    for i, (t, *_) in rows.items():
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i].score <= 1
        if i in (206, 207, 208):
            assert got[i].lang_pred == "und"
        elif i < 120:
            assert got[i].lang_pred == ["en", "fr"][i % 2], i


def test_suffix_query(spark, made):
    from test_llm import suffix_scores

    path, rows, _ = made
    got = {r.doc_id: r for r in queries.op9_suffix_lm(spark, path).collect()}
    learnt = [t for i, (t, *_) in rows.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    want = dict(zip(rows, suffix_scores(learnt, [t for t, *_ in rows.values()], 2), strict=True))
    assert all(abs(got[i].score - want[i]) < 1e-6 * abs(want[i]) for i in rows)


def check_pipeline(got, rows, bench):
    letters = {i: r for i, r in rows.items() if any(c.isalpha() for c in r[0] or "")}
    root = classes({i: r[0] for i, r in letters.items()})
    kept = {i: r for i, r in letters.items() if root[i] == i}
    clean = {i: r for i, r in kept.items() if i not in leaked(kept, bench)}
    tokens = Counter()
    for t, _, s in clean.values():
        tokens[s or ""] += len(t.split())
    # with no budget the largest source is taken once, and none more than twice
    ratio = max(tokens.values()) / min(tokens.values())
    e = max(0.0, 1 - math.log(2) / math.log(ratio)) if ratio > 1 else 0.0
    aim = {s: round(n**e * max(tokens.values()) ** (1 - e)) for s, n in tokens.items()}
    taken = Counter(r.doc_id for r in got)
    assert set(taken) == set(clean)
    for s, n in tokens.items():
        spent = sum(taken[i] * len(t.split()) for i, (t, _, source) in clean.items() if (source or "") == s)
        most = max(len(t.split()) for t, _, source in clean.values() if (source or "") == s)
        assert all(taken[i] in (max(1, (aim[s] + 1) // n), (aim[s] + 1) // n + 1) for i, r in clean.items() if (r[2] or "") == s)
        assert aim[s] - 2 <= spent <= aim[s] + most + 1, s
    for r in got:
        assert (r.text, r.lang, r.source) == clean[r.doc_id]
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and sum(sizes.values()) == len(got)
    for k, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == k) == list(range(n))
    # the permutation of the rows in the order of the hashes of their keys
    order = sorted(got, key=lambda r: (hashlib.md5(str(r.doc_id).encode()).hexdigest(), r.doc_id))
    at = sharding.permute(range(len(order)), len(order), 1)
    want = Counter((r.doc_id, int(p % 40), int(p // 40)) for r, p in zip(order, at, strict=True))
    assert want == Counter((r.doc_id, r.shard, r.slot) for r in got)


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline here")
def test_pipeline_equals_brute_force(spark, made):
    import corpus_pipeline

    path, rows, bench = made
    got = corpus_pipeline.run(spark, path).collect()
    check_pipeline(got, rows, bench)
    assert [s for s, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "mixing", "sharding"]


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline here")
def test_pipeline_of_an_empty_table(spark, made):
    import corpus_pipeline

    path, empty = made[0], tempfile.mkdtemp(prefix="spark-empty-")
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{path}/benchmark.parquet").limit(0).write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
    for name in ("op2_media", "op3_sharding", "op4_decontaminate", "op6_mixing", "op7_substring", "op8_near_duplicates", "op9_suffix_lm", "op10_language", "op11_run_index", "op12_source_audit", "op13_search"):
        assert queries.queries()[name](spark, empty).count() == 0, name
    assert mixing.mixed(spark.read.parquet(f"{empty}/documents.parquet")).count() == 0
