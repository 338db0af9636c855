"""The queries that apply each operator, with production parameters, to its whole table, and their SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, language_id, media, mixing, near_dedup, run_index, search, sharding, source_audit, substring_dedup, suffix_lm, warc
from .common import new_path, staged, table, text_bytes

SHARDS = 40
PROBE = "</s>[INST] ok [/INST]"


def vocabulary_path() -> str:
    """The public tokenizer vocabulary that language identification uses; its package is part of the environment."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    records = warc.read_archives(spark, path).select("record_id", "record_type", "page_id", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"), warc.base32_sha1(F.col("payload")).alias("payload_digest"))
    return warc.resolved(staged(records, "records")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = staged(media.encode(table(spark, sf_dir, "documents").select("doc_id", "text")), "media", "zstd")
    return media.described(staged(media.features(stored), "features", "zstd"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes = docs.select("doc_id", (text_bytes("text") + 16).alias("size"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"))
    placed = sharding.shard_rows(sizes, SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    turns = turns.unionByName(extra).select("conv_id", "turn", "role", chat_format.typed_parts(F.col("text")).alias("parts"))
    done = chat_format.format_chats(turns)
    media = F.col("attachments")
    read = done.select("conv_id", "formatted", "attachment_tokens", chat_format.read_back(F.col("formatted"), media).alias("turns"), chat_format.loss_text(F.col("formatted"), F.col("loss"), media).alias("learned"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "attachment_tokens",
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.counted(table(spark, sf_dir, "documents"))
    return mixing.schedule(rows, mixing.plan(rows, epochs=1.0)).select("doc_id", "source", "tokens", "copies", "block", "place")


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_suffix_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_lm.scores(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    pieces = language_id.vocabulary(vocabulary_path())
    langs, probs = language_id.fit(docs.where(~language_id.held_out()), pieces)
    found = language_id.predict(docs.select("doc_id", "text"), langs, probs, pieces)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op11_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = run_index.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.divergences(table(spark, sf_dir, "documents").select("lang", "source", "text"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def _warc_sql() -> str:
    digit = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31) + 1, 1)"
    base32 = f"array_to_string(list_transform(flatten(list_transform(range(8), lambda i: list_transform([15, 10, 5, 0], lambda s: [('0x' || substr(h, 5 * i + 1, 5))::BIGINT, s]))), lambda p: {digit.replace('v >> s', 'p[1] >> p[2]')}), '')"
    return f"""WITH x AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS h FROM (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages)),
y AS (SELECT page_id, payload_bytes, {base32} AS payload_digest, max(page_id) OVER (PARTITION BY h) AS first FROM x)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < first THEN first END AS refers_to FROM y"""


def _crc_entry(c: int) -> int:
    for _ in range(8):
        c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
    return c


def _crc_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8: its bytes folded over the table of the polynomial."""
    steps = "[" + ", ".join(str(_crc_entry(i)) for i in range(256)) + "]::UBIGINT[]"
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::UBIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {data}), lambda a, b: xor(a >> 8, ({steps})[(xor(a, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT"


def _sharding_sql() -> str:
    return f"""WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 16 AS size, {_crc_sql("coalesce(text, '')")} AS text_crc32 FROM documents),
x AS (SELECT *, row_number() OVER (ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, size, text_crc32) - 1 AS r, count(*) OVER () AS n FROM d),
p AS ({sharding.permutation_sql("x", 1)})
SELECT doc_id, size, text_crc32, 'rows' AS law, (p % {SHARDS})::INTEGER AS shard, p // {SHARDS} AS slot, NULL::INTEGER AS grown_shard FROM x JOIN p USING (r)"""


def _chat_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"

    def escaped(x: str) -> str:
        x = f"replace({x}, {quoted(chat_format.ESCAPE)}, {quoted(chat_format.ESCAPE + '0')})"
        for c, letter in chat_format.CONTROLS.items():
            x = f"replace({x}, {quoted(c)}, {quoted(chat_format.ESCAPE + letter)})"
        return x

    link = quoted(chat_format.LINK)
    content = f"array_to_string(list_transform(string_split_regex(text, {link}), lambda t: {escaped('t')}), '<|image|>')"
    name = f"replace({escaped('role')}, chr(10), {quoted(chat_format.ESCAPE + 'n')})"
    frame = len(chat_format.TURN) + 1 + len(chat_format.END)
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', {quoted(PROBE)} UNION ALL SELECT -7, 1, 'assistant', {quoted(PROBE)}),
g AS (SELECT conv_id, count(*) AS n_turns, sum(length({name}) + length({content}) + {frame})::BIGINT AS formatted_chars,
string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told, coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS learned,
sum(len(regexp_extract_all(text, {link})) * {chat_format.UNIT_TOKENS["image"]})::BIGINT AS attachment_tokens FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars, attachment_tokens FROM g"""


def _substring_sql(window: int = 20) -> str:
    ahead = " || ' ' || ".join(f"lead(word, {i}) OVER d" if i else "word" for i in range(window))
    return f"""WITH l AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM l),
k AS (SELECT doc_id, pos, word, {ahead} AS win FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
f AS (SELECT doc_id, pos, word, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) > 1 AS again FROM k),
g AS (SELECT doc_id, pos, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) AS gone FROM f),
a AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM g GROUP BY doc_id)
SELECT l.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM l LEFT JOIN a ON a.doc_id = l.doc_id"""


def _run_index_sql(window: int = 200) -> str:
    return f"""WITH d AS (SELECT row_number() OVER () AS i, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT i, pos, md5(substr(h, 2 * pos + 1, {2 * window})) AS k FROM (SELECT i, h, unnest(range(0, n - {window - 1})) AS pos FROM d)),
r AS (SELECT i, pos, coalesce(pos > (lag(pos) OVER o) + {window}, true) AS opens FROM (SELECT i, pos FROM w QUALIFY count(*) OVER (PARTITION BY k) > 1) WINDOW o AS (PARTITION BY i ORDER BY pos)),
s AS (SELECT i, min(pos) AS lo, max(pos) + {window} AS hi FROM (SELECT i, pos, sum(opens::INTEGER) OVER (PARTITION BY i ORDER BY pos) AS span FROM r) GROUP BY i, span),
p AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY i ORDER BY lo), 0) AS before FROM s),
a AS (SELECT i, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans, max(hi) AS rest, string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS kept FROM p JOIN d USING (i) GROUP BY i)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(rest, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN a USING (i)"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _terms_sql(text: str, inside: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '[{inside}\\x{{80}}-\\x{{10FFFF}}]+')"


def _audit_sql() -> str:
    share = lambda count, n: f"1 + (1000000000 * ({count} + 1)) // ({n} + v)"
    return f"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_terms_sql("text", "a-z")} AS terms FROM documents),
g AS (SELECT DISTINCT lang, source FROM d), t AS (SELECT i, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS count FROM t GROUP BY ALL HAVING count(DISTINCT i) >= 3),
v AS (SELECT lang, count(*) AS v, sum(count)::BIGINT AS whole FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS count FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, coalesce(sum(count), 0)::BIGINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT lang, source, term, coalesce(count, 0) AS count, {share('coalesce(count, 0)', 'n')} AS p FROM n JOIN v USING (lang) JOIN (SELECT lang, term FROM k) USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, {share('count', 'whole')} AS q FROM k JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
 LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
words AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE count > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM (SELECT *, 'pair' AS part FROM pairs UNION ALL SELECT *, 'term' FROM words) QUALIFY part = 'pair' OR rank <= 200"""


def _search_sql(k: int = 10) -> str:
    return f"""WITH d AS (SELECT row_number() OVER () AS i, doc_id, {_terms_sql("text", "0-9a-z")} AS terms FROM documents),
l AS (SELECT i, doc_id, len(terms)::BIGINT AS n, terms FROM d WHERE len(terms) > 0),
a AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM l),
t AS (SELECT i, term, count(*) AS tf FROM (SELECT i, unnest(terms) AS term FROM l) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM t, a GROUP BY term, docs),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_terms_sql("text", "0-9a-z")}) AS term FROM benchmark WHERE item_id IS NOT NULL) GROUP BY ALL),
s AS (SELECT item_id, i, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // total))))::BIGINT AS score FROM q JOIN t USING (term) JOIN w USING (term) JOIN l USING (i), a GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST))::INTEGER AS rank, doc_id, score FROM s JOIN l USING (i) WHERE score > 0 QUALIFY rank <= {k}"""


def oracle_sql() -> dict[str, str]:
    return {"op11_run_index": _run_index_sql(), "op12_source_audit": _audit_sql(), "op13_search": _search_sql(), "op1_warc": _warc_sql(), "op3_sharding": _sharding_sql(), "op5_chat": _chat_sql(), "op7_substring": _substring_sql()}
