"""Chat formatting with typed content parts, in DataFrame functions only.

A turn is a role and ordered parts (kind, text, ref, units). The visitor flattens them: a text part is escaped, an
image, audio or document part becomes its placeholder, and its turn, reference and expanded token count (units times the
tokens a unit takes) are recorded in order. Turns are wrapped as ``<|turn|>role\\ncontent<|end|>\\n``; control strings of
this and other common templates inside texts and roles are escaped reversibly; the loss mask holds the character spans
of assistant contents. Reading back puts the references where the placeholders stand. ``typed_parts`` makes parts of a
plain text: image links in Markdown become image parts, what lies between them text parts.

Defined results: null role or text is empty; turns are ordered by (turn, role, parts), nulls first, so repeated turns
all stay; unknown kinds are treated as documents, missing units as 1; a row without conversation id is a conversation of
its own. Extra columns are ignored. Empty tables give empty results. A conversation is one sequence and is put together
in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ESCAPE = "␛"
#: Control strings that a text must not contain, and a letter for each.
CONTROLS = {"<|": "a", "|>": "b", "<s>": "c", "</s>": "d", "[INST]": "e", "[/INST]": "f", "<<SYS>>": "g", "<</SYS>>": "h"}
#: Tokens that one unit of an attachment takes: an image tile, a second of audio, a page of a document.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 512}
TURN, END = "<|turn|>", "<|end|>\n"
PARTS = "array<struct<kind:string,text:string,ref:string,units:long>>"
#: An image link in Markdown.
LINK = r"!\[[^\[\]]*\]\([^()\s]*\)"
_PLACEHOLDER = r"<\|(?:" + "|".join(UNIT_TOKENS) + r")\|>"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0"))
    return reduce(lambda x, c: F.replace(x, F.lit(c), F.lit(ESCAPE + CONTROLS[c])), CONTROLS, text)


def unescape(text: Column) -> Column:
    text = reduce(lambda x, c: F.replace(x, F.lit(ESCAPE + CONTROLS[c]), F.lit(c)), CONTROLS, text)
    return F.replace(text, F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def _name(role: Column) -> Column:
    """A role must also be free of line breaks."""
    return F.replace(escape(F.coalesce(role, F.lit(""))), F.lit("\n"), F.lit(ESCAPE + "n"))


def _unname(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(ESCAPE + "n"), F.lit("\n")))


def _kind(p: Column) -> Column:
    return F.when(p["kind"].isin(*UNIT_TOKENS), p["kind"]).otherwise("document")


def visit(parts: Column) -> tuple[Column, Column]:
    """(content, attachments (kind, ref, tokens) in order) of a turn's parts."""
    content = F.array_join(F.transform(parts, lambda p: F.when(p["kind"] == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), _kind(p), F.lit("|>")))), "")
    tokens = lambda p: F.coalesce(p["units"], F.lit(1)) * F.element_at(F.create_map(*[F.lit(x) for kv in UNIT_TOKENS.items() for x in kv]), _kind(p))
    media = F.filter(parts, lambda p: ~F.equal_null(p["kind"], F.lit("text")))
    return content, F.transform(media, lambda p: F.struct(_kind(p).alias("kind"), p["ref"].alias("ref"), tokens(p).cast("long").alias("tokens")))


def _part(kind: str, text: Column, ref: Column, units: int) -> Column:
    return F.struct(F.lit(kind).alias("kind"), text.alias("text"), ref.alias("ref"), F.lit(units).cast("long").alias("units"))


def typed_parts(text: Column) -> Column:
    """The parts of a plain text; a link is the reference of its image."""
    text, none = F.coalesce(text, F.lit("")), F.lit(None).cast("string")
    between, links = F.split(text, LINK), F.regexp_extract_all(text, F.lit(LINK), F.lit(0))
    return F.flatten(F.zip_with(between, links, lambda t, ref: F.when(ref.isNull(), F.array(_part("text", t, none, 0))).otherwise(F.array(_part("text", t, none, 0), _part("image", none, ref, 1)))))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, parts) -> (conv_id, formatted, loss (turn, start, length), attachments (turn, kind, ref, tokens), attachment_tokens)."""
    content, media = visit(F.col("parts"))
    rows = turns.select(
        "conv_id",
        F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("lone"),
        "turn",
        F.col("role").alias("name"),
        F.col("parts").alias("tie"),
        F.equal_null("role", F.lit("assistant")).alias("learn"),
        F.concat(F.lit(TURN), _name(F.col("role")), F.lit("\n")).alias("head"),
        content.alias("content"),
        media.alias("media"),
    )
    piece = lambda t: F.concat(t["head"], t["content"], F.lit(END))
    before = Window.partitionBy("conv_id", "lone").orderBy("turn", "name", "tie").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length(F.concat("head", "content", F.lit(END)))
    # a turn's start puts it in its place and bounds its span
    placed = rows.select("conv_id", "lone", F.struct((F.coalesce(F.sum(size).over(before), F.lit(0)) + 1).alias("start"), "learn", "head", "content", "media").alias("t"))
    chats = placed.groupBy("conv_id", "lone").agg(F.array_sort(F.collect_list("t")).alias("t"))
    spans = F.transform("t", lambda t, i: F.struct(i.alias("turn"), (t["start"] + F.length(t["head"])).alias("start"), F.length(t["content"]).alias("length"), t["learn"].alias("learn")))
    loss = F.transform(F.filter(spans, lambda s: s["learn"]), lambda s: F.struct(s["turn"].alias("turn"), s["start"].alias("start"), s["length"].alias("length")))
    attachments = F.flatten(F.transform("t", lambda t, i: F.transform(t["media"], lambda m: F.struct(i.alias("turn"), m["kind"].alias("kind"), m["ref"].alias("ref"), m["tokens"].alias("tokens")))))
    return chats.select(
        "conv_id",
        F.array_join(F.transform("t", piece), "").alias("formatted"),
        loss.alias("loss"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("attachment_tokens"),
    )


def _restored(content: Column, turn: Column, attachments: Column) -> Column:
    """A turn's text, with the references of its attachments in place of the placeholders."""
    refs = F.transform(F.filter(attachments, lambda a: a["turn"] == turn), lambda a: F.coalesce(a["ref"], F.lit("")))
    return F.array_join(F.zip_with(F.split(content, _PLACEHOLDER), refs, lambda x, ref: F.concat(unescape(x), F.coalesce(ref, F.lit("")))), "")


def read_back(formatted: Column, attachments: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    pieces = F.filter(F.split(formatted, r"<\|turn\|>"), lambda x, i: i > 0)

    def parse(x: Column, turn: Column) -> Column:
        at = F.locate("\n", x)
        body = F.substring(x, at + 1, F.length(x) - at - len(END))
        return F.struct(_unname(F.substring(x, F.lit(1), at - 1)).alias("role"), _restored(body, turn, attachments).alias("text"))

    return F.transform(pieces, parse)


def loss_text(formatted: Column, loss: Column, attachments: Column) -> Column:
    return F.array_join(F.transform(loss, lambda s: _restored(F.substring(formatted, s["start"].cast("int"), s["length"]), s["turn"], attachments)), "")
