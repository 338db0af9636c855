"""Temperature mixing of sources.

A source's weight is its token share raised to an exponent between 0 and 1, normalised. The exponent is bisected until
the mixture's entropy reaches a target or the most repeated source stays within a repetition limit. A budget of tokens
turns weights into tokens a source: whole passes over the source, and a last pass over a part of it that is taken from
a block permutation (a Feistel permutation of the source's blocks of documents, documents in hashed order within the
block) until its tokens are spent. Sources are rows of a table, however many they are; the driver sees sums over them,
for 63 exponents at a time. Where a source's last pass ends is found from block sums and then inside the one block where
it ends, so a source of any size is never put in one order: it has about as many blocks as a block has documents.

Defined results: null source is the source ''; null text has no tokens; documents without tokens follow their block,
sources without tokens are taken once; rows equal in doc_id and text end up on the same side of the cut; with no budget
the smallest one is used at which no source is cut short, so every document stays at least once. All columns are carried
along, whatever their names. An empty table stays empty.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, staged
from .sharding import permuted

#: Exponents tried at a time, and times.
TRIED, STEPS = 63, 8


def bisect_exponent(fits: Callable[[list[float]], list[bool]]) -> float:
    """The smallest exponent (flattest mixture) between 0 and 1 that fits, to within a billionth; 1 if none below does."""
    low, high = 0.0, 1.0
    if fits([low])[0]:
        return low
    for _ in range(STEPS):
        width = (high - low) / (TRIED + 1)
        points = [low + width * (i + 1) for i in range(TRIED)]
        good = [p for p, fit in zip(points, fits(points), strict=True) if fit]
        high = good[0] if good else high
        low = max(low, high - width)
    return high


def moments(sources: DataFrame, exponents: list[float]) -> tuple[float, float, float, list[tuple[float, float]]]:
    """(tokens in all, the fewest and the most of a source, and by exponent the sum of tokens ** e and of tokens ** e * ln tokens)."""
    t = F.col("tokens").cast("double")
    raised = [c for e in exponents for c in (F.sum(F.pow(t, F.lit(e))), F.sum(F.pow(t, F.lit(e)) * F.ln(t)))]
    row = sources.where("tokens > 0").agg(F.sum(t), F.min(t), F.max(t), *raised).first()
    return row[0], row[1], row[2], [(row[3 + 2 * i], row[4 + 2 * i]) for i in range(len(exponents))]


def fitting(sources: DataFrame, target_entropy: float | None, max_repetition: float | None, epochs: float | None) -> Callable[[list[float]], list[bool]]:
    """Whether mixtures of these exponents have at most the target entropy and stay within the repetition limit."""

    def fits(exponents: list[float]) -> list[bool]:
        total, least, most, sums = moments(sources, exponents)
        out = []
        for e, (z, s) in zip(exponents, sums, strict=True):
            # without a budget the largest source is taken once
            repeated = total * epochs * least ** (e - 1) / z if epochs else (most / least) ** (1 - e)
            fit = max_repetition is None or repeated <= max_repetition
            out.append(fit and (target_entropy is None or math.log(z) - e * s / z <= target_entropy))
        return out

    return fits


def word_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _source(source: str = "source") -> Column:
    return F.coalesce(F.col(source), F.lit(""))


def _place(seed: int) -> Column:
    return F.xxhash64("doc_id", "text", F.lit(seed))


def counted(docs: DataFrame, seed: int = 1) -> DataFrame:
    """(doc_id, source, place, tokens) of every row; staged, so that tokens are counted once."""
    return staged(docs.select("doc_id", _source().alias("source"), _place(seed).alias("place"), word_tokens(F.col("text")).alias("tokens")), "tokens")


def plan(rows: DataFrame, max_repetition: float | None = 2.0, target_entropy: float | None = None, epochs: float | None = None, seed: int = 1) -> DataFrame:
    """One row a source of counted rows: exponent, weight, passes, blocks, and the block and place at which the last pass ends (null if it has none); staged.

    The budget is ``epochs`` times the tokens of all sources.
    """
    sources = staged(rows.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens")), "sources")
    exponent, total, z = 1.0, 0.0, 1.0
    if not sources.where("tokens > 0").isEmpty():
        exponent = bisect_exponent(fitting(sources, target_entropy, max_repetition, epochs))
        total, _, most, sums = moments(sources, [exponent])
        z = sums[0][0]
        total = total * epochs if epochs else z * most ** (1 - exponent)
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(exponent)) / z).otherwise(0.0)
    # a source within a token of whole passes is taken whole
    aimed = sources.withColumns({"weight": weight, "exponent": F.lit(exponent), "aim": F.round(weight * total).cast("long")})
    aimed = aimed.withColumn("passes", F.expr("if(tokens > 0, (aim + 1) div tokens, 1)").cast("int"))
    aimed = staged(aimed.withColumns({"rest": F.greatest(F.lit(0), F.col("aim") - F.col("passes") * F.col("tokens")), "blocks": F.greatest(F.lit(1), F.floor(F.sqrt("docs"))).cast("long")}), "aimed")
    dealt = rows.join(aimed.select("source", "rest", "blocks"), "source").withColumn("block", _block(seed))
    along = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    by_block = dealt.groupBy("source", "block", "rest").agg(F.sum("tokens").alias("t")).withColumn("before", F.coalesce(F.sum("t").over(along), F.lit(0)))
    last = staged(by_block.where("before < rest and before + t >= rest").select("source", F.col("block").alias("block_end"), "before"), "last")
    within = Window.partitionBy("source").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = dealt.join(last, "source").where("block = block_end").withColumn("upto", F.col("before") + F.sum("tokens").over(within))
    ends = inside.where("upto >= rest").groupBy("source", "block_end").agg(F.min("place").alias("place_end"))
    out = staged(aimed.join(ends, "source", "left"), "plan")
    discard(sources, aimed, last)
    return out


def _block(seed: int) -> Column:
    """A document's block: where its block number comes in the permutation of its source's blocks."""
    return permuted(F.pmod("place", F.col("blocks")), F.col("blocks"), seed)


def _copies(rows: DataFrame, parts: DataFrame, seed: int) -> DataFrame:
    """rows (source, place, ...) with their block, and copies (int): how often each is taken."""
    joined = rows.join(parts.select("source", "passes", "blocks", "block_end", "place_end"), "source").withColumn("block", _block(seed))
    more = F.coalesce((F.col("block") < F.col("block_end")) | ((F.col("block") == F.col("block_end")) & (F.col("place") <= F.col("place_end"))), F.lit(False))
    return joined.withColumn("copies", F.col("passes") + more.cast("int")).drop("passes", "blocks", "block_end", "place_end")


def schedule(rows: DataFrame, parts: DataFrame, seed: int = 1) -> DataFrame:
    """Counted rows with copies, block and place: pass by pass, a source is read in the order of (block, place), and its last pass ends where copies says."""
    return _copies(rows, parts, seed)


def mixed(docs: DataFrame, max_repetition: float | None = 2.0, target_entropy: float | None = None, epochs: float | None = None, seed: int = 1) -> DataFrame:
    """docs with every row taken as often as its source's budget says."""
    rows = counted(docs, seed)
    parts = plan(rows, max_repetition, target_entropy, epochs, seed)
    discard(rows)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("r"), _source().alias("source"), _place(seed).alias("place"))
    taken = _copies(whole, parts, seed).select("r", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("_"))
    return taken.select(*(F.col("r").getField(c).alias(c) for c in docs.columns))
