"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered in one global order, of the hash of their key, the key, and a hash of the whole row; a sort over
ranges deals the order out, and the ranges' counts turn places within a range into global numbers. The numbers depend on
the rows alone: rows that are equal in all of that may lie in several ranges, but whichever of them takes which of their
numbers, the result is the same. A keyed Feistel network over an a x b grid that just covers the rows permutes the
numbers; results beyond the last row walk on along their cycle. Row r goes to shard p(r) mod k at slot p(r) div k, so
shard sizes differ by one row at most and both are computable from the number.

Defined results: null text has no bytes; a null key counts as an empty one; equal rows take neighbouring numbers; all
other columns are carried along, whatever their names, but for columns named shard and slot, which are replaced. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Fixed values of the network: rounds, the prime that rounds are reckoned by, and their multipliers.
ROUNDS, PRIME, FIRST, SECOND, STEP = 6, 2147483647, 48271, 69621, 104729


def _key(seed: int, turn: int) -> int:
    return (seed * 7919 + (turn + 1) * STEP) % PRIME


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    x = (x % PRIME * FIRST + key) % PRIME
    return (x ^ x >> 15) * SECOND % PRIME


def permute(rows: np.ndarray, n: int | np.ndarray, seed: int) -> np.ndarray:
    """Images of row numbers below n (one number, or one for each row) under the keyed permutation of range(n)."""
    out, n = np.asarray(rows, np.int64).copy(), np.broadcast_to(np.asarray(n, np.int64), np.shape(rows))
    a = np.maximum(1, np.ceil(np.sqrt(n)).astype(np.int64))
    b = np.maximum(1, -(-n // a))
    todo = np.arange(len(out))
    while len(todo):
        left, right, a_, b_ = out[todo] // b[todo], out[todo] % b[todo], a[todo], b[todo]
        for i in range(ROUNDS):
            if i % 2:
                right = (right + _mixed(left, _key(seed, i))) % b_
            else:
                left = (left + _mixed(right, _key(seed, i))) % a_
        out[todo] = left * b_ + right
        todo = todo[out[todo] >= n[todo]]
    return out


def permutation_sql(rows: str, seed: int) -> str:
    """The same permutation as a recursive SQL query over a relation ``rows`` of (r, n): its rows with p, the image of r."""
    mixed = lambda x, i: f"(xor(({x} % {PRIME} * {FIRST} + {_key(seed, i)}) % {PRIME}, (({x} % {PRIME} * {FIRST} + {_key(seed, i)}) % {PRIME}) >> 15) * {SECOND} % {PRIME})"
    step = "SELECT r, n, a, b, q // b AS l, q % b AS h FROM {0}"
    for i in range(ROUNDS):
        changed = f"l, (h + {mixed('l', i)}) % b AS h" if i % 2 else f"(l + {mixed('h', i)}) % a AS l, h"
        step = f"SELECT r, n, a, b, {changed} FROM ({step})"
    step = f"SELECT r, n, a, b, l * b + h AS q FROM ({step})"
    grid = f"(SELECT r, n, a, ((n + a - 1) // a)::BIGINT AS b, r AS q FROM (SELECT r, n, ceil(sqrt(n))::BIGINT AS a FROM {rows}))"
    return f"WITH RECURSIVE walk AS ({step.format(grid)} UNION ALL {step.format('(SELECT * FROM walk WHERE q >= n)')}) SELECT r, q AS p FROM walk WHERE q < n"


def numbered(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(r, number, n): every row as a struct, its global number from 0, and how many there are."""
    every = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
    hashed = rows.select(every.alias("r"), F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))).alias("h"), F.col(f"`{key}`").alias("k"), F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns)).alias("x"))
    # the last one only splits rows that are equal in the others
    dealt = hashed.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange("h", "k", "x", "tie").sortWithinPartitions("h", "k", "x", "tie")
    placed = staged(dealt.select("r", F.monotonically_increasing_id().alias("at")), "placed", "zstd")
    part, inside = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    # one row a range, as many as there are shuffle partitions at most: one task adds them up, and they can be broadcast
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = staged(counts.select("part", before.alias("before"), F.sum("n").over(Window.partitionBy()).alias("n")), "offsets")
    return placed.withColumn("part", part).join(F.broadcast(offsets), "part").select("r", (F.col("before") + inside).alias("number"), "n")


def _permuted(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for row, n, seed in batches:
        yield pd.Series(permute(row.to_numpy(), n.to_numpy(), int(seed.iloc[0])) if len(row) else row)


def permuted(row: F.Column, n: F.Column, seed: int) -> F.Column:
    return F.pandas_udf(_permuted, "long")(row, n, F.lit(seed))


def shard_rows(rows: DataFrame, shards: int, seed: int = 1, key: str = "doc_id") -> DataFrame:
    """rows with shard (int) and slot (long)."""
    placed = numbered(rows, key).select("r", permuted(F.col("number"), F.col("n"), seed).alias("at"))
    kept = [F.col("r").getField(c).alias(c) for c in rows.columns if c not in ("shard", "slot")]
    return placed.select(*kept, F.pmod("at", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("at") / shards).cast("long").alias("slot"))
