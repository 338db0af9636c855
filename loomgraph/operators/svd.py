"""Truncated singular value decomposition of a sparse matrix (row, col, v) by blocked subspace iteration.

Neither side of the matrix is ever in one place. Factors are tables (key, x) with a short array a row; a product joins the
entries with the factor's rows and adds up by the other side, columns summed inside each task before the shuffle. What the
driver sees are Gram matrices of size + extra rows, added up by Spark. Columns of the factor are made orthonormal by the
inverse square root of their Gram matrix, twice, which loses nothing that matters; directions without length are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rng import u32
from .wide import _by_column, by_rows

Keep = Callable[[DataFrame], DataFrame]


def product(entries: DataFrame, factor: DataFrame, width: int) -> DataFrame:
    """(id, x): rows of the matrix (src, dst, w) times those of the factor (id, x)."""
    met = entries.join(factor.withColumnRenamed("id", "dst"), "dst")
    return _by_column(met, width, lambda j: F.sum(F.col("w") * F.get("x", F.lit(j))))


def gram(factor: DataFrame, width: int) -> np.ndarray:
    """The products of all columns with each other; each task sends one small matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((width, width))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, width)
            found += x.T @ x
        yield pa.RecordBatch.from_pydict({"at": np.arange(width * width, dtype=np.int32), "g": found.ravel()})

    got = factor.select("x").mapInArrow(run, "at int, g double").groupBy("at").agg(F.sum("g").alias("g")).toPandas()
    out = np.zeros(width * width)
    out[got["at"].to_numpy()] = got["g"].to_numpy()
    return out.reshape(width, width)


def _whitened(factor: DataFrame, width: int, keep: Keep) -> tuple[DataFrame, int]:
    """The factor with orthonormal columns, and how many are left."""
    for _ in range(2):
        values, vectors = np.linalg.eigh(gram(factor, width))
        good = values > max(values.max(initial=0.0), 1e-300) * 1e-13
        turn = vectors[:, good] / np.sqrt(values[good])
        factor, width = keep(by_rows(factor, ["x"], lambda xs, turn=turn: [xs[0] @ turn], ["x"])), int(good.sum())
    return factor, width


def truncated(entries: DataFrame, size: int, keep: Keep, extra: int = 8, tolerance: float = 1e-10, rounds: int = 60) -> tuple[np.ndarray, DataFrame, DataFrame]:
    """(singular values falling, left factor (id, x), right factor (id, x)) of (row, col, v); keep() writes a factor down.

    Goes on until the values change by less than tolerance times the largest. Entries that are told twice add up. Where
    the matrix has fewer directions than asked for, there are fewer values; without entries there are none.
    """
    forth = keep(entries.groupBy(F.col("row").cast("bigint").alias("src"), F.col("col").cast("bigint").alias("dst")).agg(F.sum(F.col("v").cast("double")).alias("w")))
    back = forth.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    width, before = size + extra, None
    start = forth.select(F.col("dst").alias("id")).distinct()
    right = keep(start.select("id", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: u32("svd", "id", j).cast("double") / 4294967296.0 - 0.5).alias("x")))
    if right.isEmpty():
        none = right.limit(0)
        return np.zeros(0), none, none
    right, width = _whitened(right, width, keep)
    for _ in range(rounds):
        left = keep(product(forth, right, width))
        values, turn = np.linalg.eigh(gram(left, width))
        values = np.sqrt(np.maximum(values[::-1], 0.0))
        if before is not None and len(values) == len(before) and np.abs(values - before)[:size].max() <= tolerance * values[0]:
            break
        before = values
        right, width = _whitened(keep(product(back, left, width)), width, keep)
    turn = turn[:, ::-1][:, :size]
    values = values[:size]
    real = values > values[0] * 1e-9
    turn, values = turn[:, real], values[real]
    left = keep(by_rows(left, ["x"], lambda xs: [xs[0] @ turn / values], ["x"]))
    return values, left, keep(by_rows(right, ["x"], lambda xs: [xs[0] @ turn], ["x"]))
