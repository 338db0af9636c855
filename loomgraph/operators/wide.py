"""Message passing over array features: one joined row an edge, whose columns are added up before the shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that one aggregation adds up; wider rows take several of them.
COLUMNS = 96


def _met(edges: DataFrame, x: DataFrame) -> DataFrame:
    weight = F.col("w") if "w" in edges.columns else F.lit(1)
    return edges.select("src", F.col("dst").alias("id"), weight.alias("w")).join(x.select("id", "x"), "id")


def _by_column(met: DataFrame, width: int, value: Callable[[int], Column]) -> DataFrame:
    """(id, x) of width aggregates a row."""
    blocks = []
    for lo in range(0, width, COLUMNS):
        some = range(lo, min(lo + COLUMNS, width))
        blocks.append(met.groupBy(F.col("src").alias("id")).agg(*(value(j).alias(f"_{j}") for j in some)).select("id", F.array(*(f"_{j}" for j in some)).alias(f"x{lo}")))
    out = blocks[0]
    for b in blocks[1:]:
        out = out.join(b, "id")
    return out.select("id", F.concat(*(c for c in out.columns if c != "id")).alias("x"))


def gathered(edges: DataFrame, x: DataFrame, width: int) -> DataFrame:
    """(id, x): sums over out-neighbours of (id, x), times the edges' w where they have one; nodes without neighbours do not appear."""
    return _by_column(_met(edges, x), width, lambda j: F.sum(F.col("w") * F.get("x", F.lit(j))))


def attended(edges: DataFrame, x: DataFrame, width: int, heads: int) -> DataFrame:
    """(id, x): sums over out-neighbours of (id, x, own, other), each head's columns times max(own of the row + other of the neighbour, 0), and the edges' w."""
    weight = F.col("w") if "w" in edges.columns else F.lit(1)
    near = edges.select("src", F.col("dst").alias("id"), weight.alias("w")).join(x.select("id", "x", "other"), "id").drop("id")
    met = near.join(x.select(F.col("id").alias("src"), "own"), "src")
    score = lambda h: F.col("w") * F.greatest(F.get("own", F.lit(h)) + F.get("other", F.lit(h)), F.lit(0.0))
    return _by_column(met, width, lambda j: F.sum(score(j * heads // width) * F.get("x", F.lit(j))))


def averaged(edges: DataFrame, x: DataFrame, width: int) -> DataFrame:
    """Plain means, as one division of sums."""
    return _by_column(_met(edges, x), width, lambda j: F.sum(F.get("x", F.lit(j))) / F.count(F.lit(1)))


def largest(edges: DataFrame, x: DataFrame, width: int) -> DataFrame:
    return _by_column(_met(edges, x), width, lambda j: F.max(F.get("x", F.lit(j))))


def filled(nodes: DataFrame, found: DataFrame, width: int, name: str, kind: str = "double") -> DataFrame:
    """nodes with the array of found as a further column, zeros where there is none."""
    return nodes.join(found.select("id", F.col("x").alias(name)), "id", "left").withColumn(name, F.coalesce(name, F.array_repeat(F.lit(0).cast(kind), width)))


def long(x: DataFrame) -> DataFrame:
    return x.select("id", F.posexplode("x").alias("j", "v"))


def arrays(long_rows: DataFrame, width: int) -> DataFrame:
    """(id, x) from (id, j, v) without gaps."""
    return long_rows.groupBy("id").agg(*(F.max(F.when(F.col("j") == j, F.col("v"))).alias(f"_{j}") for j in range(width))).select("id", F.array(*(f"_{j}" for j in range(width))).alias("x"))


def matrix(col: pa.Array) -> np.ndarray:
    """The rows of an array column of one width."""
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1).astype(float)


def by_rows(nodes: DataFrame, parts: list[str], f: Callable[[list[np.ndarray]], list[np.ndarray]], names: list[str]) -> DataFrame:
    """(id, names...): arrays that f makes of the rows' arrays, a batch of rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            made = f([matrix(batch.column(p)) for p in parts])
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(np.ascontiguousarray(m).ravel())) for m in made]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *lists], ["id", *names])

    return nodes.select("id", *parts).mapInArrow(run, ", ".join(["id bigint", *(f"{n} array<double>" for n in names)]))
