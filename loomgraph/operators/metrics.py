"""Classification metrics by conditional sums, and losses on arrays of scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ratio(a: F.Column, b: F.Column) -> F.Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b != 0, b))


def confusion(rows: DataFrame) -> DataFrame:
    """(cls, tp, fp, fn) from one row a prediction and class: (cls, y, p) with y, p in {0, 1}."""
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    y, p = F.col("y") == 1, F.col("p") == 1
    return rows.groupBy("cls").agg(one(y & p).alias("tp"), one(~y & p).alias("fp"), one(y & ~p).alias("fn"))


def long_single(pairs: DataFrame) -> DataFrame:
    """(y, pred) of single-label rows as (cls, y, p); classes neither seen nor predicted do not appear."""
    both = F.when(F.col("y") == F.col("pred"), F.array(F.struct(F.col("y").alias("cls"), F.lit(1).alias("y"), F.lit(1).alias("p")))).otherwise(
        F.array(F.struct(F.col("y").alias("cls"), F.lit(1).alias("y"), F.lit(0).alias("p")), F.struct(F.col("pred").alias("cls"), F.lit(0).alias("y"), F.lit(1).alias("p")))
    )
    return pairs.select(F.inline(both))


def f1(counts: DataFrame) -> DataFrame:
    """One row: f1_micro, f1_macro over the classes present."""
    f = _ratio(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    s = lambda c: F.sum(c)
    return counts.agg(F.round(_ratio(2.0 * s("tp"), 2 * s("tp") + s("fp") + s("fn")), 9).alias("f1_micro"), F.round(F.avg(f), 9).alias("f1_macro"))
