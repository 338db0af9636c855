"""Array expressions for row vectors; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def relu(x: Column) -> Column:
    return F.transform(x, lambda v: F.greatest(v, F.lit(0.0)))


def leaky_relu(v: Column, slope: float = 0.2) -> Column:
    return F.when(v < 0, v * slope).otherwise(v)


def l2_normalize(x: Column, eps: float = 1e-12) -> Column:
    size = F.sqrt(F.greatest(dot(x, x), F.lit(eps)))
    return F.transform(x, lambda v: v / size)


def layer_norm(x: Column, eps: float = 1e-9) -> Column:
    """Population mean and variance over the features of one row."""
    n = F.size(x)
    mean = total(x) / n
    var = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / n
    return F.transform(x, lambda v: (v - mean) / F.sqrt(var + eps))


def softmax(x: Column) -> Column:
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / total(e))


def log_sum_exp(x: Column) -> Column:
    """With the largest element taken out first, so that nothing overflows."""
    top = F.array_max(x)
    return top + F.ln(total(F.transform(x, lambda v: F.exp(v - top))))


def sigmoid(x: Column) -> Column:
    return F.transform(x, lambda v: 1 / (1 + F.exp(-v)))


def argmax(x: Column) -> Column:
    """0-based index of the first maximal element."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")
