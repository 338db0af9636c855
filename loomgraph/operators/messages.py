"""Message passing as joins and grouped sums over long features (id, j, v), and dense layers over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def neighbour_sum(edges: DataFrame, x: DataFrame) -> DataFrame:
    """(id, j, v): sum over out-neighbours, column by column. Aggregation follows the join in one map-side combined step."""
    return edges.join(x, edges.dst == x.id).groupBy(F.col("src").alias("id"), "j").agg(F.sum("v").alias("v"))


def neighbour_mean(edges: DataFrame, x: DataFrame) -> DataFrame:
    """D^-1 A X as one exact division of sums."""
    return edges.join(x, edges.dst == x.id).groupBy(F.col("src").alias("id"), "j").agg((F.sum("v") / F.count(F.lit(1))).alias("v"))


def neighbour_max(edges: DataFrame, x: DataFrame) -> DataFrame:
    """Element-wise maximum over neighbours; nodes without any get 0."""
    found = edges.join(x, edges.dst == x.id).groupBy(F.col("src").alias("id"), "j").agg(F.max("v").alias("m"))
    return x.join(found, ["id", "j"], "left").select("id", "j", F.coalesce("m", F.lit(0)).cast("bigint").alias("v"))


def dense(x: DataFrame, weights: DataFrame, bias: int = 0) -> DataFrame:
    """X W + b with W as (i, j, w); the weights of a layer are few and are broadcast."""
    w = F.broadcast(weights.withColumnRenamed("j", "o"))
    return x.join(w, x.j == w.i).groupBy("id", F.col("o").alias("j")).agg((F.sum(F.col("v") * F.col("w")) + bias).alias("v"))


def relu(x: DataFrame) -> DataFrame:
    return x.withColumn("v", F.greatest("v", F.lit(0)))


def hops_mean(parts: list[DataFrame], more: float = 0.0) -> DataFrame:
    """Sum of equally wide blocks, place by place; more is added before the sums are rounded."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("id", "j").agg(F.round(F.sum("v") + more, 2).alias("v"))


def hop_concat(parts: list[DataFrame], width: int) -> DataFrame:
    """Column-wise concatenation of equally wide blocks."""
    out = parts[0]
    for n, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("j", F.col("j") + n * width))
    return out


def attention(edges: DataFrame, h: DataFrame, own: DataFrame, other: DataFrame) -> DataFrame:
    """(id, j, v) sum over edges of (leaky(a_own . h_i) + leaky(a_other . h_j)) h_j in fifths (the slope is 1/5), without softmax."""
    score = lambda a, name: h.join(F.broadcast(a), "j").groupBy("id").agg(F.sum(F.col("v") * F.col("a")).alias("s")).select("id", leaky5(F.col("s")).alias(name))
    left, right = score(own, "l"), score(other, "r")
    e = edges.join(left, edges.src == left.id).select("src", "dst", "l").join(right, F.col("dst") == right.id).select("src", "dst", (F.col("l") + F.col("r")).alias("s"))
    return e.join(h, e.dst == h.id).groupBy(F.col("src").alias("id"), "j").agg(F.sum(F.col("s") * F.col("v")).alias("v"))


def leaky5(s: Column) -> Column:
    """Five times LeakyReLU with slope 0.2, exact on integers."""
    return F.when(s < 0, s).otherwise(s * 5)


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, v) of two long matrices; products and sums of whole numbers are decimals of 38 digits, as they may leave 64 bits."""
    whole = a.schema["v"].dataType.typeName() == "long"
    left = F.col("a.v").cast("decimal(38,0)") if whole else F.col("a.v")
    return a.alias("a").join(b.alias("b"), F.expr("a.j = b.i")).groupBy(F.col("a.i").alias("i"), F.col("b.j").alias("j")).agg(F.sum(left * F.col("b.v")).alias("v"))
