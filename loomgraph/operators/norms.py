"""Visit counts and the weights that remove sampling bias."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLIP, EMPTY = 1e4, 0.1


def node_visits(samples: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, c): in how many samples a node is, 0 included."""
    c = samples.groupBy(F.col("v").alias("id")).agg(F.count(F.lit(1)).alias("c"))
    return ids.select("id").join(c, "id", "left").select("id", F.coalesce("c", F.lit(0)).cast("bigint").alias("c"))


def edge_visits(subgraphs: DataFrame, edges: DataFrame) -> DataFrame:
    """(eid, src, dst, c): in how many induced subgraphs an edge is, 0 included."""
    c = subgraphs.groupBy("eid").agg(F.count(F.lit(1)).alias("c"))
    return edges.select("eid", "src", "dst").join(c, "eid", "left").select("eid", "src", "dst", F.coalesce("c", F.lit(0)).cast("bigint").alias("c"))


def aggregation(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(eid, src, dst, c_v, c_e, alpha): alpha is C_src / C_e up to CLIP; 0/0 is EMPTY."""
    both = edges.withColumnRenamed("c", "c_e").join(nodes.select(F.col("id").alias("src"), F.col("c").alias("c_v")), "src")
    ratio = F.least(F.col("c_v") / F.when(F.col("c_e") != 0, F.col("c_e")), F.lit(CLIP))
    alpha = F.when(F.col("c_e") != 0, ratio).when(F.col("c_v") == 0, EMPTY).otherwise(CLIP)
    return both.select("eid", "src", "dst", "c_v", "c_e", alpha.alias("alpha"))


def loss(visits: DataFrame, nodes: DataFrame, samples: int) -> DataFrame:
    """(id, c_v, lambda): samples / C_v / |V_train| on training nodes, unvisited ones as if seen EMPTY times; 0 elsewhere."""
    n = F.broadcast(nodes.where("role = 'tr'").agg(F.count(F.lit(1)).alias("n")))
    joined = nodes.join(visits, "id", "left").crossJoin(n).withColumn("c_v", F.coalesce("c", F.lit(0)).cast("bigint"))
    seen = F.when(F.col("c_v") == 0, F.lit(EMPTY)).otherwise(F.col("c_v").cast("double"))
    return joined.select("id", "c_v", F.when(F.col("role") == "tr", F.lit(float(samples)) / seen / F.col("n")).otherwise(0.0).alias("lambda"))


def row_normalized(edges: DataFrame) -> DataFrame:
    """(src, dst, w) of D^-1 A."""
    deg = edges.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    return edges.join(deg, "src").select("src", "dst", (F.lit(1.0) / F.col("deg")).alias("w"))


def subgraph_weights(subgraphs: DataFrame, alpha: DataFrame, deg: DataFrame) -> DataFrame:
    """(sg, src, dst, w): alpha over the training degree of the row, on the induced edges."""
    joined = subgraphs.select("sg", "eid", "src", "dst").join(alpha.select("eid", "alpha"), "eid").join(deg.select(F.col("id").alias("src"), "deg"), "src")
    return joined.select("sg", "src", "dst", (F.col("alpha") / F.col("deg")).alias("w"))


def edge_probability(edges: DataFrame, deg: DataFrame, m: int) -> DataFrame:
    """(src, dst, p): (1/deg_u + 1/deg_v) scaled so that both directions together sum to 2 m."""
    d = deg.where("deg > 0")
    w = edges.select("src", "dst").join(d.select(F.col("id").alias("src"), F.col("deg").alias("ds")), "src").join(d.select(F.col("id").alias("dst"), F.col("deg").alias("dd")), "dst")
    w = w.select("src", "dst", F.floor(1e9 * (1 / F.col("ds") + 1 / F.col("dd"))).cast("bigint").alias("w"))
    total = F.broadcast(w.agg(F.sum("w").alias("total")))
    return w.crossJoin(total).select("src", "dst", (F.col("w") * F.lit(2.0 * m) / F.col("total")).alias("p"))
