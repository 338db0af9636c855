"""Running totals and gapless numbers without putting a whole table in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Values added up in one task; blocks of blocks of them stay below some thousand up to 10**11 keys.
WIDTH, LEVELS = 4096, 2


def running_total(df: DataFrame, key: str, value: str, name: str, width: int = WIDTH, levels: int = LEVELS) -> DataFrame:
    """df with the inclusive running total of value in the order of the integer key.

    Totals of key blocks of ``width`` have running totals of their own, level by level; those of the last level are few
    enough for one small window. Inside a block values are added up by a window of that block.
    """
    df = df.withColumn("_block", F.floor(F.col(key) / width))
    blocks = df.groupBy("_block").agg(F.sum(value).alias("_sum"))
    if levels > 1:
        upper = running_total(blocks.select(F.col("_block").alias("_key"), "_sum"), "_key", "_sum", "_upto", width, levels - 1)
        offsets = upper.select(F.col("_key").alias("_block"), (F.col("_upto") - F.col("_sum")).alias("_before"))
    else:
        before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        offsets = blocks.select("_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_in", F.sum(value).over(inside)).join(offsets, "_block").withColumn(name, (F.col("_before") + F.col("_in")).cast("bigint")).drop("_block", "_in", "_before")


def ranked(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with gapless 0-based ranks in the order of a unique integer key."""
    return running_total(df.withColumn("_one", F.lit(1)), key, "_one", name).withColumn(name, F.col(name) - 1).drop("_one")


#: Ids in a block of a group, however large the group is.
BLOCK = 1 << 16


def followed(df: DataFrame, keys: list[str], key: str, name: str, block: int = BLOCK) -> DataFrame:
    """(keys, key, name): the next larger integer key of the same group, where there is one.

    Windows reach over one block of a group; the last key of a block meets the first of the group's next block, found among
    the blocks' ends.
    """
    df = df.select(*keys, key, F.floor(F.col(key) / block).alias("_block"))
    inside = df.select(*keys, key, F.lead(key).over(Window.partitionBy(*keys, "_block").orderBy(key)).alias(name)).where(F.col(name).isNotNull())
    ends = df.groupBy(*keys, "_block").agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
    across = ends.select(*keys, F.col("_last").alias(key), F.lead("_first").over(Window.partitionBy(*keys).orderBy("_block")).alias(name))
    return inside.unionByName(across.where(F.col(name).isNotNull()))


def ranked_within(df: DataFrame, keys: list[str], key: str, name: str, block: int = BLOCK) -> DataFrame:
    """df with gapless 0-based ranks by a unique integer key inside each group, block by block."""
    df = df.withColumn("_block", F.floor(F.col(key) / block))
    sizes = df.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(key)) - 1
    return df.withColumn("_place", place).join(offsets, [*keys, "_block"]).withColumn(name, (F.col("_before") + F.col("_place")).cast("bigint")).drop("_block", "_place", "_before")


def local_ids(samples: DataFrame) -> DataFrame:
    """(sg, v) -> (sg, v, lid): rank of the node inside its sample."""
    return samples.withColumn("lid", (F.row_number().over(Window.partitionBy("sg").orderBy("v")) - 1).cast("bigint"))
