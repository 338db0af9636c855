"""The corpus pipeline: five stages over documents, each written as Parquet and reread as the next one's input.

Language ID rejects documents without letters and those that no learned language explains (all of them, where no row has
a lang to learn from); near-dedup keeps one
document of each class; decontamination drops documents that leak a benchmark item; mixing takes every document at
least once and those of small sources up to twice; sharding permutes the rows into shards and slots. SQL cannot express
it: the tests hold it against brute force on a small table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import decontaminate, language_id, mixing, near_dedup, sharding
from loomgraph.llm.common import discard, new_path, table
from loomgraph.llm.queries import vocabulary_path

SHARDS = 40
ORACLE_SQL = None


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the model learns from the given lang of rows outside the held-out quarter."""
    pieces = language_id.vocabulary(vocabulary_path())
    langs, probs = language_id.fit(docs.where(~language_id.held_out()), pieces)
    return language_id.accepted(docs, langs, probs, pieces)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify),
    ("near_dedup", deduplicate),
    ("decontaminate", decontaminated),
    ("mixing", mix),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            discard(before)
        before = docs
    return docs
