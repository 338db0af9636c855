"""Visit counts of a stream of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def node_visits(samples: DataFrame) -> DataFrame:
    """(id, c) of streamed samples (sg, v): a stateful count; state grows with the nodes and not with the samples."""
    return samples.groupBy(F.col("v").alias("id")).agg(F.count(F.lit(1)).alias("c"))


def keep_visits(samples: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the counts that changed in each batch below path, by batch, so that a batch run again replaces itself."""

    def put(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return node_visits(samples).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def latest(visits: DataFrame) -> DataFrame:
    """(id, c) as of the last batch of every node, from the written (id, c, batch)."""
    return visits.groupBy("id").agg(F.max_by("c", "batch").alias("c"))
