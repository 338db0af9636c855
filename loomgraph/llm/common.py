"""Helpers shared by the training-data operators: table access, the shared folder, staged and bucketed tables."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []
#: Folder -> name of bucketed tables, for their removal.
_named: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only in local mode, where all tasks share the machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="spark-loomgraph-"))
        found = _own[0]
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str, codec: str = "zstd") -> DataFrame:
    """Like staged(), in buckets of the key, so that later joins and groups by the key leave this table where it lies."""
    spark = df.sparkSession
    path, named = new_path(spark, name), f"loomgraph_{uuid.uuid4().hex}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).option("compression", codec).saveAsTable(named)
    _named[path.rpartition("/")[2]] = named
    return spark.table(named)


def discard(*frames: DataFrame) -> None:
    """Remove staged tables that nothing reads any more."""
    for frame in frames:
        files = frame.inputFiles()
        if files:
            spark = frame.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
            if (named := _named.pop(folder.getName(), None)) is not None:
                spark.sql(f"DROP TABLE IF EXISTS {named}")


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and afterwards what the worker has freed goes back to the system: workers are kept, and the next stage needs the memory."""

    @wraps(run)
    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return both


def text_bytes(col) -> F.Column:
    """UTF-8 size of a text column; null counts as no text."""
    return F.coalesce(F.octet_length(col), F.lit(0)).cast("long")
