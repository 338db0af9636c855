"""Folders of raw tensors: eleven sizes, two adjacencies in compressed rows, three lists of nodes, two column-major matrices.

A Python data source for one flat array (``raw_tensor``), read and written in ranges by many tasks, and the folder on top
of it. Every task of a write has a file of its own beside the target; commit puts them together in order, abort removes
them. Paths must be mounted on all executors and on the driver.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, WriterCommitMessage

from ..operators.windows import ranked
from .files import Range, _ranges, scaled
from .graphs import GraphTables, degrees, induced_by_role

#: The files of a folder, in the order of their sizes.
FILES = ["adj_train_indices", "adj_train_indptr", "adj_full_indices", "adj_full_indptr", "node_train", "node_test", "node_val", "feats_norm_col", "labels_col"]
INT, REAL = "<i4", "<f8"
ELEMENTS = 1 << 20


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.kind = options["path"].removeprefix("file://"), np.dtype(options.get("dtype", REAL))
        self.each = int(options.get("elements", ELEMENTS))

    def partitions(self) -> list[Range]:
        return _ranges(os.path.getsize(self.path) // self.kind.itemsize, self.each)

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        with open(self.path, "rb") as f:
            f.seek(part.lo * self.kind.itemsize)
            v = np.frombuffer(f.read((part.hi - part.lo) * self.kind.itemsize), self.kind)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.lo, part.lo + len(v)), pa.int64()), pa.array(v.astype(float), pa.float64())], ["at", "v"])


@dataclass
class _Part(WriterCommitMessage):
    path: str
    first: int
    last: int


class _Writer(DataSourceArrowWriter):
    """Rows (at, v), each task's in the order of at and in ranges that follow one another."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.kind, self.overwrite = options["path"].removeprefix("file://"), np.dtype(options.get("dtype", REAL)), overwrite
        self.aside = f"{self.path}.{uuid.uuid4().hex}.parts"

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        context = TaskContext.get()
        # tried again, or twice at once, a task writes another file
        path = f"{self.aside}/{context.partitionId()}-{context.taskAttemptId()}"
        os.makedirs(self.aside, exist_ok=True)
        first, last = -1, -1
        with open(path, "wb") as f:
            for batch in batches:
                at = batch.column("at").to_numpy()
                if not len(at):
                    continue
                if (np.diff(at) != 1).any() or last >= 0 and at[0] != last + 1:
                    raise ValueError("places must follow one another without gaps")
                first, last = at[0] if first < 0 else first, int(at[-1])
                f.write(batch.column("v").to_numpy().astype(self.kind).tobytes())
        return _Part(path, int(first), last)

    def commit(self, messages: list[WriterCommitMessage]) -> None:
        parts = sorted((m for m in messages if m is not None and m.first >= 0), key=lambda m: m.first)
        for before, after in zip([_Part("", -1, -1), *parts], parts, strict=False):
            if after.first != before.last + 1:
                self.abort(messages)
                raise ValueError(f"no value for place {before.last + 1}")
        if os.path.exists(self.path) and not self.overwrite:
            self.abort(messages)
            raise ValueError(f"{self.path} is there already")
        whole = f"{self.aside}.whole"
        with open(whole, "wb") as out:
            for part in parts:
                with open(part.path, "rb") as f:
                    shutil.copyfileobj(f, out, 1 << 24)
        os.replace(whole, self.path)
        shutil.rmtree(self.aside, ignore_errors=True)

    def abort(self, messages: list[WriterCommitMessage]) -> None:
        shutil.rmtree(self.aside, ignore_errors=True)


class RawTensor(DataSource):
    """raw_tensor: (at, v), the elements of a file of numbers; dtype is one of numpy's names."""

    @classmethod
    def name(cls) -> str:
        return "raw_tensor"

    def schema(self) -> str:
        return "at bigint, v double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite)


def write_tensor(values: DataFrame, path: str, dtype: str) -> None:
    """(at, v) in ranges of at, to one file."""
    values.sparkSession.dataSource.register(RawTensor)
    parts = values.repartitionByRange("at").sortWithinPartitions("at").select("at", F.col("v").cast("double").alias("v"))
    parts.write.format("raw_tensor").option("dtype", dtype).mode("overwrite").save(path)


def read_tensor(spark: SparkSession, path: str, dtype: str, elements: int = ELEMENTS) -> DataFrame:
    spark.dataSource.register(RawTensor)
    return spark.read.format("raw_tensor").option("dtype", dtype).option("elements", str(elements)).load(path)


def _rows(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(indices, indptr) of edges between nodes numbered from 0, rows in order."""
    from ..operators.windows import running_total

    cum = running_total(degrees(edges, nodes), "id", "deg", "cum")
    k = F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1
    at = edges.withColumn("k", k).join(cum.select(F.col("id").alias("src"), (F.col("cum") - F.col("deg")).alias("first")), "src")
    zero = nodes.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("v"))
    return at.select((F.col("first") + F.col("k")).alias("at"), F.col("dst").alias("v")), zero.unionByName(cum.select((F.col("id") + 1).alias("at"), F.col("cum").alias("v")))


def _matrix(x: DataFrame, rows: int) -> DataFrame:
    """(at, v) of (id, x), column by column."""
    return x.select("id", F.posexplode("x").alias("j", "v")).select((F.col("j") * F.lit(rows).cast("bigint") + F.col("id")).alias("at"), "v")


def write_folder(graph: GraphTables, path: str) -> None:
    """A graph with nodes numbered from 0, arrays (id, x) and labels (id, y), y a class or an array of flags.

    Features are scaled by the training nodes, and classes become one flag each.
    """
    os.makedirs(path.removeprefix("file://"), exist_ok=True)
    n = graph.arrays.count()
    ids = graph.arrays.select("id")
    train = graph.ids()
    first = graph.labels.first()["y"]
    if isinstance(first, list):
        flags, classes = graph.labels.select("id", F.col("y").alias("x")), len(first)
    else:
        classes = int(graph.labels.agg(F.max("y")).first()[0]) + 1
        flags = graph.labels.select("id", F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: (c == F.col("y")).cast("int")).alias("x"))
    arrays = graph.arrays.select("id", F.col("x").cast("array<double>").alias("x"))
    (train_dst, train_at), (full_dst, full_at) = _rows(induced_by_role(graph.edges, graph.nodes), ids), _rows(graph.edges, ids)
    lists = {name: ranked(graph.ids(role), "id", "at").select("at", F.col("id").alias("v")) for name, role in (("node_train", "tr"), ("node_test", "te"), ("node_val", "va"))}
    parts = {"adj_train_indices": train_dst, "adj_train_indptr": train_at, "adj_full_indices": full_dst, "adj_full_indptr": full_at, **lists}
    for name, values in parts.items():
        write_tensor(values, f"{path}/{name}.bin", INT)
    write_tensor(_matrix(scaled(arrays, train), n), f"{path}/feats_norm_col.bin", REAL)
    write_tensor(_matrix(flags, n), f"{path}/labels_col.bin", REAL)
    width = arrays.select(F.size("x")).first()[0]
    sizes = [os.path.getsize(f"{path.removeprefix('file://')}/{name}.bin") // 4 for name in FILES[:7]] + [n, width, n, classes]
    spark = graph.nodes.sparkSession
    write_tensor(spark.createDataFrame(list(enumerate(map(float, sizes))), "at bigint, v double").coalesce(1), f"{path}/dims.bin", INT)


def _edges(dst: DataFrame, at: DataFrame) -> DataFrame:
    """(src, dst) of compressed rows: every element meets the row whose range it lies in, by blocks of places."""
    width = 1 << 16
    ends = at.select(F.col("at").alias("src"), F.col("v").cast("bigint").alias("lo")).join(at.select((F.col("at") - 1).alias("src"), F.col("v").cast("bigint").alias("hi")), "src").where("hi > lo")
    laid = ends.select("src", "lo", "hi", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))).alias("b"))
    return dst.withColumn("b", F.expr(f"at div {width}")).join(laid, "b").where("lo <= at and at < hi").select("src", F.col("v").cast("bigint").alias("dst"))


def read_folder(spark: SparkSession, path: str, elements: int = ELEMENTS) -> tuple[GraphTables, DataFrame]:
    """(graph, training edges): arrays are (id, x), labels (id, y) with an array of flags."""
    sizes = [int(r.v) for r in read_tensor(spark, f"{path}/dims.bin", INT).orderBy("at").collect()]
    whole = {name: read_tensor(spark, f"{path}/{name}.bin", INT if n < 7 else REAL, elements) for n, name in enumerate(FILES)}

    def matrix(name: str, rows: int, width: int, kind: str) -> DataFrame:
        cells = whole[name].select(F.expr(f"at % {rows}").alias("id"), F.expr(f"at div {rows}").alias("j"), "v")
        entry = F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda e: e["v"].cast(kind))  # one matrix row
        return cells.groupBy("id").agg(entry.alias("x"))

    nodes = [whole[name].select(F.col("v").cast("bigint").alias("id"), F.lit(role).alias("role")) for name, role in (("node_train", "tr"), ("node_test", "te"), ("node_val", "va"))]
    x = matrix("feats_norm_col", sizes[7], sizes[8], "double")
    y = matrix("labels_col", sizes[9], sizes[10], "int").withColumnRenamed("x", "y")
    long = x.select("id", F.posexplode("x").alias("j", "v"))
    edges, train = (_edges(whole[f"adj_{k}_indices"], whole[f"adj_{k}_indptr"]) for k in ("full", "train"))
    return GraphTables(nodes[0].unionByName(nodes[1]).unionByName(nodes[2]), edges, long, y, x), train
