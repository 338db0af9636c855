"""Graph files: compressed sparse rows in npz, dense npy matrices, JSON roles and class maps; sinks for a graph's relations.

Array files are cut into row ranges and each task reads its own range, so paths must be mounted on all executors.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.windows import ranked
from .graphs import GraphTables, induced_by_role, val_edges

ROWS = 1 << 16


class Range(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


def _ranges(rows: int, each: int) -> list[Range]:
    return [Range(lo, min(lo + each, rows)) for lo in range(0, rows, each)] or [Range(0, 0)]


def _header(f) -> tuple[tuple[int, ...], np.dtype]:
    version = np.lib.format.read_magic(f)
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if fortran and len(shape) > 1:
        raise ValueError("column-major matrices are not supported")
    return shape, kind


def _slice(f, lo: int, hi: int) -> np.ndarray:
    """Elements or rows lo to hi of an npy stream."""
    shape, kind = _header(f)
    wide = int(np.prod(shape[1:], dtype=np.int64))
    f.seek(f.tell() + lo * wide * kind.itemsize)
    return np.frombuffer(f.read((hi - lo) * wide * kind.itemsize), kind).reshape(hi - lo, *shape[1:])


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.each = options["path"].removeprefix("file://"), int(options.get("rows", ROWS))


class _CsrReader(_Reader):
    def partitions(self) -> list[Range]:
        with zipfile.ZipFile(self.path) as z, z.open("indptr.npy") as f:
            return _ranges(_header(f)[0][0] - 1, self.each)

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.hi == part.lo:
            return
        with zipfile.ZipFile(self.path) as z:
            with z.open("indptr.npy") as f:
                at = _slice(f, part.lo, part.hi + 1).astype(np.int64)
            for member in ("data", "indices"):
                with z.open(f"{member}.npy") as f:
                    found = _slice(f, int(at[0]), int(at[-1]))
                    data, dst = (found != 0, None) if member == "data" else (data, found.astype(np.int64))
        src = np.repeat(np.arange(part.lo, part.hi), np.diff(at))
        yield pa.RecordBatch.from_arrays([pa.array(src[data], pa.int64()), pa.array(dst[data], pa.int64())], ["src", "dst"])


class _MatrixReader(_Reader):
    def partitions(self) -> list[Range]:
        with open(self.path, "rb") as f:
            return _ranges(_header(f)[0][0], self.each)

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        with open(self.path, "rb") as f:
            x = _slice(f, part.lo, part.hi).astype(np.float64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.lo, part.hi), pa.int64()), lists], ["id", "x"])


class CsrEdges(DataSource):
    """npz_csr: (src, dst) of the entries other than 0."""

    @classmethod
    def name(cls) -> str:
        return "npz_csr"

    def schema(self) -> str:
        return "src bigint, dst bigint"

    def reader(self, schema) -> DataSourceReader:
        return _CsrReader(self.options)


class NpyMatrix(DataSource):
    """npy_matrix: (id, x), one row a matrix row."""

    @classmethod
    def name(cls) -> str:
        return "npy_matrix"

    def schema(self) -> str:
        return "id bigint, x array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _MatrixReader(self.options)


def register(spark: SparkSession) -> None:
    for source in (CsrEdges, NpyMatrix):
        spark.dataSource.register(source)


def roles(spark: SparkSession, path: str) -> DataFrame:
    """(id, role) from {role: [ids]}."""
    read = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, array<bigint>>")).alias("role", "ids"))
    return read.select(F.explode("ids").alias("id"), "role")


def class_map(spark: SparkSession, path: str) -> DataFrame:
    """(id, cls, y) from {id: class} (one row an id, y is 1) or {id: [0 or 1 a class]} (one row a class)."""
    read = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, string>")).alias("id", "v"))
    flags = F.from_json("v", "array<int>")
    many = F.transform(flags, lambda y, i: F.struct(i.alias("cls"), y.alias("y")))
    one = F.array(F.struct(F.expr("try_cast(v as int)").alias("cls"), F.lit(1).alias("y")))
    return read.select(F.col("id").cast("bigint").alias("id"), F.inline(F.when(F.col("v").startswith("["), many).otherwise(one)))


def scaled(features: DataFrame, train: DataFrame) -> DataFrame:
    """(id, x) less the mean and over the population deviation of the rows of ``train`` (id); constant columns are only centred.

    One row holds the numbers of all columns and is broadcast: it is as wide as a feature row.
    """
    each = features.join(train.select("id").distinct(), "id", "left_semi").select(F.posexplode("x").alias("j", "v"))
    fit = each.groupBy("j").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    row = fit.agg(F.array_sort(F.collect_list(F.struct("j", "mean", F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0).alias("sd")))).alias("fit"))
    return features.crossJoin(F.broadcast(row)).select("id", F.zip_with("x", "fit", lambda v, f: (v - f["mean"]) / f["sd"]).alias("x"))


def load_data(spark: SparkSession, folder: str, normalize: bool = True) -> tuple[GraphTables, DataFrame]:
    """(graph, training edges) from adj_full.npz, adj_train.npz, role.json, class_map.json and feats.npy; features are scaled by the nodes that have training edges.

    Labels are (id, cls, y), features (id, x); more or fewer labels than features are an error.
    """
    register(spark)
    edges, train = (spark.read.format("npz_csr").load(f"{folder}/{name}.npz") for name in ("adj_full", "adj_train"))
    features, labels = spark.read.format("npy_matrix").load(f"{folder}/feats.npy"), class_map(spark, f"{folder}/class_map.json")
    told, rows = labels.select("id").distinct().count(), features.count()
    if told != rows:
        raise ValueError(f"{told} nodes have classes, {rows} have features")
    if normalize:
        features = scaled(features, train.select(F.col("src").alias("id")))
    return GraphTables(roles(spark, f"{folder}/role.json"), edges, features, labels), train


def write_graph(graph: GraphTables, path: str) -> None:
    """The relations as Parquet below path, with the edges among training nodes and those that touch no test node; read_graph is the way back."""
    for name in ("nodes", "edges", "features", "labels"):
        getattr(graph, name).write.parquet(f"{path}/{name}")
    induced_by_role(graph.edges, graph.nodes).write.parquet(f"{path}/edges_train")
    val_edges(graph.edges, graph.nodes).write.parquet(f"{path}/edges_val")


def read_graph(spark: SparkSession, path: str) -> GraphTables:
    return GraphTables(*(spark.read.parquet(f"{path}/{name}") for name in ("nodes", "edges", "features", "labels")))


def write_node_link(graph: GraphTables, path: str) -> None:
    """Node-link JSON lines in two folders: nodes (id, test, val) and links (source, target), each undirected edge once."""
    graph.nodes.select("id", (F.col("role") == "te").alias("test"), (F.col("role") == "va").alias("val")).write.json(f"{path}/nodes")
    graph.edges.where("src <= dst").select(F.col("src").alias("source"), F.col("dst").alias("target")).write.json(f"{path}/links")


def write_id_map(nodes: DataFrame, path: str, each: int = ROWS) -> None:
    """{"id": number} as JSON objects of some thousand ids a line, numbers in the order of ids; read_id_map is the way back."""
    numbered = ranked(nodes.select("id"), "id", "r")
    lines = numbered.groupBy(F.expr(f"r div {each}")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("id").cast("string"), "r")))).alias("value"))
    lines.select("value").write.text(path)


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    """(id, r)."""
    read = spark.read.text(path).select(F.explode(F.from_json("value", "map<string, bigint>")).alias("id", "r"))
    return read.select(F.col("id").cast("bigint").alias("id"), "r")
