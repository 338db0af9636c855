"""Graph sources: any reader of edges, features and labels, with a split and a scaling, as the tables that all else works on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graphs as G
from .files import class_map, register, roles, scaled

Reader = Callable[[], DataFrame]


@dataclass
class GraphSource:
    """edges (src, dst), features (id, x), labels (id, y) and roles (id, role), each read when tables() is called.

    Without roles of its own, a source is split by hash at two hundredths; scale fits means and deviations on the training
    nodes that have training edges, and constant columns are only centred.
    """

    edges: Reader
    features: Reader
    labels: Reader
    roles: Reader | None = None
    split: tuple[int, int] = (85, 90)
    scale: bool = True

    def tables(self) -> G.GraphTables:
        edges, x = self.edges(), self.features().select("id", F.col("x").cast("array<double>").alias("x"))
        nodes = self.roles() if self.roles else G.split_roles(x.select("id"), *self.split)
        if self.scale:
            x = scaled(x, G.induced_by_role(edges, nodes).select(F.col("src").alias("id")))
        return G.GraphTables(nodes, edges, x.select("id", F.posexplode("x").alias("j", "v")), self.labels(), x)


def parts(spark: SparkSession, sf_dir: str) -> GraphSource:
    """Parts bought together; brands are their classes."""
    g = G.part_graph(spark, sf_dir)
    return GraphSource(lambda: g.edges, lambda: g.arrays, lambda: g.labels)


def documents(spark: SparkSession, sf_dir: str, langs: tuple[str, ...] = ("de", "en", "es", "fr")) -> GraphSource:
    """Documents that follow each other; length and language are their features, (quality, toxic) flags their classes, zeros where nobody told."""
    docs, told = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    x = docs.select(F.col("doc_id").alias("id"), F.array(F.coalesce("n_chars", F.lit(0)).cast("double"), *(F.coalesce((F.col("lang") == lang).cast("double"), F.lit(0.0)) for lang in langs)).alias("x"))
    y = docs.select("doc_id").join(told, "doc_id", "left").select(F.col("doc_id").alias("id"), F.array(F.coalesce("quality", F.lit(0)), F.coalesce("toxic", F.lit(0))).alias("y"))
    return GraphSource(lambda: G.document_graph(spark, sf_dir), lambda: x, lambda: y, split=(75, 85))


def embeddings(spark: SparkSession, sf_dir: str) -> GraphSource:
    """Vectors in rings of their labels, which are their classes."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"), F.col("label").alias("y"))
    return GraphSource(lambda: G.embedding_graph(spark, sf_dir), lambda: rows.select("id", "x"), lambda: rows.select("id", "y"), split=(50, 75))


def folder(spark: SparkSession, path: str, scale: bool = True) -> GraphSource:
    """The array and JSON files of a data folder; single classes become (id, y), several (id, flags)."""
    register(spark)
    told = class_map(spark, f"{path}/class_map.json")
    many = told.where("y = 0").limit(1).count() > 0
    y = told.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("cls", "y"))), lambda e: e["y"]).alias("y")) if many else told.select("id", F.col("cls").alias("y"))
    return GraphSource(lambda: spark.read.format("npz_csr").load(f"{path}/adj_full.npz"), lambda: spark.read.format("npy_matrix").load(f"{path}/feats.npy"), lambda: y, lambda: roles(spark, f"{path}/role.json"), scale=scale)


#: Sources by name, over a folder of tables.
SOURCES: dict[str, Callable[[SparkSession, str], GraphSource]] = {"parts": parts, "documents": documents, "embeddings": embeddings, "folder": folder}
