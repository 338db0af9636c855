"""Constants and shared inputs of the named queries."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import cached_property

import numpy as np

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import u32
from ..operators.config import Layer
from ..operators.halo import Links
from ..operators.network import Network
from ..operators.samplers import Prepared, induced, random_walk
from ..sources.graphs import GraphTables, bought, induced_by_role, part_graph

SAMPLES, ROOTS, DEPTH, DRAWS = 20, 60, 2, 100
#: Bits of the multi-hot label of a document, and classes of predictions.
CLASSES = 5
#: Added before rounding: means of whole numbers often lie on halves, where sums in another order fall to either side.
OFF_HALVES = 0.00012345


class Context:
    """Lazy inputs of one call: the part graph and everything derived from it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.graph: GraphTables = part_graph(spark, sf_dir)
        self.train_ids = self.graph.ids()
        self.train_edges = induced_by_role(self.graph.edges, self.graph.nodes)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def scratch(self) -> str:
        """A new folder in the one that the cluster shares; a temporary one only in local mode, where all tasks share the machine."""
        shared, master = self.spark.conf.get("spark.checkpoint.dir", None), self.spark.sparkContext.master
        if not shared:
            if master != "local" and not master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = "file://" + tempfile.mkdtemp(prefix="spark-loomgraph-")
        return f"{shared.rstrip('/')}/graph-{uuid.uuid4().hex}"

    @cached_property
    def prepared(self) -> Prepared:
        """Each relation is written once and read back, for those built on it and the joins that a sampler and its norms put on top."""
        path = self.scratch()

        def keep(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(f"{path}/{name}")
            return self.spark.read.schema(df.schema).parquet(f"{path}/{name}")

        return Prepared.of(self.train_edges, self.train_ids, keep)

    @cached_property
    def links(self) -> Links:
        """The edges of the part graph, weighing means over neighbours, from orders that are dealt to blocks of parts once."""
        return Links.of_groups(bought(self.table("lineitem")), self.graph.nodes)

    def walks(self) -> tuple[Prepared, DataFrame]:
        g = self.prepared
        return g, random_walk(g, SAMPLES, ROOTS, DEPTH)

    def subgraphs(self) -> tuple[Prepared, DataFrame, DataFrame]:
        g, s = self.walks()
        return g, s, induced(s, g.edges)

    def scores(self) -> DataFrame:
        """(id, j, v): integer pseudo-scores of CLASSES classes for every part, and its true class."""
        y = self.table("part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("int").alias("p_size")).select("id", (F.col("p_size") % CLASSES).cast("int").alias("y"))
        return y.select("id", "y", F.explode(F.sequence(F.lit(0), F.lit(CLASSES - 1))).alias("j")).withColumn("v", (u32("score", "id", "j") % 1000 - 500).cast("bigint"))


def weights(spark: SparkSession, rows: int, columns: int) -> DataFrame:
    """(i, j, w) small integer layer weights."""
    i = spark.range(rows).select(F.col("id").cast("int").alias("i"))
    return i.select("i", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("j")).withColumn("w", ((F.col("i") + 1) * (F.col("j") + 2) % 5 - 2).cast("bigint"))


#: Layer weights by formula, alike in Python and in SQL: quarters from small remainders.
FORMULAS = {
    "w": "((({o} + 1) * ({i} + 1) * ({c} + 2)) % 5 - 2) / 4.0",
    "b": "(({o} + {c}) % 3 - 1) / 2.0",
    "own": "(({o} + 2 * {h} + 3 * {k}) % 5 - 2) / 4.0",
    "other": "((2 * {o} + {h} + {k}) % 5 - 2) / 4.0",
    "own_b": "(1 + {h}) / 4.0",
    "other_b": "(1 - {h}) / 2.0",
    "scale": "1 + (({o} + {c}) % 3) / 2.0",
    "offset": "({c} % 2) / 4.0",
    "pool": "((({i} + 2) * ({c} + 1)) % 5 - 2) / 4.0",
    "gate": "((({i} + 1) * ({c} + 3)) % 7 - 3) / 8.0",
}


def _made(name: str, shape: tuple[int, ...], letters: str, o: int = 0) -> np.ndarray:
    at = dict(zip(letters, np.indices(shape), strict=True)) | {"o": o}
    return np.broadcast_to(eval(FORMULAS[name].format(**{k: k for k in "oichk"}), {}, at), shape).astype(float)  # noqa: S307


def formula_weights(layer: Layer) -> dict[str, np.ndarray]:
    d, found = layer.outputs // layer.heads, {}
    for o in range(layer.order + 1):
        found |= {f"{o}.w": _made("w", (layer.inputs, layer.outputs), "ic", o), f"{o}.b": _made("b", (layer.outputs,), "c", o)}
        found |= {f"{o}.{n}": _made(n, (layer.outputs,), "c", o) for n in ("scale", "offset")} | {f"{o}.{n}": _made(n, (layer.heads, d), "hk", o) for n in ("own", "other")}
    found |= {f"0.{n}_b": _made(f"{n}_b", (layer.heads,), "h") for n in ("own", "other")}
    return found | {"pool": _made("pool", (layer.inputs, layer.gate), "ic"), "gate": _made("gate", (2 * layer.inputs + layer.gate, layer.heads), "ic")}


#: Layers that queries apply: sums of two hops, attention of two heads and two hops, gated attention of two heads.
LAYERS: dict[str, tuple[Layer, Callable[[], dict[str, np.ndarray]]]] = {
    name: (layer, lambda layer=layer: formula_weights(layer))
    for name, layer in {
        "mixhop_order2": Layer(2, 4, 4, "relu", "norm", "concat"),
        "gat_heads": Layer(2, 4, 8, "relu", "norm", "concat", 2, "attention"),
        "gat_mean": Layer(1, 4, 8, "relu", "bias", "mean", 1, "attention"),
        "gat_joint": Layer(1, 4, 8, "relu", "norm", "concat", 2, "joint"),
        "gaan_layer": Layer(1, 4, 8, "relu", "norm", "concat", 2, "gated", 3),
    }.items()
}

#: A whole network: sums of two hops, rows of length 1, and five classes.
NETWORK = Network([LAYERS["mixhop_order2"][0]], Layer(0, 12, 5, "I", "bias", "mean"), False)


def network_weights() -> dict[str, np.ndarray]:
    return {f"{n}/{k}": v for n, layer in enumerate([*NETWORK.layers, NETWORK.classifier]) for k, v in formula_weights(layer).items()}
