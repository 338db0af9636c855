"""Training configurations: networks, parameters and phases, with defaults, and the layers that they describe."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession

#: What a configuration need not say.
NETWORK = {"dim": -1, "aggr": "concat", "loss": "softmax", "arch": "1", "act": "I", "bias": "norm"}
PARAMS = {"lr": 0.01, "weight_decay": 0.0, "norm_loss": True, "norm_aggr": True, "q_threshold": 50, "q_offset": 0, "dropout": 0.0, "sample_coverage": 50, "eval_val_every": 1}
#: Sizes that each sampler needs.
SIZES = {"mrw": ("size_subgraph", "size_frontier"), "rw": ("num_root", "depth"), "edge": ("size_subg_edge",), "node": ("size_subgraph",), "vanilla_node_python": ("size_subgraph",), "full_batch": ()}


@dataclass
class Layer:
    """One layer: neighbours up to ``order`` steps away, each hop with weights of inputs x outputs.

    kind names it in the registry of layers: order (sums over neighbours), attention, joint (attention) or gated.
    """

    order: int
    inputs: int
    outputs: int
    act: str
    bias: str
    aggr: str
    heads: int = 1
    kind: str = "order"
    gate: int = 64

    @property
    def width(self) -> int:
        return self.outputs * (self.order + 1 if self.aggr == "concat" else 1)

    def parameters(self) -> int:
        """Weights and biases, and scales and offsets if outputs are normalised.

        With attention, biases do not count, scales and offsets always do, and each hop but the first has a vector for
        both ends of an edge; gates add the weights of the pooled and of the joined inputs.
        """
        if self.kind == "order":
            return (self.order + 1) * self.outputs * (self.inputs + 1 + (2 if self.bias != "bias" else 0))
        found = (self.order + 1) * self.outputs * (self.inputs + 2) + self.order * 2 * self.outputs
        return found + (self.inputs * self.gate + (2 * self.inputs + self.gate) * self.heads if self.kind == "gated" else 0)


@dataclass
class Config:
    network: dict[str, Any]
    params: dict[str, Any]
    phases: list[dict[str, Any]]

    def layers(self, inputs: int) -> list[Layer]:
        """The layers of the architecture, such as 1-0-1: a number is a layer's order."""
        net, found = self.network, []
        kind = "order" if "attention" not in net else "gated" if net.get("gated_attention") else str(net.get("attention_kind", "attention"))
        for order in map(int, str(net["arch"]).split("-")):
            found.append(Layer(order, found[-1].width if found else inputs, net["dim"], net["act"], net["bias"], net["aggr"], int(net.get("attention", 1)), kind, int(net.get("dim_gate", 64))))
        return found

    def conv_layers(self, inputs: int) -> list[int]:
        """Numbers of the layers whose outputs a last layer over all of them reads.

        Those are the layer before each further one with neighbours, and the last; where no two of them that follow each
        other have the same order, they are the layers of order 1 instead.
        """
        orders = [layer.order for layer in self.layers(inputs)]
        with_neighbours = [n for n, order in enumerate(orders) if order >= 1]
        found = [n - 1 for n in with_neighbours[1:]] + [len(orders) - 1]
        if any(orders[a] == orders[b] for a, b in zip(found, found[1:], strict=False)):
            return found
        return [n for n, order in enumerate(orders) if order == 1]

    def classifier(self, inputs: int, classes: int) -> Layer:
        return Layer(0, self.layers(inputs)[-1].width, classes, "I", "bias", "mean")

    def parameters(self, inputs: int, classes: int) -> int:
        return sum(layer.parameters() for layer in [*self.layers(inputs), self.classifier(inputs, classes)])


def configuration(told: dict[str, Any]) -> Config:
    """A configuration from what a file says: {network: [{...}], params: [{...}], phase: [{end, sampler, sizes}]}."""
    first = lambda name: (told.get(name) or [{}])[0]
    phases, last = list(told.get("phase") or []), 0
    for phase in phases:
        if phase.get("sampler") not in SIZES:
            raise ValueError(f"unknown sampler {phase.get('sampler')!r}")
        missing = [name for name in ("end", *SIZES[phase["sampler"]]) if name not in phase]
        if missing:
            raise ValueError(f"a phase of {phase['sampler']} lacks {', '.join(missing)}")
        if int(phase["end"]) <= last:
            raise ValueError("phases must end one after the other")
        last = int(phase["end"])
    return Config(NETWORK | first("network"), PARAMS | first("params"), phases)


def read_config(spark: SparkSession, path: str) -> Config:
    """From a YAML (where a YAML library is installed) or JSON file, by Spark's reader."""
    import json

    (row,) = spark.read.text(path, wholetext=True).collect()
    if path.endswith(".json"):
        return configuration(json.loads(row["value"]))
    import yaml

    return configuration(yaml.safe_load(row["value"]))
