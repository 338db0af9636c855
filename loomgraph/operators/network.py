"""Networks as configurations describe them: one registry of layers, each with weights, a kernel for training on a subgraph, and a plan for the whole graph.

Layers join hops 0 to ``order``; each hop has weights of its own, an activation, and scales and offsets of its normalised
outputs (bias norm: each row of a hop; norm-nn: each column of the joined outputs). Attention is without softmax: an edge
weighs leaky(a . own) + leaky(b . other), times its w. As that is a sum of one term a node, the sum over neighbours is
leaky(a . own) * (A h) + A (leaky(b . h) * h): two sums over a node's edges, with all heads side by side. On the whole
graph a layer is a few passes over blocks of nodes and their halos (halo).
Joint attention, of one hop, weighs an edge by max(a . own + b . other + biases, 0) instead, of inputs without activation,
which comes after the sum; there the terms of an edge's two ends meet on the edge. Gates multiply each head by [x | largest neighbour of x W | A x] W'.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import halo as H
from . import wide as W
from .config import Config, Layer
from .tape import Node, Tape

Weights = dict[str, np.ndarray]
Edges = tuple[np.ndarray, np.ndarray, np.ndarray]
SLOPE = 0.2


def _slopes(act: str) -> float | None:
    """Slope below 0 of an activation; None where nothing is done."""
    known = {"I": None, "relu": 0.0, "leaky_relu": SLOPE}
    if act not in known:
        raise ValueError(f"unknown activation {act!r}")
    return known[act]


#: First values of weight matrices by name: (generator, rows, columns) -> matrix.
STARTS: dict[str, Callable[[np.random.Generator, int, int], np.ndarray]] = {
    "glorot": lambda rng, a, b: rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b)),
    "normal": lambda rng, a, b: rng.normal(size=(a, b)) * np.sqrt(2 / (a + b)),
    "uniform": lambda rng, a, b: rng.uniform(-0.05, 0.05, (a, b)),
    "rounded": lambda rng, a, b: np.round(rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b)), 4),
    "zeros": lambda rng, a, b: np.zeros((a, b)),
    "ones": lambda rng, a, b: np.ones((a, b)),
}


def _starting(layer: Layer, rng: np.random.Generator, start: str) -> Weights:
    draw = lambda a, b: STARTS[start](rng, a, b)
    found, d = {}, layer.outputs // layer.heads
    for o in range(layer.order + 1):
        found[f"{o}.w"] = np.concatenate([draw(layer.inputs, d) for _ in range(layer.heads)], 1)
        found[f"{o}.b"] = np.zeros(layer.outputs)
        if layer.bias == "norm":
            found[f"{o}.scale"], found[f"{o}.offset"] = np.ones(layer.outputs), np.zeros(layer.outputs)
        if o < layer.order and layer.kind != "order":
            found[f"{o}.own"], found[f"{o}.other"] = (np.concatenate([draw(1, d) for _ in range(layer.heads)]) for _ in range(2))
    if layer.kind == "joint":
        if layer.order > 1:
            raise ValueError("joint attention reaches one hop")
        found |= {f"0.{name}_b": np.zeros(layer.heads) for name in ("own", "other") if layer.order}
    if layer.kind == "gated":
        found["pool"], found["gate"] = draw(layer.inputs, layer.gate), draw(2 * layer.inputs + layer.gate, layer.heads)
    if layer.bias == "norm-nn":
        found["scale"], found["offset"] = np.ones(layer.width), np.zeros(layer.width)
    return found


@dataclass
class Kind:
    """How a layer's hops come about: on the tape of one subgraph, and on tables of the whole graph."""

    on_tape: Callable[[Tape, Layer, dict[str, Node], Node, Edges], list[Node]]
    on_tables: Callable[[Layer, Weights, DataFrame, H.Links], DataFrame]  # (id, h0, h1, ...), for layers with neighbours
    heads_apart: bool = False  # whether rows are normalised head by head


def _sliced(layer: Layer, h: int) -> tuple[int, int]:
    d = layer.outputs // layer.heads
    return h * d, (h + 1) * d


def _linear(t: Tape, layer: Layer, p: dict[str, Node], x: Node, o: int) -> Node:
    z = t.add(t.matmul(x, p[f"{o}.w"]), p[f"{o}.b"])
    slope = _slopes(layer.act)
    return z if slope is None else t.leaky(z, slope)


def _hops_on_tape(t: Tape, layer: Layer, p: dict[str, Node], x: Node, edges: Edges) -> list[Node]:
    out = [_linear(t, layer, p, x, 0)]
    for o in range(1, layer.order + 1):
        x = t.gathered(*edges, x)
        out.append(_linear(t, layer, p, x, o))
    return out


def _attention_on_tape(t: Tape, layer: Layer, p: dict[str, Node], x: Node, edges: Edges) -> list[Node]:
    out = [_linear(t, layer, p, x, o) for o in range(layer.order + 1)]
    gates = None
    if layer.kind == "gated":
        joined = t.concat([x, t.largest(edges[0], edges[1], t.matmul(x, p["pool"])), t.gathered(*edges, x)])
        gates = t.matmul(joined, p["gate"])
    for o in range(1, layer.order + 1):
        for s in range(o):
            heads = []
            for h in range(layer.heads):
                span = _sliced(layer, h)
                mine, own = t.columns(out[o], *span), t.columns(out[o - s - 1], *span)
                left = t.leaky(t.matmul(own, t.row(p[f"{o - 1}.own"], h)), SLOPE)
                right = t.leaky(t.matmul(mine, t.row(p[f"{o - 1}.other"], h)), SLOPE)
                made = t.add(t.mul(t.gathered(*edges, mine), left), t.gathered(*edges, t.mul(mine, right)))
                heads.append(made if gates is None else t.mul(made, t.columns(gates, h, h + 1)))
            out[o] = t.concat(heads)
    return out


def _joint_on_tape(t: Tape, layer: Layer, p: dict[str, Node], x: Node, edges: Edges) -> list[Node]:
    out = [_linear(t, layer, p, x, 0)]
    if layer.order:
        (src, dst, w), h, heads = edges, t.matmul(x, p["1.w"]), []
        for i in range(layer.heads):
            mine = t.columns(h, *_sliced(layer, i))
            ends = [t.add(t.matmul(mine, t.row(p[f"0.{name}"], i)), t.columns(t.rows(p[f"0.{name}_b"], len(x.value)), i, i + 1)) for name in ("own", "other")]
            score = t.leaky(t.add(t.at(ends[0], src), t.at(ends[1], dst)))
            heads.append(t.pooled(t.scaled(t.mul(t.at(mine, dst), score), w[:, None]), src, len(x.value)))
        z, slope = t.add(t.concat(heads), p["1.b"]), _slopes(layer.act)
        out.append(z if slope is None else t.leaky(z, slope))
    return out


def _activated(act: str, z: np.ndarray) -> np.ndarray:
    slope = _slopes(act)
    return z if slope is None else np.where(z > 0, z, slope * z)


def _hops_on_tables(layer: Layer, p: Weights, nodes: DataFrame, links: H.Links) -> DataFrame:
    names, at = ["x0"], H.dealt(links, nodes, ["x"], lambda own, seen, e: own, ["x0"], ["x0"])
    ended = lambda xs: [_activated(layer.act, x @ p[f"{o}.w"] + p[f"{o}.b"]) for o, x in enumerate(xs)]
    for o in range(1, layer.order + 1):
        last = o == layer.order

        def step(own: list[np.ndarray], seen: list[np.ndarray], edges: Edges, last: bool = last) -> list[np.ndarray]:
            xs = [*own, H.gathered(edges, seen[0], len(own[0]))]
            return ended(xs) if last else xs

        made = [f"{'h' if last else 'x'}{n}" for n in range(o + 1)]
        at = H.passed(links, at, names, names[-1:], step, made, [] if last else made[-1:])
        names = made
    return at


def _per_head(layer: Layer, h: np.ndarray, a: np.ndarray) -> np.ndarray:
    """leaky(a . h) of each head, repeated over the head's columns."""
    z = (h.reshape(len(h), layer.heads, -1) * a).sum(2)
    return np.repeat(np.where(z > 0, z, SLOPE * z), layer.outputs // layer.heads, 1)


def _turns(order: int) -> list[list[tuple[int, int]]]:
    """Applications of attention, pass by pass: one of a hop cannot follow another of it in the pass."""
    turns: list[list[tuple[int, int]]] = [[]]
    for o in range(1, order + 1):
        for s in range(o):
            if o in (hop for hop, _ in turns[-1]):
                turns.append([])
            turns[-1].append((o, s))
    return turns


def _attention_on_tables(layer: Layer, p: Weights, nodes: DataFrame, links: H.Links) -> DataFrame:
    names, wide, gated, turns = [f"h{o}" for o in range(layer.order + 1)], layer.outputs, layer.kind == "gated", _turns(layer.order)
    hops = lambda turn: [f"h{o}" for o, _ in turn]

    def first(own: list[np.ndarray], seen: list[np.ndarray], edges: Edges) -> list[np.ndarray]:
        x = own[0]
        return [*(_activated(layer.act, x @ p[f"{o}.w"] + p[f"{o}.b"]) for o in range(layer.order + 1)), *([x, x @ p["pool"]] if gated else [])]

    more = ["x", "z"] if gated else []
    at = H.dealt(links, nodes, ["x"], first, names + more, hops(turns[0]) + more)
    for n, turn in enumerate(turns):
        last = n == len(turns) - 1

        def step(own: list[np.ndarray], seen: list[np.ndarray], edges: Edges, n: int = n, turn: list[tuple[int, int]] = turn, last: bool = last) -> list[np.ndarray]:
            out, rows = own[: layer.order + 1], len(own[0])
            gates = own[-1] if gated else None
            if gated and not n:
                x, z = seen[-2:]
                gates = np.concatenate([own[-2], H.largest(edges, z, rows), H.gathered(edges, x, rows)], 1) @ p["gate"]
            for (o, s), mine in zip(turn, seen, strict=False):
                met = H.gathered(edges, np.concatenate([mine, mine * _per_head(layer, mine, p[f"{o - 1}.other"])], 1), rows)
                new = met[:, :wide] * _per_head(layer, out[o - s - 1], p[f"{o - 1}.own"]) + met[:, wide:]
                out[o] = new * np.repeat(gates, wide // layer.heads, 1) if gated else new
            return [*out, gates] if gated and not last else out

        made = names + (["gates"] if gated and not last else [])
        at = H.passed(links, at, names + more, hops(turn) + (more if not n else []), step, made, [] if last else hops(turns[n + 1]))
        more = made[len(names) :]
    return at


def _joint_on_tables(layer: Layer, p: Weights, nodes: DataFrame, links: H.Links) -> DataFrame:
    def first(own: list[np.ndarray], seen: list[np.ndarray], edges: Edges) -> list[np.ndarray]:
        h = own[0] @ p["1.w"]
        parts = h.reshape(len(h), layer.heads, -1)
        return [_activated(layer.act, own[0] @ p["0.w"] + p["0.b"]), *((parts * p[f"0.{name}"]).sum(2) + p[f"0.{name}_b"] for name in ("own", "other")), h]

    def met(own: list[np.ndarray], seen: list[np.ndarray], edges: Edges) -> list[np.ndarray]:
        (src, dst, w), (other, h), z = edges, seen, np.zeros((len(own[0]), layer.outputs))
        for i in range(layer.heads):
            span = slice(*_sliced(layer, i))
            score = w * np.maximum(own[1][src, i] + other[dst, i], 0)
            z[:, span] = H.gathered((src, dst, score), h[:, span], len(z))
        return [own[0], _activated(layer.act, z + p["1.b"])]

    at = H.dealt(links, nodes, ["x"], first, ["h0", "own_end", "other_end", "h"], ["other_end", "h"])
    return H.passed(links, at, ["h0", "own_end"], ["other_end", "h"], met, ["h0", "h1"], [])


LAYERS: dict[str, Kind] = {"joint": Kind(_joint_on_tape, _joint_on_tables), "order": Kind(_hops_on_tape, _hops_on_tables), "attention": Kind(_attention_on_tape, _attention_on_tables, True), "gated": Kind(_attention_on_tape, _attention_on_tables)}


def _joined_on_tape(t: Tape, layer: Layer, p: dict[str, Node], hops: list[Node]) -> Node:
    if layer.bias == "norm":
        for o, h in enumerate(hops):
            spans = [_sliced(layer, i) for i in range(layer.heads)] if LAYERS[layer.kind].heads_apart else [(0, layer.outputs)]
            z = t.concat([t.standard(t.columns(h, *span), 1) for span in spans])
            hops[o] = t.add(t.mul(z, p[f"{o}.scale"]), p[f"{o}.offset"])
    if layer.aggr == "concat":
        return t.concat(hops)
    out = hops[0]
    for h in hops[1:]:
        out = t.add(out, h)
    return out


def _standard_rows(layer: Layer, h: np.ndarray) -> np.ndarray:
    parts = h.reshape(len(h), layer.heads if LAYERS[layer.kind].heads_apart else 1, -1)
    return ((parts - parts.mean(2, keepdims=True)) / np.sqrt(parts.var(2, keepdims=True) + 1e-9)).reshape(h.shape)


def outputs(layer: Layer, p: Weights, nodes: DataFrame, edges: DataFrame | H.Links, state: Weights | None = None) -> DataFrame:
    """(id, x): a layer's outputs on the whole graph; columns are normalised by the running values in state."""
    if layer.order:
        made = LAYERS[layer.kind].on_tables(layer, p, nodes, H.linked(edges, nodes))
    else:
        made = W.by_rows(nodes, ["x"], lambda xs: [_activated(layer.act, xs[0] @ p["0.w"] + p["0.b"])], ["h0"])

    def joined(hops: list[np.ndarray]) -> list[np.ndarray]:
        if layer.bias == "norm":
            hops = [_standard_rows(layer, h) * p[f"{o}.scale"] + p[f"{o}.offset"] for o, h in enumerate(hops)]
        x = np.concatenate(hops, 1) if layer.aggr == "concat" else sum(hops[1:], hops[0])
        if layer.bias == "norm-nn":
            x = (x - state["mean"]) / np.sqrt(state["var"] + 1e-9) * p["scale"] + p["offset"]
        return [x]

    return W.by_rows(made, [f"h{o}" for o in range(layer.order + 1)], joined, ["x"])


@dataclass
class Network:
    """The layers of a configuration and a classifier over rows of length 1."""

    layers: list[Layer]
    classifier: Layer
    many: bool  # whether a node may have several classes
    dropout: float = 0.0

    @staticmethod
    def of(config: Config, inputs: int, classes: int) -> Network:
        return Network(config.layers(inputs), config.classifier(inputs, classes), config.network["loss"] == "sigmoid", float(config.params["dropout"]))

    def initial(self, seed: int = 0, start: str = "glorot") -> tuple[Weights, Weights]:
        """(weights, running means and variances of the layers that normalise columns)."""
        rng = np.random.default_rng(seed)
        weights = {f"{n}/{k}": v for n, layer in enumerate([*self.layers, self.classifier]) for k, v in _starting(layer, rng, start).items()}
        state = {f"{n}/{k}": v for n, layer in enumerate(self.layers) if layer.bias == "norm-nn" for k, v in (("mean", np.zeros(layer.width)), ("var", np.ones(layer.width)))}
        return weights, state

    def _of(self, n: int, weights: dict) -> dict:
        return {k.partition("/")[2]: v for k, v in weights.items() if k.startswith(f"{n}/")}

    def scores(self, t: Tape, p: dict[str, Node], x: np.ndarray, edges: Edges, seed: int | None = None) -> tuple[Node, Weights]:
        """(scores of the rows of a subgraph, column means and variances met on the way); a seed draws what is dropped."""
        rng, met, h = np.random.default_rng(seed), {}, Node(x)
        for n, layer in enumerate([*self.layers, self.classifier]):
            mine = self._of(n, p)
            if n == len(self.layers):
                h = t.unit(h)
            if self.dropout and seed is not None:
                h = t.scaled(h, (rng.random(h.value.shape) >= self.dropout) / (1 - self.dropout))
            h = _joined_on_tape(t, layer, mine, LAYERS[layer.kind].on_tape(t, layer, mine, h, edges))
            if layer.bias == "norm-nn":
                rows = max(len(h.value) - 1, 1)
                met |= {f"{n}/mean": h.value.mean(0), f"{n}/var": h.value.var(0) * len(h.value) / rows}
                h = t.add(t.mul(t.standard(h, 0), mine["scale"]), mine["offset"])
        return h, met

    def loss(self, weights: Weights, x: np.ndarray, y: np.ndarray, lam: np.ndarray, edges: Edges, seed: int | None = None, decay: float = 0.0) -> tuple[float, Weights, Weights, np.ndarray]:
        """(weighted cross entropy of a subgraph, its gradient, column means and variances, scores); decay weighs half the squares of all weight matrices."""
        t, p = Tape(), {k: Node(v) for k, v in weights.items()}
        out, met = self.scores(t, p, x, edges, seed)
        z = out.value
        if self.many:
            loss = float((lam[:, None] * (np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z))))).sum())
            dz = (1 / (1 + np.exp(-z)) - y) * lam[:, None]
        else:
            z = z - z.max(1, keepdims=True)
            q, at = np.exp(z) / np.exp(z).sum(1, keepdims=True), np.arange(len(y))
            loss = float((lam * -np.log(np.maximum(q[at, y], 1e-300))).sum())
            q[at, y] -= 1
            dz = q * lam[:, None]
        t.backward(out, dz)
        matrix = lambda k: decay and weights[k].ndim > 1
        loss += sum(decay / 2 * float((v * v).sum()) for k, v in weights.items() if matrix(k))
        grad = {k: (node.grad if node.grad is not None else np.zeros_like(weights[k])) + (decay * weights[k] if matrix(k) else 0) for k, node in p.items()}
        return loss, grad, met, out.value

    def evaluate(self, weights: Weights, state: Weights, nodes: DataFrame, edges: DataFrame | H.Links, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
        """(id, x): scores on the whole graph, nodes (id, x), edges (src, dst, w); keep() may write each layer's outputs down."""
        h, links = nodes.select("id", F.col("x").cast("array<double>").alias("x")), H.linked(edges, nodes)
        for n, layer in enumerate(self.layers):
            h = keep(outputs(layer, self._of(n, weights), h, links, self._of(n, state)))
        unit = W.by_rows(h, ["x"], lambda xs: [xs[0] / np.sqrt(np.maximum((xs[0] ** 2).sum(1, keepdims=True), 1e-12))], ["x"])
        return outputs(self.classifier, self._of(len(self.layers), weights), unit, links)
