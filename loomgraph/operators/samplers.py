"""Graph samplers as deterministic relational plans: every call returns many samples (sg, v) at once.

A registry maps names to samplers; a custom sampler is any function (Prepared, num_samples, **sizes) -> DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rng import below, below_py
from ..sources.graphs import degrees, indexed
from .windows import ranked, running_total

#: Weights of edge draws are this multiple of 1/deg_u + 1/deg_v, rounded down, so that running totals are exact.
EDGE_SCALE = 1_000_000_000


@dataclass
class Prepared:
    """Training graph with what all samplers need: ids (id, r), edges (eid, src, dst, k), deg (id, deg)."""

    ids: DataFrame
    edges: DataFrame
    deg: DataFrame

    @staticmethod
    def of(edges: DataFrame, train_ids: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> Prepared:
        """keep() may write a relation down before the next one is built on it."""
        ids = keep(ranked(train_ids.select("id"), "id", "r"), "ids")
        edges = keep(edges, "train_edges")
        deg = keep(degrees(edges, ids), "deg")
        return Prepared(ids, keep(indexed(edges, deg), "edges"), deg)


def draws(like: DataFrame, samples: int, size: int, start: int = 0) -> DataFrame:
    """(sg, i) for every draw of every sample; samples are numbered from start on."""
    return like.sparkSession.range(start * size, (start + samples) * size).select(F.expr(f"id div {size}").alias("sg"), (F.col("id") % size).alias("i"))


def _scalar(df: DataFrame, agg: F.Column, name: str) -> DataFrame:
    """One row with one number, to be broadcast."""
    return F.broadcast(df.agg(agg.alias(name)))


def uniform(g: Prepared, samples: int, size: int, tag: str, start: int = 0) -> DataFrame:
    """(sg, i, v): training nodes drawn uniformly with replacement."""
    n = _scalar(g.ids, F.count(F.lit(1)), "n")
    drawn = draws(g.ids, samples, size, start).crossJoin(n).where("n > 0").withColumn("r", below(F.col("n"), tag, "sg", "i"))
    return drawn.join(g.ids, "r").select("sg", "i", F.col("id").alias("v"))


def vanilla_node(g: Prepared, samples: int = 20, size: int = 100, start: int = 0) -> DataFrame:
    return uniform(g, samples, size, "vanilla", start).select("sg", "v").distinct()


def hop(g: Prepared, at: DataFrame, tag: str, *counters: F.Column, also: tuple[str, ...] = ()) -> DataFrame:
    """(sg, i, v) one uniform step on, with the columns in also as they are; a node without edges stays."""
    here = at.join(g.deg, at.v == g.deg.id, "left").select("sg", "i", *also, "v", F.when(F.col("deg") > 0, below(F.when(F.col("deg") > 0, F.col("deg")), tag, "sg", "i", *counters)).alias("k"))
    return here.join(g.edges.select(F.col("src").alias("v"), "k", "dst"), ["v", "k"], "left").select("sg", "i", *also, F.coalesce("dst", "v").alias("v"))


def random_walk(g: Prepared, samples: int = 20, roots: int = 60, depth: int = 2, start: int = 0) -> DataFrame:
    at = uniform(g, samples, roots, "root", start)
    seen = at
    for d in range(1, depth + 1):
        at = hop(g, at, f"hop{d}")
        seen = seen.unionByName(at)
    return seen.select("sg", "v").distinct()


def node(g: Prepared, samples: int = 20, size: int = 100, exact: bool = False, start: int = 0) -> DataFrame:
    """Draws in proportion to degree: a uniform edge position's owner. By default draw s takes position max(s - 1, 0), as a lower bound over running totals does; exact takes s itself."""
    m = _scalar(g.edges, F.count(F.lit(1)), "m")
    s = below(F.col("m"), "n", "sg", "i")
    drawn = draws(g.ids, samples, size, start).crossJoin(m).where("m > 0").withColumn("eid", s if exact else F.greatest(s - 1, F.lit(0)))
    return drawn.join(g.edges.select("eid", "src"), "eid").select("sg", F.col("src").alias("v")).distinct()


def edge_weights(g: Prepared) -> DataFrame:
    """(eid, src, dst, w): integer weights of the upper triangle, diagonal included, in the order of eid."""
    d = g.deg
    upper = g.edges.where("src <= dst").join(d.select(F.col("id").alias("src"), F.col("deg").alias("ds")), "src").join(d.select(F.col("id").alias("dst"), F.col("deg").alias("dd")), "dst")
    return upper.select("eid", "src", "dst", F.floor(EDGE_SCALE * (1 / F.col("ds") + 1 / F.col("dd"))).cast("bigint").alias("w"))


def edge_cumulative(g: Prepared) -> DataFrame:
    return running_total(edge_weights(g), "eid", "w", "hi")


def edge(g: Prepared, samples: int = 20, size: int = 100, start: int = 0) -> DataFrame:
    """Edges drawn with replacement in proportion to 1/deg_u + 1/deg_v; both ends stay.

    The range lookup lo < s <= hi is an equi join: intervals are laid over buckets as wide as the mean weight.
    """
    cum = edge_cumulative(g)
    one = F.broadcast(cum.agg(F.max("hi").alias("total"), F.count(F.lit(1)).alias("m")))
    cum = cum.crossJoin(one).withColumn("width", F.greatest(F.expr("total div m"), F.lit(1)))
    lo = F.col("hi") - F.col("w")
    laid = cum.select("src", "dst", lo.alias("lo"), "hi", F.explode(F.sequence(F.expr("(hi - w) div width"), F.expr("hi div width"))).alias("b"))
    s = below(F.col("total"), "e", "sg", "i")
    drawn = draws(g.ids, samples, size, start).crossJoin(one).where("m > 0").withColumn("s", s).withColumn("b", F.expr("s div greatest(total div m, 1)"))
    hit = drawn.join(laid, "b").where("(lo < s and s <= hi) or (s = 0 and lo = 0)")
    return hit.select("sg", F.explode(F.array("src", "dst")).alias("v")).distinct()


#: Draws of an edge are whole numbers below this, far finer than the chance of an edge among 10**13; and the samples that
#: one row of an edge stands for.
DRAWS, TOGETHER = 1 << 62, 64


def _jump(p: F.Column, *counters: F.Column) -> F.Column:
    """How many samples an edge lets pass before the next that keeps it: geometric, by inversion."""
    u = (below(F.lit(DRAWS), "b", *counters).cast("double") + 0.5) / float(DRAWS)
    return F.floor(F.ln(u) / F.log1p(-p))


def edge_bernoulli(g: Prepared, samples: int = 20, size: int = 100, start: int = 0) -> DataFrame:
    """Each sample keeps each upper-triangle edge on its own with probability p = size * w / total; one pass, no lookup.

    An edge jumps from a sample that keeps it to the next that does, so that the work is one draw for every TOGETHER
    samples of an edge, and one for each that it is kept by. Edges with p of 1 or more are kept by all.
    """
    w = edge_weights(g)
    total = _scalar(w, F.sum("w"), "total")
    blocks = w.sparkSession.range(-(-samples // TOGETHER)).select((F.col("id") * TOGETHER).alias("low"), F.least((F.col("id") + 1) * TOGETHER, F.lit(samples)).alias("high"))
    chance = w.crossJoin(total).select("eid", "src", "dst", ((F.col("w") * size).cast("double") / F.col("total").cast("double")).alias("p"))
    rows = chance.crossJoin(F.broadcast(blocks))
    drawn = rows.where("p < 1").withColumn("at", F.col("low") + _jump(F.col("p"), F.col("eid"), F.col("low") + start, F.lit(0))).where("at < high")

    def further(found: F.Column, n: F.Column) -> F.Column:
        last = F.element_at(found, -1)
        return F.when(last < F.col("high"), F.concat(found, F.array(last + 1 + _jump(F.col("p"), F.col("eid"), F.col("low") + start, n)))).otherwise(found)

    kept = F.aggregate(F.sequence(F.lit(1), F.lit(TOGETHER)), F.array("at"), further)
    some = drawn.select("src", "dst", F.explode(F.filter(kept, lambda x: x < F.col("high"))).alias("at"))
    always = rows.where("p >= 1").select("src", "dst", F.explode(F.sequence("low", F.col("high") - 1)).alias("at"))
    return some.unionByName(always).select((F.col("at") + start).alias("sg"), F.explode(F.array("src", "dst")).alias("v")).distinct()


def full_batch(g: Prepared, samples: int = 20, start: int = 0) -> DataFrame:
    return g.ids.select("id").crossJoin(F.broadcast(g.ids.sparkSession.range(start, start + samples).withColumnRenamed("id", "sg"))).select("sg", F.col("id").alias("v"))


def _scheduled(steps: int):
    """(sg, chain of (i, n, v, d)) -> (sg, nodes met, whether a chain was too short): which place of the frontier moves is drawn in proportion to the degrees that stand there."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            met, short = [], []
            for sg, chain in zip(frame["sg"], frame["chain"], strict=True):
                i, n, v, d = (np.array([link[c] for link in chain]) for c in ("i", "n", "v", "d"))
                shape = int(i.max()) + 1, int(n.max()) + 1
                nodes, degrees = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
                nodes[i, n], degrees[i, n] = v, d
                at, places = np.zeros(shape[0], np.int64), np.arange(shape[0])
                ended = False
                for step in range(steps):
                    upto = np.cumsum(degrees[places, at])
                    if not upto[-1]:
                        break
                    place = int(np.searchsorted(upto, below_py(int(upto[-1]), "mrw-pick", sg, step), "right"))
                    at[place] += 1
                    ended = at[place] == shape[1]
                    if ended:
                        break
                met.append([] if ended else np.unique(nodes[np.arange(shape[1]) <= at[:, None]]).tolist())
                short.append(ended)
            yield pd.DataFrame({"sg": frame["sg"], "met": met, "short": short})

    return run


def frontier(g: Prepared, samples: int = 20, size: int = 100, frontier_size: int = 30, cap: int = 10000, start: int = 0) -> DataFrame:
    """Multi-dimensional random walk: of a frontier of nodes one is popped in proportion to its degree, up to cap, and a uniform neighbour takes its place, size - frontier_size times.

    Where a place goes when it moves does not depend on the other places. So the walks of all places of all samples are
    drawn ahead, by the joins of plain random walks, and only then is it decided which place moves when; that needs a few
    numbers a sample. Where a place moves more often than its walk is long, all walks are drawn twice as long.
    """
    steps = max(size - frontier_size, 0)
    length = 2 * -(-steps // frontier_size) + 2
    while True:
        at = uniform(g, samples, frontier_size, "frontier", start).withColumn("path", F.array("v"))
        for n in range(1, length):
            at = hop(g, at, "mrw", F.lit(n), also=("path",)).withColumn("path", F.concat("path", F.array("v")))
        chains = at.select("sg", "i", F.posexplode("path").alias("n", "v"))
        known = chains.join(g.deg, chains.v == g.deg.id).select("sg", F.struct(F.col("i").cast("int").alias("i"), "n", "v", F.least("deg", F.lit(cap)).cast("bigint").alias("d")).alias("link"))
        rows = known.groupBy("sg").agg(F.collect_list("link").alias("chain"))  # frontier_size times length numbers
        walked = rows.mapInPandas(_scheduled(steps), "sg bigint, met array<bigint>, short boolean").persist()
        if walked.where("short").isEmpty() or length > steps:
            return walked.select("sg", F.explode("met").alias("v"))
        walked.unpersist()
        length = min(2 * length, steps + 1)


def covering(sampler: Callable[..., DataFrame], g: Prepared, coverage: float, first: int = 200, **sizes: int) -> tuple[DataFrame, int]:
    """(samples, their number): a pool whose samples hold more than ``coverage`` times the training nodes, doubled until it does.

    Only the samples that a doubling adds are drawn and counted; sample numbers seed the draws.
    """
    nodes, number, held = g.ids.count(), first, 0
    pool = new = sampler(g, number, **sizes)
    while nodes and (held := held + new.count()) <= coverage * nodes:
        new = sampler(g, number, start=number, **sizes)
        pool, number = pool.unionByName(new), 2 * number
    return pool, number


SAMPLERS: dict[str, Callable[..., DataFrame]] = {"rw": random_walk, "node": node, "edge": edge, "edge_bernoulli": edge_bernoulli, "mrw": frontier, "full_batch": full_batch, "vanilla_node_python": vanilla_node}


def budget(name: str, train_nodes: int, **sizes: int) -> int:
    """Nodes that a sample of this sampler aims at."""
    rules = {"mrw": lambda s: s["size_subgraph"], "node": lambda s: s["size_subgraph"], "vanilla_node_python": lambda s: s["size_subgraph"], "rw": lambda s: s["num_root"] * s["depth"], "edge": lambda s: 2 * s["size_subg_edge"], "full_batch": lambda s: train_nodes}
    return rules[name](sizes)


#: What a phase of a configuration calls the sizes of a sampler.
NAMES = {
    "rw": {"num_root": "roots", "depth": "depth"},
    "node": {"size_subgraph": "size"},
    "vanilla_node_python": {"size_subgraph": "size"},
    "edge": {"size_subg_edge": "size"},
    "mrw": {"size_subgraph": "size", "size_frontier": "frontier_size", "deg_clip": "cap"},
    "full_batch": {},
}


def of_phase(phase: dict) -> Callable[[Prepared, int, int], DataFrame]:
    """The sampler of a configuration's phase: (graph, number of samples, number of the first one) -> (sg, v)."""
    name = phase["sampler"]
    sizes = {ours: int(phase[theirs]) for theirs, ours in NAMES.get(name, {k: k for k in phase if k not in ("sampler", "end")}).items() if theirs in phase}
    return lambda g, samples, start: SAMPLERS[name](g, samples, start=start, **sizes)


def induced(samples: DataFrame, edges: DataFrame) -> DataFrame:
    """(sg, eid, src, dst, lsrc, ldst): edges with both ends in the sample, ends renumbered by rank."""
    from .windows import local_ids

    ids = local_ids(samples)
    first = edges.join(ids.select("sg", F.col("v").alias("src"), F.col("lid").alias("lsrc")), "src")
    return first.join(ids.select("sg", F.col("v").alias("dst"), F.col("lid").alias("ldst")), ["sg", "dst"]).select("sg", "eid", "src", "dst", "lsrc", "ldst")
