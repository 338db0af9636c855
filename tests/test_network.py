"""Layers by configuration: gradients against differences, the whole-graph plan against the kernel, running statistics."""

import glob
import json
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import config, halo, phases, samplers
from loomgraph.operators import network as network_module
from loomgraph.operators import pool as pool_module
from loomgraph.operators.network import Network
from loomgraph.operators.tape import Node, Tape
from loomgraph.sources import graphs, metrics_table
from loomgraph.sources.graphs import GraphTables

CASES = {
    "hops": {"arch": "2-0-1", "dim": 4, "act": "relu", "bias": "norm", "aggr": "concat"},
    "mean": {"arch": "1-1", "dim": 4, "act": "relu", "bias": "bias", "aggr": "mean", "loss": "sigmoid"},
    "columns": {"arch": "1-0", "dim": 4, "act": "relu", "bias": "norm-nn", "aggr": "concat"},
    "attention": {"arch": "2-0", "dim": 4, "act": "relu", "bias": "norm", "aggr": "concat", "attention": 2},
    "one head": {"arch": "1", "dim": 3, "act": "I", "bias": "bias", "aggr": "mean", "attention": 1},
    "joint": {"arch": "1-0-1", "dim": 4, "act": "relu", "bias": "norm", "aggr": "concat", "attention": 2, "attention_kind": "joint"},
    "gated": {"arch": "1-1", "dim": 4, "act": "relu", "bias": "norm", "aggr": "concat", "attention": 2, "gated_attention": True, "dim_gate": 3},
    "gated order 2": {"arch": "2", "dim": 4, "act": "leaky_relu", "bias": "norm-nn", "aggr": "mean", "attention": 2, "gated_attention": True, "dim_gate": 3},
}


def network(name, dropout=0.0):
    return Network.of(config.configuration({"network": [CASES[name]], "params": [{"dropout": dropout}]}), 3, 3)


def made(seed=1, n=7):
    rng = np.random.default_rng(seed)
    src, dst = np.array([0, 0, 1, 2, 3, 4, 4, 5]), np.array([1, 2, 0, 3, 2, 5, 0, 4])
    return rng.normal(size=(n, 3)), rng.integers(0, 3, n), rng.uniform(0.1, 1, n), (src, dst, rng.uniform(0.2, 1, len(src)))


def moved(net, seed=4):
    rng = np.random.default_rng(seed)
    weights, state = net.initial(2)
    return {k: v + rng.normal(size=v.shape) * 0.3 for k, v in weights.items()}, state


@pytest.mark.parametrize("name", CASES)
def test_gradient_against_differences(name):
    net = network(name, 0.2)
    weights, _ = moved(net)
    x, y, lam, edges = made()
    y = np.eye(3, dtype=int)[y] if net.many else y
    args = (x, y, lam, edges, 5, 0.1)
    _, grad, *_ = net.loss(weights, *args)
    for key, value in weights.items():
        for at in list(np.ndindex(value.shape))[:12]:
            both = []
            for step in (1e-6, -1e-6):
                other = weights | {key: value.copy()}
                other[key][at] += step
                both.append(net.loss(other, *args)[0])
            assert abs((both[0] - both[1]) / 2e-6 - grad[key][at]) < 2e-5, (key, at)


@pytest.mark.parametrize("name", CASES)
def test_whole_graph_plan_equals_the_kernel(spark, name):
    net = network(name)
    weights, state = moved(net)
    x, _, _, edges = made()
    # columns are normalised by running values on the whole graph: those of this graph make both the same
    t = Tape()
    scores, met = net.scores(t, {k: Node(v) for k, v in weights.items()}, x, edges)
    n = len(x)
    state = {k: v * (n - 1) / n if k.endswith("var") else v for k, v in met.items()}
    nodes = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, x array<double>")
    links = spark.createDataFrame([(int(a), int(b), float(w)) for a, b, w in zip(*edges, strict=True)], "src bigint, dst bigint, w double")
    got = {r.id: r.x for r in net.evaluate(weights, state, nodes, links).collect()}
    assert np.allclose([got[i] for i in range(n)], scores.value, atol=1e-9)


def test_parameters_are_those_that_are_made():
    for name in ("hops", "mean"):
        net = network(name)
        c = config.configuration({"network": [CASES[name]]})
        assert c.parameters(3, 3) == sum(v.size for v in net.initial()[0].values())
    one, two = (config.configuration({"network": [CASES[k] | {"dim": 4}]}).layers(3)[0].parameters() for k in ("one head", "attention"))
    assert one == 2 * (3 * 4 + 8) + 8 and two == 3 * (3 * 4 + 8) + 16


def test_layers_that_a_last_layer_reads():
    of = lambda arch: config.configuration({"network": [{"arch": arch, "dim": 2}]}).conv_layers(3)
    assert [of(a) for a in ("1-0-1", "1-1-0", "1-1", "1-0-1-0", "1")] == [[0, 2], [0, 1], [0, 1], [1, 3], [0]]


def _two_classes(spark, many=False, n=60):
    """A ring of cliques whose members share a class that one feature tells."""
    rng = np.random.default_rng(3)
    y = [i // 5 % 2 for i in range(n)]
    x = [[y[i] + 0.3 * float(rng.normal()), float(rng.normal()), 1.0] for i in range(n)]
    pairs = {(i, j) for i in range(n) for j in range(n) if i != j and i // 5 == j // 5} | {(i, (i + 5) % n) for i in range(n)}
    pairs |= {(b, a) for a, b in pairs}
    nodes = spark.createDataFrame([(i, "va" if i % 6 == 0 else "te" if i % 6 == 1 else "tr") for i in range(n)], "id bigint, role string")
    labels = spark.createDataFrame([(i, [v, 1 - v] if many else v) for i, v in enumerate(y)], f"id bigint, y {'array<int>' if many else 'int'}")
    arrays = spark.createDataFrame(list(enumerate(x)), "id bigint, x array<double>")
    return GraphTables(nodes, spark.createDataFrame(sorted(pairs), "src bigint, dst bigint"), arrays, labels, arrays)


PHASES = {
    "network": [{"arch": "1-0", "dim": 6, "act": "relu", "bias": "norm-nn", "aggr": "concat"}],
    "params": [{"lr": 0.05, "sample_coverage": 2, "dropout": 0.1}],
    "phase": [{"end": 2, "sampler": "node", "size_subgraph": 15}, {"end": 5, "sampler": "rw", "num_root": 6, "depth": 2}],
}


def test_a_run_of_two_phases_goes_on_where_it_was_stopped(spark):
    told = yaml_like(spark, PHASES)
    graph = _two_classes(spark)
    whole, parts = (tempfile.mkdtemp(prefix="spark-phases-") for _ in range(2))
    once = phases.fit(told, graph, whole, together=2, block=8)
    for _ in range(2):
        stopped = phases.fit(told, graph, parts, together=2, block=8, stop=1)
    assert stopped == {"epoch": 2}
    stopped = phases.fit(told, graph, parts, together=2, block=8, stop=1)
    again = phases.fit(told, graph, parts, together=2, block=8)
    assert stopped == {"epoch": 3} and again == once and once["epoch"] == 5
    rows = [metrics_table.read(spark, f"{p}/metrics").orderBy("epoch", "name").collect() for p in (whole, parts)]
    assert rows[0] == rows[1] and {r.epoch for r in rows[0]} == set(range(5))
    assert all(np.isfinite(r.value) for r in rows[0])
    # each phase has visits of its own, and a repeated epoch counts once
    assert spark.read.parquet(f"{whole}/phase=0/visits").exceptAll(spark.read.parquet(f"{whole}/phase=1/visits")).count() > 0
    metrics_table.put(spark, f"{whole}/metrics", "run", 4, {"loss": 9.0})
    last = metrics_table.read(spark, f"{whole}/metrics").where("epoch = 4").collect()
    assert [(r.name, r.value) for r in last] == [("loss", 9.0)]


def yaml_like(spark, told):
    path = tempfile.mkdtemp(prefix="spark-config-") + "/run.json"
    with open(path, "w") as f:
        json.dump(told, f)
    return config.read_config(spark, path)


def test_several_classes_a_node(spark):
    told = config.configuration(PHASES | {"network": [{"arch": "1", "dim": 4, "act": "relu", "aggr": "mean", "loss": "sigmoid", "attention": 2}], "phase": [{"end": 4, "sampler": "full_batch"}]})
    path = tempfile.mkdtemp(prefix="spark-many-")
    found = phases.fit(told, _two_classes(spark, True), path, block=2)
    loss = [r.value for r in metrics_table.read(spark, f"{path}/metrics").where("name = 'loss'").orderBy("epoch").collect()]
    assert loss[-1] < loss[0] and 0.4 < found["va_f1_micro"] <= 1


def test_a_refill_writes_new_samples_only(spark):
    graph = _two_classes(spark)
    g = samplers.Prepared.of(graphs.induced_by_role(graph.edges, graph.nodes), graph.ids())
    path = tempfile.mkdtemp(prefix="spark-pool-")
    pool, draw = pool_module.Pool(spark, path, 4), lambda n, start: samplers.random_walk(g, n, 3, 2, start)
    pool.append(draw, g)
    stamp = lambda: {f: os.path.getmtime(f) for f in glob.glob(f"{path}/*/block=0/*.parquet")}
    before = stamp()
    data = graph.arrays.join(graph.labels, "id").withColumn("lam", F.lit(1.0))
    pool.ready(0, data, g.edges.select("eid", F.lit(1.0).alias("w")))
    met = [sorted(r.sg for r in pool.take(3)[0].select("sg").distinct().collect()) for _ in range(2)]
    assert met == [[1, 2, 3], [0]] and pool.take(3) is None
    pool.append(draw, g)
    assert (pool.low, pool.high, pool.made) == (4, 8, 8) and {k: v for k, v in stamp().items() if k in before} == before
    fresh = samplers.random_walk(g, 8, 3, 2)
    assert sorted(map(tuple, pool.samples().collect())) == sorted(map(tuple, fresh.collect()))
    plan = pool.spark.read.parquet(f"{path}/samples").where("block = 1")
    assert {f.split("block=")[1][0] for f in plan.inputFiles()} <= {"0", "1"} and plan.count() == fresh.where("sg >= 4").count()


def test_means_over_runs(spark):
    told = config.configuration(PHASES | {"network": [{"arch": "0", "dim": 3, "act": "relu"}], "params": [{"sample_coverage": 0}], "phase": [{"end": 1, "sampler": "full_batch"}]})
    path = tempfile.mkdtemp(prefix="spark-runs-")
    got = {r.name: r for r in phases.repeated(told, _two_classes(spark), path, 2, block=1).collect()}
    each = [r.value for r in metrics_table.read(spark, f"{path}/ends").where("name = 'te_f1_micro'").collect()]
    assert len(each) == 2 and abs(got["te_f1_micro"].mean - np.mean(each)) < 1e-12 and abs(got["te_f1_micro"].std - np.std(each, ddof=1)) < 1e-12


def test_a_pool_that_covers_takes_few_passes(spark):
    graph = _two_classes(spark)
    g = samplers.Prepared.of(graphs.induced_by_role(graph.edges, graph.nodes), graph.ids())
    calls = []

    def draw(n, start):
        calls.append((start, n))
        return samplers.random_walk(g, n, 3, 2, start)

    pool = pool_module.Pool(spark, tempfile.mkdtemp(prefix="spark-cover-"), 2)
    pool.cover(draw, g, 150)
    sizes = {r.sg // 2: 0 for r in pool.samples().collect()}
    for r in pool.samples().collect():
        sizes[r.sg // 2] += 1
    # none beyond the first block that suffices, whatever was drawn at once
    assert sum(sizes.values()) > 150 >= sum(sizes.values()) - sizes[pool.made // 2 - 1] and len(sizes) == pool.made // 2 >= 8
    assert len(calls) <= 4 and [start for start, _ in calls] == sorted({start for start, _ in calls})
    fresh = samplers.random_walk(g, pool.made, 3, 2)
    assert sorted(map(tuple, pool.samples().collect())) == sorted(map(tuple, fresh.collect()))


@pytest.mark.parametrize("ids", [range(100, 5100), [3**n for n in range(30)]])
def test_blocks_see_what_other_blocks_hold(spark, ids, monkeypatch):
    """Edges of any kind, and pairs of groups, over blocks of near ids and, where ids are far apart, of hashes."""
    monkeypatch.setattr(halo, "LEAST", 2)
    monkeypatch.setattr(halo, "_partitions", lambda df: 12)
    ids, rng = list(ids), np.random.default_rng(5)
    nodes = spark.createDataFrame([(i, [float(k), 1.0]) for k, i in enumerate(ids)], "id bigint, x array<double>")
    value = {i: k for k, i in enumerate(ids)}
    groups = [[int(v) for v in rng.choice(ids, 4)] for _ in range(len(ids) // 2)] + [[ids[0], ids[1]], [ids[1], ids[0]]]
    groups[0][0] = -5  # no node
    pairs = {(a, b) for g in groups for a in g for b in g if a != b}
    around = {}
    for a, b in pairs:
        around.setdefault(a, []).append(b)
    mean = {a: sum(value.get(b, 0) for b in bs) / len(bs) for a, bs in around.items()}
    edges = spark.createDataFrame([(a, b, 1 / len(around[a])) for a, b in sorted(pairs) if a % 3], "src bigint, dst bigint, w double")
    made = halo.Links.of_groups(spark.createDataFrame([(sorted(set(g)),) for g in groups], "members array<bigint>"), nodes)
    assert made.blocks.ranges == (ids[0] == 100) and made.blocks.number == 12
    for links, kept in ((made, lambda a: True), (halo.Links.of(edges, nodes), lambda a: a % 3)):
        at = halo.dealt(links, nodes, ["x"], lambda own, seen, e: own, ["x"], ["x"])
        got = halo.passed(links, at, ["x"], ["x"], lambda own, seen, e: [halo.gathered(e, seen[0], len(own[0])), halo.largest(e, seen[0], len(own[0]))], ["mean", "most"], []).collect()
        assert sorted(r.id for r in got) == ids and all(r.own for r in got)
        for r in got:
            met = around.get(r.id, []) if kept(r.id) else []
            assert abs(r.mean[0] - (mean[r.id] if met else 0)) < 1e-9 and r.most[0] == max((value[b] for b in met if b in value), default=0)


def test_a_layer_moves_no_row_an_edge(spark):
    """What the passes over a dense graph shuffle is rows of nodes and links, none of them for each edge and column."""
    from loomgraph.plans import tables

    n = 400
    nodes = spark.createDataFrame([(i, [float(i % 7), 1.0, 0.0, 2.0]) for i in range(n)], "id bigint, x array<double>")
    groups = spark.createDataFrame([([*range(k, k + 100)],) for k in range(0, n, 100)], "members array<bigint>")
    layer, weights = tables.LAYERS["gat_heads"]
    made = network_module.outputs(layer, weights(), nodes, halo.Links.of_groups(groups, nodes))
    assert made.count() == n and "SortMergeJoin" not in (plan := made._jdf.queryExecution().toString()) and "Expand" not in plan
    assert plan.split("== Physical Plan ==")[1].count("Join") == 0
