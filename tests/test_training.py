import json
import tempfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import config
from loomgraph.operators import training as T
from loomgraph.sources import files, graphs
from loomgraph.streaming import visits


def test_gradient_against_differences():
    rng = np.random.default_rng(1)
    # biases other than 0 keep a node without neighbours off the bend of relu, where differences tell nothing
    weights = {k: w + (rng.normal(size=w.shape) if k[0] == "b" else 0) for k, w in T.initial(3, [4, 6], 3, 2).items()}
    args = (rng.normal(size=(6, 3)), rng.integers(0, 3, 6), rng.uniform(0.1, 1, 6), np.array([0, 1, 2, 3, 5, 5]), np.array([1, 2, 3, 4, 0, 2]), rng.uniform(0.2, 1, 6))
    _, grad = T.loss_and_gradient(weights, *args)
    for name in weights:
        for at in np.ndindex(weights[name].shape):
            moved = []
            for step in (1e-6, -1e-6):
                other = weights | {name: weights[name].copy()}
                other[name][at] += step
                moved.append(T.loss_and_gradient(other, *args)[0])
            assert abs((moved[0] - moved[1]) / 2e-6 - grad[name][at]) < 1e-5, (name, at)


def test_adam_first_step_is_the_rate():
    out = T.Adam(0.1).update({"w": np.array([1.0, 1.0])}, {"w": np.array([0.5, -2.0])})
    assert np.allclose(out["w"], [0.9, 1.1])


def test_adam_cuts_by_length_or_by_value():
    """The first step is the same for any size of a gradient, the second tells how the first was cut."""
    big, small = {"w": np.array([30.0, 40.0])}, {"w": np.array([1.0, 1.0])}
    for by_value, cut in ((False, [3.0, 4.0]), (True, [5.0, 5.0])):
        adam = T.Adam(0.1, by_value=by_value)
        adam.update({"w": np.zeros(2)}, big)
        assert np.allclose(adam.first["w"], np.array(cut) * 0.1, rtol=1e-4)
        adam.update({"w": np.zeros(2)}, small)


def test_id_map(spark):
    folder = tempfile.mkdtemp(prefix="spark-ids-")
    files.write_id_map(spark.createDataFrame([(7,), (3,), (90,)], "id bigint"), f"{folder}/map", 2)
    assert {r.id: r.r for r in files.read_id_map(spark, f"{folder}/map").collect()} == {3: 0, 7: 1, 90: 2}


def test_training_learns(spark):
    """Two classes told apart by one feature, on two subgraphs; the whole-graph predictions are those of the forward pass."""
    n = 40
    x = [[float(i % 2), 1.0] for i in range(n)]
    nodes = spark.createDataFrame([(i // 20, i, x[i], i % 2, 1 / 20) for i in range(n)], "sg bigint, id bigint, x array<double>, y int, lam double")
    links = [(i, (i + 2) % n) for i in range(n) if i // 20 == (i + 2) % n // 20]
    edges = spark.createDataFrame([(a // 20, a, b, 1.0) for a, b in links], "sg bigint, src bigint, dst bigint, w double")
    weights, told = T.train(nodes, edges, T.initial(2, [8], 2), 8, 2, 0.1)
    assert told[-1][1] < 0.5 * told[0][1]
    long = nodes.select("id", F.posexplode("x").alias("j", "v"))
    plain = edges.select("src", "dst")
    want = T.forward(weights, np.array(x), *np.array(links).T, np.ones(len(links)))[0].argmax(1)
    got = {r.id: r.pred for r in T.predict(weights, plain, long).collect()}
    assert got == dict(enumerate(want.tolist()))
    roles = nodes.select("id", F.lit("va").alias("role"))
    right = np.mean([want[i] == i % 2 for i in range(n)])
    assert right > 0.8 and abs(T.evaluate(weights, plain, long, nodes.select("id", "y"), roles).first().f1_micro - right) < 1e-9


def test_array_files(spark):
    files.register(spark)
    folder = tempfile.mkdtemp(prefix="spark-files-")
    indptr, indices, data = np.array([0, 2, 2, 5], np.int32), np.array([1, 2, 0, 1, 2], np.int32), np.array([True, True, False, True, True])
    for name, save in (("a", np.savez), ("b", np.savez_compressed)):
        save(f"{folder}/{name}.npz", indptr=indptr, indices=indices, data=data, shape=np.array([3, 3]), format=np.array(b"csr"))
        assert zipfile.is_zipfile(f"{folder}/{name}.npz")
        got = spark.read.format("npz_csr").option("rows", "2").load(f"{folder}/{name}.npz")
        assert sorted(map(tuple, got.collect())) == [(0, 1), (0, 2), (2, 1), (2, 2)]
    m = np.arange(12, dtype=np.float32).reshape(4, 3)
    np.save(f"{folder}/m.npy", m)
    got = spark.read.format("npy_matrix").option("rows", "3").load(f"{folder}/m.npy").orderBy("id").collect()
    assert [r.x for r in got] == m.tolist()
    for name, value in (("role", {"tr": [0, 2], "va": [1], "te": []}), ("one", {"0": 3, "1": 0}), ("many", {"0": [0, 1], "7": [1, 1]})):
        with open(f"{folder}/{name}.json", "w") as f:
            json.dump(value, f)
    assert sorted(map(tuple, files.roles(spark, f"{folder}/role.json").collect())) == [(0, "tr"), (1, "va"), (2, "tr")]
    assert sorted(map(tuple, files.class_map(spark, f"{folder}/one.json").collect())) == [(0, 3, 1), (1, 0, 1)]
    assert sorted(map(tuple, files.class_map(spark, f"{folder}/many.json").collect())) == [(0, 0, 0), (0, 1, 1), (7, 0, 1), (7, 1, 1)]


def test_graph_sinks(spark):
    folder = tempfile.mkdtemp(prefix="spark-sinks-")
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    g = graphs.GraphTables(frame([(0, "tr"), (1, "te")], "id bigint, role string"), frame([(0, 1), (1, 0)], "src bigint, dst bigint"), frame([(0, 0, 1)], "id bigint, j int, v bigint"), frame([(0, 1)], "id bigint, y int"))
    files.write_graph(g, f"{folder}/g")
    assert sorted(map(tuple, files.read_graph(spark, f"{folder}/g").edges.collect())) == [(0, 1), (1, 0)]
    files.write_node_link(g, f"{folder}/j")
    assert [tuple(r) for r in spark.read.json(f"{folder}/j/links").collect()] == [(0, 1)]
    assert spark.read.json(f"{folder}/j/nodes").where("test").count() == 1


def test_streamed_visits_equal_batch(spark):
    folder = tempfile.mkdtemp(prefix="spark-visits-")
    samples = spark.createDataFrame([(i % 5, i * 7 % 11) for i in range(60)], "sg bigint, v bigint")
    samples.repartition(3).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    visits.keep_visits(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
    got = {r.id: r.c for r in visits.latest(spark.read.parquet(f"{folder}/out")).collect()}
    assert got == {r.v: r["count"] for r in samples.groupBy("v").count().collect()}


def test_flag_gradient_with_decay_against_differences():
    rng = np.random.default_rng(3)
    weights = {k: w + (rng.normal(size=w.shape) if k[0] == "b" else 0) for k, w in T.initial(3, [4], 2, 2).items()}
    args = (rng.normal(size=(5, 3)), rng.integers(0, 2, (5, 2)), rng.uniform(0.1, 1, 5), np.array([0, 1, 2]), np.array([1, 2, 3]), rng.uniform(0.2, 1, 3), 0.3)
    _, grad = T.loss_and_gradient(weights, *args)
    for name in weights:
        for at in np.ndindex(weights[name].shape):
            moved = []
            for step in (1e-6, -1e-6):
                other = weights | {name: weights[name].copy()}
                other[name][at] += step
                moved.append(T.loss_and_gradient(other, *args)[0])
            assert abs((moved[0] - moved[1]) / 2e-6 - grad[name][at]) < 1e-5, (name, at)


def test_fit_gives_the_best_weights_back(spark):
    nodes = spark.createDataFrame([(i // 4, i, [float(i % 2), 1.0], [i % 2, 1 - i % 2], 0.25) for i in range(8)], "sg bigint, id bigint, x array<double>, y array<int>, lam double")
    edges = spark.createDataFrame([(0, 0, 1, 1.0), (1, 5, 6, 1.0)], "sg bigint, src bigint, dst bigint, w double")
    seen, scores = [], [0.2, 0.7, 0.5]

    def validate(weights):
        seen.append(weights)
        return scores[len(seen) - 1]

    got, told = T.fit(nodes, edges, T.initial(2, [4], 2), 3, validate, tempfile.mkdtemp(prefix="spark-best-") + "/w", together=2, rate=0.1)
    assert all(np.array_equal(got[k], seen[1][k]) for k in got) and [t[2] for t in told] == scores and told[2][1] < told[0][1]


def test_load_data(spark):
    folder = tempfile.mkdtemp(prefix="spark-load-")
    for name, dst in (("adj_full", [1, 2, 0, 0]), ("adj_train", [1, 1, 0, 0])):
        at = [0, 2, 3, 4] if name == "adj_full" else [0, 1, 2, 2]
        np.savez(f"{folder}/{name}.npz", indptr=np.array(at, np.int32), indices=np.array(dst[: at[-1]], np.int32), data=np.ones(at[-1], bool), shape=np.array([3, 3]), format=np.array(b"csr"))
    np.save(f"{folder}/feats.npy", np.array([[1.0, 5.0], [3.0, 5.0], [9.0, 6.0]]))
    for name, value in (("role", {"tr": [0, 1], "va": [2], "te": []}), ("class_map", {"0": 1, "1": 0, "2": 1})):
        with open(f"{folder}/{name}.json", "w") as f:
            json.dump(value, f)
    graph, train = files.load_data(spark, folder)
    assert {r.id: r.x for r in graph.features.collect()} == {0: [-1.0, 0.0], 1: [1.0, 0.0], 2: [7.0, 1.0]}
    assert sorted(map(tuple, train.collect())) == [(0, 1), (1, 1)] and graph.edges.count() == 4 and graph.nodes.count() == 3


def test_configuration():
    c = config.configuration({"network": [{"dim": 8, "arch": "1-0-1", "bias": "bias"}], "params": [{"lr": 0.1}], "phase": [{"end": 5, "sampler": "rw", "num_root": 3, "depth": 2}]})
    assert c.params["lr"] == 0.1 and c.params["weight_decay"] == 0 and c.network["aggr"] == "concat"
    assert [(x.order, x.inputs, x.width) for x in c.layers(4)] == [(1, 4, 16), (0, 16, 8), (1, 8, 16)] and c.conv_layers(4) == [0, 2]
    assert c.parameters(4, 3) == 2 * (4 + 1) * 8 + (16 + 1) * 8 + 2 * (8 + 1) * 8 + (16 + 1) * 3
    for phase in ({"end": 5, "sampler": "rw", "depth": 2}, {"end": 5, "sampler": "other"}, {"sampler": "full_batch"}):
        with pytest.raises(ValueError):
            config.configuration({"phase": [phase]})


def test_pruning_reaches_its_end(spark):
    chain = [(i, i + 1) for i in range(6)] + [(10, 11), (11, 12), (12, 10)]
    edges = graphs.symmetrize(spark.createDataFrame(chain, "src bigint, dst bigint"))
    left = graphs.pruned(edges, 2, lambda d: d.checkpoint())
    assert {r.src for r in left.collect()} == {10, 11, 12}


def test_a_pool_of_one_size_leaves_the_other_edges_unmade(spark, tmp_path):
    """Its nodes and weighted edges are those of the sampler over the whole graph, whose edges are not written for it."""
    import glob

    from loomgraph.plans import graph_queries, tables

    c = tables.Context(spark, "/root/testdata/sf0.001")
    small = c.train_ids.where("id < 60")
    lines = c.table("lineitem").where("l_partkey < 120")
    few = small.where("id % 7 = 0")
    pairs = graph_queries.G.copurchase(lines).join(few.withColumnRenamed("id", "src"), "src", "left_semi").select("src", "dst")
    assert sorted(map(tuple, graph_queries.G.bought_with(lines, few).collect())) == sorted(map(tuple, pairs.collect())) != []

    def keep(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    met, edges = graph_queries._sampled(c, keep)
    assert sorted(map(tuple, met.collect())) == sorted(map(tuple, c.walks()[1].collect()))
    assert sorted(map(tuple, edges.collect())) == sorted(map(tuple, graph_queries.subgraph_weights(c).collect()))
    assert glob.glob(f"{tmp_path}/edges-met/*.parquet") and not glob.glob(f"{tmp_path}/train_edges")
