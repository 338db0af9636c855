"""Singular values against numpy, raw tensor files there and back, graph sources."""

import json
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import svd
from loomgraph.plans import graph_queries, tables
from loomgraph.sources import adapter, graphs, tensors

DATA = "/root/testdata/sf0.001"


def keeper():
    folder = tempfile.mkdtemp(prefix="spark-svd-")
    number = iter(range(10**6))

    def keep(df):
        path = f"{folder}/{next(number)}"
        df.write.parquet(path)
        return df.sparkSession.read.parquet(path)

    return keep


def entries(spark, m):
    return spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "row bigint, col bigint, v double")


@pytest.mark.parametrize(("shape", "size"), [((30, 12), 5), ((6, 40), 8)])
def test_truncated_svd_equals_numpy(spark, shape, size):
    rng = np.random.default_rng(7)
    m = rng.normal(size=shape) * (rng.random(shape) < 0.4)
    m[:, 0] = m[:, 1]  # one direction less
    values, left, right = svd.truncated(entries(spark, m), size, keeper())
    want = np.linalg.svd(m, compute_uv=False)
    want = want[want > 1e-9][:size]
    assert np.allclose(values, want, atol=1e-6)
    u, v = ({r.id: r.x for r in side.collect()} for side in (left, right))
    full = lambda side, n: np.array([side.get(i, np.zeros(len(values))) for i in range(n)])
    u, v = full(u, shape[0]), full(v, shape[1])
    assert np.allclose(u.T @ u, np.eye(len(values)), atol=1e-6) and np.allclose(v.T @ v, np.eye(len(values)), atol=1e-6)
    assert np.allclose((u.T @ m @ v), np.diag(values), atol=1e-5)


def test_svd_of_grams_and_of_nothing(spark):
    c = tables.Context(spark, DATA)
    rows = graph_queries._grams(c).collect()
    ids, grams = ({k: n for n, k in enumerate(sorted({r[i] for r in rows}))} for i in (0, 1))
    m = np.zeros((len(ids), len(grams)))
    for r in rows:
        m[ids[r.id], grams[r.gram]] = r.n
    got = [r.value for r in graph_queries.QUERIES["svd_grams"](c).orderBy("k").collect()]
    assert np.allclose(got, np.linalg.svd(m, compute_uv=False)[:10], atol=1e-6)
    none = spark.createDataFrame([], "row bigint, col bigint, v double")
    assert len(svd.truncated(none, 3, keeper())[0]) == 0


def tiny(spark, many):
    roles = {0: "tr", 1: "tr", 2: "va", 3: "te", 4: "tr"}
    nodes = spark.createDataFrame(list(roles.items()), "id bigint, role string")
    edges = graphs.symmetrize(spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 3), (1, 4)], "src bigint, dst bigint"))
    x = spark.createDataFrame([(i, [float(i), 2.0, i * i / 3]) for i in roles], "id bigint, x array<double>")
    y = spark.createDataFrame([(i, [i % 2, 1] if many else i % 3) for i in roles], f"id bigint, y {'array<int>' if many else 'int'}")
    return graphs.GraphTables(nodes, edges, x, y, x)


@pytest.mark.parametrize("many", [False, True])
def test_tensor_folder_there_and_back(spark, many):
    g = tiny(spark, many)
    path = tempfile.mkdtemp(prefix="spark-tensors-")
    tensors.write_folder(g, path)
    assert sorted(os.listdir(path)) == sorted(f"{n}.bin" for n in [*tensors.FILES, "dims"])
    assert np.fromfile(f"{path}/dims.bin", "<i4").tolist() == [4, 6, 9, 6, 3, 1, 1, 5, 3, 5, 2 if many else 3]
    assert np.fromfile(f"{path}/adj_full_indptr.bin", "<i4").tolist() == [0, 1, 4, 6, 8, 9]
    feats = np.fromfile(f"{path}/feats_norm_col.bin", "<f8").reshape(3, 5).T
    raw = np.array([[i, 2.0, i * i / 3] for i in range(5)])
    fit = raw[[0, 1, 4]]
    assert np.allclose(feats, (raw - fit.mean(0)) / np.where(fit.std(0) > 0, fit.std(0), 1))
    back, train = tensors.read_folder(spark, path, 2)
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert same(back.edges, g.edges.select("src", "dst")) and same(back.nodes, g.nodes) and same(train, graphs.induced_by_role(g.edges, g.nodes))
    assert {r.id: r.y for r in back.labels.collect()} == {i: [i % 2, 1] if many else [int(i % 3 == c) for c in range(3)] for i in range(5)}
    assert np.allclose([r.x for r in back.arrays.orderBy("id").collect()], feats)


def test_a_failed_write_leaves_nothing(spark):
    folder = tempfile.mkdtemp(prefix="spark-tensors-")
    rows = spark.range(100).select(F.col("id").alias("at"), F.col("id").cast("double").alias("v"))
    tensors.write_tensor(rows, f"{folder}/a.bin", "<f8")
    assert np.fromfile(f"{folder}/a.bin").tolist() == list(range(100))
    failing = rows.withColumn("v", F.when(F.col("at") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    for bad in (failing, rows.where("at != 50"), rows.where("at > 0")):
        with pytest.raises(Exception, match="lost|gaps|no value"):
            tensors.write_tensor(bad, f"{folder}/b.bin", "<f8")
    assert os.listdir(folder) == ["a.bin"]
    tensors.write_tensor(rows.limit(0), f"{folder}/c.bin", "<i4")
    assert os.path.getsize(f"{folder}/c.bin") == 0 and tensors.read_tensor(spark, f"{folder}/c.bin", "<i4").count() == 0


def test_folder_source(spark):
    path = tempfile.mkdtemp(prefix="spark-folder-")
    np.savez(f"{path}/adj_full.npz", indptr=np.array([0, 2, 3, 4]), indices=np.array([1, 2, 0, 0]), data=np.ones(4, bool), shape=np.array([3, 3]), format=np.array(b"csr"))
    np.save(f"{path}/feats.npy", np.array([[1.0, 5.0], [3.0, 5.0], [9.0, 6.0]]))
    for classes, want in (({"0": 1, "1": 0, "2": 1}, {0: 1, 1: 0, 2: 1}), ({"0": [1, 0], "1": [0, 0], "2": [1, 1]}, {0: [1, 0], 1: [0, 0], 2: [1, 1]})):
        for name, value in (("role", {"tr": [0, 1], "va": [2], "te": []}), ("class_map", classes)):
            with open(f"{path}/{name}.json", "w") as f:
                json.dump(value, f)
        g = adapter.SOURCES["folder"](spark, path).tables()
        assert {r.id: r.x for r in g.arrays.collect()} == {0: [-1.0, 0.0], 1: [1.0, 0.0], 2: [7.0, 1.0]}
        assert {r.id: r.y for r in g.labels.collect()} == want and g.edges.count() == 4


def test_matmul_is_exact_beyond_64_bits(spark):
    from loomgraph.plans.graph_queries import _square

    small, large = ({(i, j): (1 + 3 * i - 2 * j) * scale for i in range(2) for j in range(2)} for scale in (7, 10**10 + 1))
    for m, kind in ((small, "bigint"), (large, "decimal(38,0)")):
        got = _square(spark.createDataFrame([(i, j, v) for (i, j), v in m.items()], "i int, j int, v bigint"))
        assert dict(got.dtypes)["v"] == kind
        assert {(r.i, r.j): int(r.v) for r in got.collect()} == {(i, j): sum(m[i, k] * m[k, j] for k in range(2)) for i in range(2) for j in range(2)}
