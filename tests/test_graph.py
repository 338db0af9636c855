"""Worked values of a seven-node graph, properties of samples, and named queries against DuckDB."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from loomgraph import plans
from loomgraph.operators import norms, samplers, windows
from loomgraph.sources import graphs

DATA = "/root/testdata/sf0.001"
PAIRS = [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (4, 4), (4, 5)]
ROLES = {0: "tr", 1: "tr", 2: "tr", 3: "tr", 6: "tr", 4: "va", 5: "te"}


@pytest.fixture(scope="module")
def tiny(spark):
    nodes = spark.createDataFrame(list(ROLES.items()), "id bigint, role string")
    edges = graphs.symmetrize(spark.createDataFrame(PAIRS, "src bigint, dst bigint"))
    return nodes, edges


def test_counts_of_tiny(tiny):
    nodes, edges = tiny
    assert edges.count() == 13
    assert graphs.induced_by_role(edges, nodes).count() == 8
    assert graphs.val_edges(edges, nodes).count() == 11


def test_train_degrees_and_norms(spark, tiny):
    nodes, edges = tiny
    train = graphs.induced_by_role(edges, nodes)
    g = samplers.Prepared.of(train, nodes.where("role = 'tr'").select("id"))
    assert {r.id: r.deg for r in g.deg.collect()} == {0: 2, 1: 2, 2: 3, 3: 1, 6: 0}
    assert sorted(r.eid for r in g.edges.collect()) == list(range(8))
    s = spark.createDataFrame([(0, 0), (0, 1), (0, 2), (1, 2), (1, 3)], "sg bigint, v bigint")
    visits = norms.node_visits(s, nodes.where("role = 'tr'").select("id"))
    assert {r.id: r.c for r in visits.collect()} == {0: 1, 1: 1, 2: 2, 3: 1, 6: 0}
    alpha = norms.aggregation(visits, norms.edge_visits(samplers.induced(s, g.edges), g.edges))
    assert {(r.src, r.dst): r.alpha for r in alpha.collect()} == {(0, 1): 1, (0, 2): 1, (1, 0): 1, (1, 2): 1, (2, 0): 2, (2, 1): 2, (2, 3): 2, (3, 2): 1}
    found = {r.id: round(r["lambda"], 9) for r in norms.loss(visits, nodes, 2).collect()}
    assert found == {0: 0.4, 1: 0.4, 2: 0.2, 3: 0.4, 6: 4.0, 4: 0.0, 5: 0.0}


def test_samplers_stay_in_training_nodes(spark, tiny):
    nodes, edges = tiny
    g = samplers.Prepared.of(graphs.induced_by_role(edges, nodes), nodes.where("role = 'tr'").select("id"))
    for name, f in samplers.SAMPLERS.items():
        sizes = {"mrw": {"size": 4, "frontier_size": 2}}.get(name, {})
        got = f(g, 3, **sizes).collect()
        assert {r.v for r in got} <= {0, 1, 2, 3, 6}, name
        assert {r.sg for r in got} == {0, 1, 2}, name


def test_walk_stays_at_isolated_node(spark, tiny):
    nodes, edges = tiny
    g = samplers.Prepared.of(graphs.induced_by_role(edges, nodes), nodes.where("role = 'tr'").select("id"))
    at = spark.createDataFrame([(0, 0, 6)], "sg bigint, i bigint, v bigint")
    assert [r.v for r in samplers.hop(g, at, "hop1").collect()] == [6]


def test_draws_go_beyond_32_bits(spark):
    from loomgraph.functions.rng import below

    n = 1 << 40
    got = [r.v for r in spark.range(400).select(below(F.lit(n), "t", "id").alias("v")).collect()]
    assert all(0 <= v < n for v in got) and max(got) > n * 0.98 and len(set(got)) == 400


def test_a_pool_grows_until_it_covers(spark, tiny):
    nodes, edges = tiny
    g = samplers.Prepared.of(graphs.induced_by_role(edges, nodes), nodes.where("role = 'tr'").select("id"))
    pool, number = samplers.covering(samplers.vanilla_node, g, 6.0, 2, size=3)
    assert pool.count() > 30 and number in (8, 16) and pool.select("sg").distinct().count() == number
    half = samplers.vanilla_node(g, number // 2, size=3)
    assert half.count() <= 30 and half.exceptAll(pool).count() == 0


def test_running_totals_over_several_levels(spark):
    rows = spark.createDataFrame([(i * 3, i % 7) for i in range(500)], "k bigint, v bigint")
    got = {r.k: r.t for r in windows.running_total(rows, "k", "v", "t", 4, 4).collect()}
    total, want = 0, {}
    for i in range(500):
        total += i % 7
        want[i * 3] = total
    assert got == want


def test_groups_are_followed_and_ranked_over_blocks(spark):
    rows = [(g, i * i) for g in ("a", "b", "c") for i in range(40) if (i + len(g)) % 3 or g == "a"]
    df = spark.createDataFrame(rows, "g string, k bigint")
    want, ranks = [], []
    for g in ("a", "b", "c"):
        mine = sorted(k for x, k in rows if x == g)
        want += [(g, a, b) for a, b in zip(mine, mine[1:], strict=False)]
        ranks += [(g, k, n) for n, k in enumerate(mine)]
    assert sorted(map(tuple, windows.followed(df, ["g"], "k", "next", 100).collect())) == sorted(want)
    assert sorted((r.g, r.k, r.r) for r in windows.ranked_within(df, ["g"], "k", "r", 100).collect()) == sorted(ranks)


def test_edges_among_very_many_are_kept_as_often_as_they_should(spark):
    """A thousand edges that stand for 10**13 alike, over as many samples as keep some of them."""
    n, samples = 1000, 1 << 40
    p = F.lit(100 / 1e13)
    kept = [int(r.j) for r in spark.range(n).select(samplers._jump(p, F.col("id")).alias("j")).collect()]
    mean = sum(kept) / n
    assert abs(mean / 1e11 - 1) < 0.1 and len(set(kept)) == n
    # with sixty samples a row, every sample keeps its share
    edges = graphs.symmetrize(spark.createDataFrame([(i, j) for i in range(40) for j in range(i)], "src bigint, dst bigint"))
    g = samplers.Prepared.of(edges, spark.range(40).select(F.col("id")))
    many = samplers.edge_bernoulli(g, 400, 2).groupBy("sg").count()
    assert many.count() > 300 and abs(many.agg(F.avg("count")).first()[0] - 4 / (1 - 2.718281828**-2)) < 0.4
    assert samplers.edge_bernoulli(g, 3, 5000).groupBy("sg").count().agg(F.min("count")).first()[0] == 40


def test_frontier_walks_as_long_as_places_move(spark, tiny):
    """A star: all degree stands at its middle, so that one place moves every time, beyond the walks drawn first."""
    edges = graphs.symmetrize(spark.createDataFrame([(0, i) for i in range(1, 12)], "src bigint, dst bigint"))
    g = samplers.Prepared.of(edges, spark.range(12).select(F.col("id")))
    for cap in (10000, 1):
        got = samplers.frontier(g, 3, 40, 2, cap).collect()
        assert {r.sg for r in got} == {0, 1, 2} and {r.v for r in got} <= set(range(12))
        assert all(len({r.v for r in got if r.sg == sg}) > 6 for sg in range(3))
    alone = samplers.Prepared.of(edges.limit(0), spark.range(3).select(F.col("id")))
    assert {r.v for r in samplers.frontier(alone, 2, 9, 3).collect()} <= {0, 1, 2}


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["edge_sampler", "norm_loss", "scaler_transform", "f1_single", "sage_layer", "sage_mean", "gaan_gate", "jk_concat", "jk_max", "loss_softmax", "loss_softmax_weighted", "loss_sigmoid_weighted", "f1_threshold", "mrw_sampler", "mixhop_order2", "gat_heads", "gat_mean", "gat_joint", "gaan_layer", "forward_full", "source_documents", "source_embeddings", "spmm_2hop", "neighbor_max_pool", "edge_sampler_bernoulli"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "lineitem", "documents", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = plans.queries()[name](spark, DATA)
    want = con.execute(plans.oracle_sql()[name]).df()[got.columns]
    assert sorted(map(tuple, got.toArrow().to_pandas().itertuples(index=False))) == sorted(map(tuple, want.itertuples(index=False)))


def test_every_query_but_the_sequential_ones_has_sql():
    assert set(plans.queries()) - set(plans.oracle_sql()) <= {"svd_grams", "train_epochs", "train_evaluate", "train_phases"}
    assert F is not None
