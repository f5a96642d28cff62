"""Graph views, profiles and closed-form detectors on graphs small enough to work out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphsieve.functions import stats
from graphsieve.graph import Graph, label_propagation
from graphsieve.operators import detectors, explore

K4 = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3), (4, 3)]


def make(spark, n, edges, features=None, both=True, **more):
    rows = [(i, [float(v) for v in (features[i] if features else [i, 1.0])], *(more[c][i] for c in more)) for i in range(n)]
    schema = "node_id long, features array<double>" + "".join(f", {c} long" for c in more)
    pairs = edges + [(b, a) for a, b in edges] if both else edges
    return Graph(spark.createDataFrame(rows, schema), spark.createDataFrame(pairs, "src long, dst long"))


def values(df, column="score"):
    return {r["node_id"]: r[column] for r in df.collect()}


def test_clique_with_a_pendant(spark):
    g = make(spark, 6, K4)
    t = g.triangles.collect()
    assert {r.node_id: r.triangles for r in t} == {0: 3, 1: 3, 2: 3, 3: 3, 4: 0, 5: 0}
    assert {r.node_id: r.clustering for r in t} == {0: 1, 1: 1, 2: 1, 3: 0.5, 4: 0, 5: 0}
    assert values(detectors.clique_density(g)) == {0: 1, 1: 1, 2: 1, 3: 0.5, 4: 0, 5: 0}
    assert values(g.degrees, "degree") == {0: 3, 1: 3, 2: 3, 3: 4, 4: 1, 5: 0}
    assert values(detectors.local_affinity(g))[5] == 1.0
    assert explore.spectral_gap(g)["spectral_gap"] < 1e-9


def test_multiplicity_weighs_and_loops_go(spark):
    g = make(spark, 3, [(0, 1), (0, 1), (0, 2), (0, 0)], [[0, 0], [3, 0], [0, 6]], both=False)
    assert g.undirected.count() == 2
    h = make(spark, 3, [(0, 1), (0, 1), (0, 2)], [[0, 0], [3, 0], [0, 6]], both=False)
    assert h.neighbour_mean(h.nodes, "features", 2).collect()[0]["mean"] == [2.0, 2.0]
    assert values(h.neighbour_distance, "distance") == {0: pytest.approx(8**0.5)}


def test_ranks_and_constants(spark):
    s = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 2.0, 2.0, 3.0])] + [("c", i, 5.0) for i in range(4)], "paradigm string, node_id long, score double")
    r = {(x.paradigm, x.node_id): x for x in s.select("paradigm", "node_id", stats.average_rank("score", ["paradigm"]).alias("a"), stats.strict_percentile("score", ["paradigm"]).alias("p"), stats.ordinal_rank("score", ["paradigm"]).alias("o")).collect()}
    assert [r["a", i].a for i in range(4)] == [1, 2.5, 2.5, 4] and [r["a", i].p for i in range(4)] == [0, 0.25, 0.25, 0.75] and [r["a", i].o for i in range(4)] == [0, 1, 2, 3]
    assert {x.score for x in stats.min_max(s, "score", ["paradigm"]).where("paradigm = 'c'").collect()} == {0.0}
    assert stats.histogram(s.where("paradigm = 'c'"), "score", 4).agg(F.sum("n")).first()[0] == 4
    ks = stats.ks_statistic(s.withColumn("f", F.col("score") > 2), "score", "f", ["paradigm"]).collect()
    assert {x.paradigm: x.ks for x in ks}["a"] == 1.0
    assert abs(stats.chi2_tail(28.74, 8) - 0.000353) < 2e-5 and abs(stats.chi2_tail(3.0, 2) - np.exp(-1.5)) < 1e-12


def test_erf(spark):
    from math import erf

    rows = spark.createDataFrame([(x / 4,) for x in range(-12, 13)], "x double").select("x", stats.erf(F.col("x")).alias("y")).collect()
    assert all(abs(r.y - erf(r.x)) < 2e-7 for r in rows)
    scaled = stats.robust_gaussian_scale(spark.createDataFrame([(i, float(i)) for i in range(9)], "node_id long, score double")).orderBy("node_id").collect()
    assert scaled[4].score == pytest.approx(0.5) and scaled[8].score > 0.9


def test_communities_and_modularity(spark):
    two = [(a, b) for a in range(5) for b in range(a)] + [(a + 5, b + 5) for a in range(5) for b in range(a)] + [(4, 5)]
    g = make(spark, 11, two)
    c = values(label_propagation(g), "community")
    assert len({c[i] for i in range(5)}) == 1 and len({c[i] for i in range(5, 10)}) == 1 and c[10] == 10
    assert explore.modularity(g).first().modularity > 0.4
    assert explore.homophily(g).first().homophily > 0.9
    p = explore.profile(g)
    assert p["num_nodes"] == 11 and p["num_edges"] == 42 and p["feature_dim"] == 2 and p["num_communities"] == 3


@pytest.mark.parametrize("block", [2048, 7])
def test_neighbour_search_and_lof(spark, monkeypatch, block):
    monkeypatch.setattr(detectors, "KNN_BLOCK", block)
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (40, 3)), [[9, 9, 9]]])
    g = make(spark, 41, [], x.tolist())
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    got = {}
    for r in detectors.neighbours(g.nodes, 5, with_self=False).orderBy("node_id", "place").collect():
        got.setdefault(r.node_id, []).append(r.other)
    assert all(got[i] == [j for j in np.argsort(d[i], kind="stable") if j != i][:5] for i in range(41))
    scores = values(detectors.density(g))
    assert max(scores, key=scores.get) == 40 and scores[40] == 1.0


def test_low_rank_residual_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (50, 8))
    got = values(detectors.svd_residual(make(spark, 50, [], x.tolist()), 3), "residual")
    v = np.linalg.svd(x, full_matrices=False)[2][:3]
    assert np.allclose([got[i] for i in range(50)], np.linalg.norm(x - x @ v.T @ v, axis=1), atol=1e-7)


def test_other_detectors_find_planted_nodes(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (60, 4)).tolist()
    x[7] = [30.0, 30.0, 30.0, 30.0]
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (150, 2)) if a != b]
    g = make(spark, 60, edges, x, community=[i % 3 for i in range(60)])
    for f in (detectors.homophily_violation, detectors.community, detectors.attribute_inflation, detectors.spectral_residual, detectors.attr_struct_mismatch, detectors.peripheral_mismatch, detectors.conformity, detectors.spectral):
        s = values(f(g))
        assert len(s) == 60 and min(s.values()) == 0 and max(s.values()) == 1, f.__name__
    assert max(values(detectors.homophily_violation(g)).items(), key=lambda e: e[1])[0] == 7
    with pytest.raises(ValueError):
        detectors.run_detector("nothing", g)


def test_part_graph_is_dealt_by_its_lines(spark, tmp_path, monkeypatch):
    from graphsieve.sources import tables

    spark.range(400).selectExpr("id div 4 AS l_orderkey", "id * 7 % 50 AS l_partkey", "1.0D AS l_quantity", "2.0D AS l_extendedprice", "0.1D AS l_discount", "0.2D AS l_tax").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(50).selectExpr("id AS p_partkey", "1 AS p_size", "3.0D AS p_retailprice", "'Brand#11' AS p_brand").write.parquet(f"{tmp_path}/part.parquet")
    got = []
    for lines in (1 << 18, 10):
        monkeypatch.setattr(tables, "LINES", lines)
        edges = tables.part_graph(spark, str(tmp_path), 2).edges
        got.append((edges.rdd.getNumPartitions(), sorted(map(tuple, edges.collect()))))
    assert got[0][1] == got[1][1] != [] and got[1][0] == 2 * 41 > got[0][0]


def test_cosines_of_a_set(spark):
    from graphsieve.functions.stats import cosine

    rng = np.random.default_rng(3)
    rows = [(int(i), [float(v) for v in rng.normal(size=5)] if i != 7 else [0.0] * 5, 1) for i in range(60)]
    nodes = spark.createDataFrame(rows, "node_id long, features array<double>, community long")
    ids = nodes.where("node_id % 4 <> 1")
    got = explore.pairwise_cosine(nodes, ids, block=5)
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    x = {r[0]: np.array(r[1]) / max(np.linalg.norm(r[1]), 1e-8) for r in rows if r[0] % 4 != 1}
    want = {(a, b): float(x[a] @ x[b]) for a in x for b in x if a < b}
    found = {(r.a, r.b): r.cosine for r in got.collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - v) < 1e-12 for k, v in want.items())
    graph = Graph(nodes, spark.createDataFrame([(0, 2)], "src long, dst long"))
    assert abs(explore.mean_cosine(graph, ids) - sum(want.values()) / len(want)) < 1e-12
    assert explore.mean_cosine(graph, nodes.where("node_id = 3")) is None
    gap = spark.createDataFrame([(1, [1.0, None]), (2, [1.0, 0.0])], "node_id long, features array<double>")
    assert explore.pairwise_cosine(gap, gap).collect() == [(1, 2, None)] == gap.alias("x").join(gap.alias("y"), F.expr("x.node_id < y.node_id")).select("x.node_id", "y.node_id", cosine("x.features", "y.features")).collect()


def test_neighbour_search_ships_each_node_a_few_times():
    assert [detectors.knn_blocks(n, 64) for n in (0, 500, 3000, 100_000, 600_000)] == [1, 1, 2, 7, 10] and detectors.knn_blocks(600_000, 6400) == 916


def test_pairs_that_share_a_cell(spark):
    from graphsieve.sources.tables import sharing_pairs

    rng = np.random.default_rng(5)
    rows = sorted({(int(u) * 1_000_003, int(c)) for u, c in rng.integers(0, 70, (150, 2))} | {(int(u) * 1_000_003, 1 << 40) for u in range(20, 32)} | {(5, 9)})
    want = {(a, b) for a, x in rows for b, y in rows if x == y and a < b}
    seen = spark.createDataFrame(rows, "user_id long, cell long")
    for block in (2048, 9):
        pairs = sharing_pairs(seen, block)
        assert sorted(map(tuple, pairs.collect())) == sorted(want) and "Aggregate" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    assert sharing_pairs(seen.limit(0)).collect() == []
