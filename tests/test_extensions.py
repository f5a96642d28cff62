"""The store of results, isolation forests, sampled walks, the spectral gap and the tests of significance."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphsieve.functions import stats
from graphsieve.graph import Derived, Graph
from graphsieve.operators import evaluate, explore, forest, sampling
from graphsieve.plans import queries as plans
from graphsieve.sources.store import ResultStore, plain

FOLDER = "/root/testdata/sf0.001"
has_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


# --- store


def test_results_are_kept_by_their_inputs(spark, tmp_path):
    source, folder, calls = str(tmp_path / "in"), str(tmp_path / "store"), []

    def work(k):
        calls.append(k)
        return spark.read.parquet(source).where(F.col("id") < k)

    spark.range(10).write.parquet(source)
    store = ResultStore(spark, folder)
    store.register("below", work, lambda k: [source], category="b", description="rows below k")
    store.register("plan", lambda: spark.read.parquet(source).selectExpr("id * 2 AS x"), category="a")
    store.register("fails", lambda: spark.range(3).selectExpr("raise_error('no') AS x"))
    store.register("fresh", lambda: spark.range(2).toDF("x"), cacheable=False)
    first, again = store.execute("below", k=4), store.execute("below", k=4)
    assert (first.hit, again.hit, calls, first.key == again.key) == (False, True, [4], True) and again.frame.count() == 4
    assert not store.execute("below", k=5).hit and not store.execute("plan").hit and store.execute("plan").hit
    # another session's store finds it too; changed input files do not
    other = ResultStore(spark, folder)
    other.register("below", work, lambda k: [source])
    assert other.execute("below", k=4).hit and calls == [4, 5]
    time.sleep(0.01)
    spark.range(2).write.mode("append").parquet(source)
    assert not other.execute("below", k=4).hit and not store.execute("plan").hit and store.execute("below", k=4).frame.count() == 6
    # another version of a tool is another tool
    other.register("below", work, lambda k: [source], version="2")
    assert not other.execute("below", k=4).hit
    failed = store.execute("fails")
    assert failed.frame is None and "no" in failed.error and not store.stored(failed.key)
    assert "unknown tool" in store.execute("nothing").error
    assert not store.execute("fresh").hit and not store.execute("fresh").hit
    rows = {(r.tool, r.params): r for r in store.provenance().where("made > 0").orderBy("n_rows").collect()}
    assert rows['below', '{"k": 4}'].n_rows == 6 and rows['plan', "{}"].n_files >= 1
    log = store.calls()
    assert log.where("status = 'failed'").count() == 1 and log.where("tool = 'below' and hit").count() == 3
    assert [t["name"] for t in store.tools()] == ["fails", "fresh", "plan", "below"] and len(store.tools("a")) == 1
    assert store.clear("plan") == 2 and not store.execute("plan").hit


def test_store_without_calls_and_plain_parameters(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "s"))
    assert store.calls().collect() == [] and store.provenance().collect() == [] and store.clear() == 0
    assert plain({"b": (1, None), "a": {2, 1}, 3: len}) == {"3": "<callable len>", "a": [1, 2], "b": [1, None]}
    assert plain(spark.range(3)) == plain(spark.range(3)) != plain(spark.range(4))


# --- isolation forest


def walk(tree, row):
    at = depth = 0
    while tree["feature"][at] >= 0:
        at = tree["low"][at] if row[tree["feature"][at]] <= tree["cut"][at] else tree["high"][at]
        depth += 1
    n = tree["size"][at]
    return depth + (0 if n <= 1 else 1 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n)


def by_hand(graph, **options):
    trees = forest.forest(graph, **options).orderBy("tree").collect()
    n = trees[0]["size"][0]
    usual = 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n
    return {r.node_id: 2 ** (-np.mean([walk(t, r.features) for t in trees]) / usual) for r in graph.nodes.collect()}, trees


def test_isolation_against_walks_by_hand(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(300, 3)), [[9, 9, 9], [0, 0, 0]]])
    x = np.hstack([x, np.ones((len(x), 1))])
    graph = Graph(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node_id long, features array<double>"), spark.createDataFrame([], "src long, dst long"))
    want, trees = by_hand(graph, trees=20, sample=64, seed=3)
    got = {r.node_id: r.score for r in forest.isolation(graph, 20, 64, 3).collect()}
    assert len(trees) == 20 and all(t["size"][0] == 64 and len(t["size"]) < 128 for t in trees)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    assert max(got, key=got.get) == 300 and got[301] < 0.5
    repeated = {r.node_id: r.score for r in forest.isolation(Graph(graph.nodes.repartition(7), graph.edges), 20, 64, 3).collect()}
    assert repeated == got
    assert min(forest.isolation_conformity(graph, 20, 64, 3).collect(), key=lambda r: r.score).node_id == 300


def test_isolation_of_odd_graphs(spark):
    none = spark.createDataFrame([], "src long, dst long")
    of = lambda rows: Graph(spark.createDataFrame(rows, "node_id long, features array<double>"), none)
    assert forest.isolation_conformity(of([])).collect() == []
    assert {r.score for r in forest.isolation_conformity(of([(1, [1.0]), (2, [1.0]), (3, None)])).collect()} == {0.0}
    assert [r.score for r in forest.isolation_conformity(of([(1, [1.0, 2.0])])).collect()] == [0.0]


@has_tables
def test_registered_isolation_query(spark):
    graph = plans.parts(spark, FOLDER)
    want, _ = by_hand(graph)
    low, high = min(-v for v in want.values()), max(-v for v in want.values())
    got = {r.node_id: r.score for r in plans.isolation_conformity(spark, FOLDER).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - (-want[k] - low) / (high - low)) < 1e-6 for k in got)


# --- walks


def test_walks_follow_edges_and_hubs_give_one_row(spark):
    edges = [(0, i) for i in range(1, 200)] + [(1, 2), (300, 301)]
    graph = Graph(spark.range(303).selectExpr("id AS node_id", "array(1.0D) AS features"), spark.createDataFrame(edges, "src long, dst long"))
    near = {frozenset(e) for e in edges}
    rows = sampling.walks(graph, length=5).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sample, {})[r.place] = r.node
    assert len(by) == 303 and by[302] == {0: 302} and all(len(w) == 5 for s, w in by.items() if s not in (302, *range(202, 300), 200, 201))
    assert all(frozenset((w[p], w[p + 1])) in near for w in by.values() for p in range(len(w) - 1))
    assert len({w[1] for s, w in by.items() if s in range(3, 200)}) == 1 and len({w[2] for s, w in by.items() if s in range(1, 200)}) > 50
    found = {}
    for r in sampling.induced(graph, sampling.walks(graph, length=5)).collect():
        found.setdefault(r.sample, set()).add((r.src, r.dst))
    for s, w in by.items():
        inside = set(w.values())
        assert found.get(s, set()) == {(a, b) for a, b in edges if a in inside and b in inside}


# --- spectral gap


@pytest.mark.parametrize("name", ["path", "dense", "parted"])
def test_spectral_gap_against_a_dense_solver(spark, name):
    rng = np.random.default_rng(5)
    n, edges = {"path": (9, [(i, i + 1) for i in range(8)]), "dense": (14, [(a, b) for a in range(14) for b in range(14) if rng.random() < 0.4]), "parted": (8, [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (6, 7), (7, 7)])}[name]
    a = np.zeros((n, n))
    for x, y in edges:
        if x != y:
            a[x, y] += 0.5
            a[y, x] += 0.5
    graph = Graph(spark.range(n).selectExpr("id AS node_id", "array(1.0D) AS features"), spark.createDataFrame(edges, "src long, dst long"))
    assert abs(explore.spectral_gap(graph)["spectral_gap"] - np.linalg.eigvalsh(np.diag(a.sum(1)) - a)[1]) < 1e-6
    if name == "dense":
        with pytest.raises(ValueError):
            explore.spectral_gap(graph, most=2)


def test_spectral_gap_of_one_node(spark):
    graph = Graph(spark.createDataFrame([(1, [1.0])], "node_id long, features array<double>"), spark.createDataFrame([], "src long, dst long"))
    assert explore.spectral_gap(graph) == {"spectral_gap": 0.0, "size": "small"}


@has_tables
def test_registered_gap_query(spark):
    from graphsieve.sources.tables import user_graph

    graph = user_graph(spark, FOLDER)
    ids = {r.node_id: i for i, r in enumerate(graph.nodes.collect())}
    a = np.zeros((len(ids), len(ids)))
    for r in graph.symmetric.collect():
        a[ids[r.src], ids[r.dst]] = 1
    assert abs(plans.spectral_gap(spark, FOLDER).first().spectral_gap - np.linalg.eigvalsh(np.diag(a.sum(1)) - a)[1]) < 2e-6


# --- others


def test_sides_of_a_derived_graph_are_written_when_asked_for(spark, monkeypatch):
    from graphsieve import graph as module

    written = []
    monkeypatch.setattr(module, "keep", lambda df, name: written.append(name) or df)
    g = Derived(spark.createDataFrame([(1, [1.0])], "node_id long, features array<double>"), spark.createDataFrame([(1, 1)], "src long, dst long"), "g")
    assert g.n == 1 and written == ["nodes"] and g.m == 1 and g.dim == 1 and written == ["nodes", "edges"] and g.name == "g"


def test_tails_and_critical_differences():
    # finite sums for whole a and b, and the normal deviate's square
    assert abs(stats.f_tail(3.0, 4, 12) - 0.0625) < 1e-12 and stats.f_tail(float("inf"), 3, 4) == 0.0
    assert abs(stats.f_tail(4.0, 1, 10**7) - 0.0455003) < 1e-6 and abs(stats.f_tail(0.25, 6, 2) - (1 - stats.f_tail(4.0, 2, 6))) < 1e-12
    assert all(abs(stats.studentized_range(k) / 2**0.5 - q) < 2e-3 for k, q in enumerate(evaluate.NEMENYI, 2))


def test_friedman_of_many_methods(spark):
    rows = [(f"d{d}", f"m{m}", float((m * 7 + d * 3) % 13)) for d in range(6) for m in range(12)]
    found = evaluate.friedman(evaluate.method_ranks(spark.createDataFrame(rows, "dataset string, method string, value double")))
    assert found["k"] == 12 and found["cd_nemenyi"] > found["cd_bonferroni_dunn"] > 0 and 0 <= found["p_f"] <= 1
    assert abs(found["cd_nemenyi"] / (12 * 13 / 36) ** 0.5 - 3.268) < 2e-3


def test_nearest_is_exact_for_ties_and_scales():
    from graphsieve.operators import detectors

    rng = np.random.default_rng(0)
    for trial in range(12):
        n, m, dim = int(rng.integers(1, 400)), int(rng.integers(1, 200)), int(rng.integers(1, 6))
        x, y = (np.round(rng.normal(size=(c, dim)) * 10.0 ** int(rng.integers(-3, 5)), int(rng.integers(0, 3))) for c in (n, m))
        x[0] = np.nan if trial % 4 == 0 else x[0]
        ids, others = rng.permutation(1000)[:n], rng.permutation(1000)[:m]
        for with_self in (True, False):
            for k in (1, 5, 300):
                got = [(int(p), int(q), r) for part in detectors.nearest(ids, x, others, y, k, with_self) for p, q, r in zip(*part, strict=True)]
                want = []
                for i in range(n):
                    d = np.sqrt(((y - x[i]) ** 2).sum(1))
                    use = np.flatnonzero(with_self | (others != ids[i]))
                    want += [(int(ids[i]), int(others[j]), d[j]) for j in use[np.lexsort((others[use], d[use]))[:k]]]
                assert len(got) == len(want) and all(g[:2] == w[:2] and (g[2] == w[2] or np.isnan(g[2])) for g, w in zip(got, want, strict=True))
