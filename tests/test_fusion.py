"""The gate's branches, fusion modes, evaluation, catalog rules, session and streams."""

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphsieve import catalog
from graphsieve.graph import Graph
from graphsieve.operators import evaluate, explore, fusion, neural
from graphsieve.operators.nets import Tensor
from graphsieve.plans import queries as plans
from graphsieve.session import EvidenceLog, Session
from graphsieve.streaming import events


def decide(names, quality=None, tails=None, rho=0.0, degree_rho=None, avg_degree=10):
    quality = quality or dict.fromkeys(names, 0.5)
    tails = dict.fromkeys(names, 0.5) | (tails or {})
    pairs = {(a, b): rho for a in names for b in names if a < b}
    return fusion.decide(names, quality, tails, pairs, degree_rho or {}, avg_degree)


def test_gate_branches():
    assert decide(["a"]).mode == "select"
    one = decide(["conformity", "x"])
    assert one.mode == "select" and one.deltas == {"conformity": 1.0, "x": 0.0}
    pair = decide(["clique_density", "contrastive", "local_affinity"])
    assert pair.mode == "pairmax" and pair.trusted == ["clique_density", "contrastive"]
    assert decide(["clique_density", "contrastive", "local_affinity"], avg_degree=2).trusted == ["clique_density", "local_affinity"]
    lone = decide(["clique_density", "contrastive"], degree_rho={"contrastive": 0.9}, rho=0.1)
    assert lone.mode == "aom" and "companion" in lone.reason
    assert decide(["conformity", "linear_residual", "x"]).mode == "aom"
    assert decide(["a", "b", "c"], {"a": 0.9, "b": 0.3, "c": 0.2}, {"a": 0.9}).deltas == {"a": 1.0, "b": 0.0, "c": 0.0}
    assert decide(["trained:m", "b"], tails={"trained:m": 0.9, "b": 0.5}).mode == "fuse"
    assert decide(["a", "b", "c"], rho=0.9).mode == "select"
    assert decide(["a", "b", "c"], rho=0.1).mode == "aom"
    assert decide(["a", "b", "c"], rho=0.65).mode == "hybrid"
    assert decide(["a", "b", "c"], {"a": 0.8, "b": 0.5, "c": 0.3}, {"b": 0.9}, rho=0.65).mode == "hybrid"


@pytest.fixture
def scores(spark):
    rng = np.random.default_rng(0)
    base = rng.random(80)
    rows = [(p, i, float(v)) for p, noise in (("a", 0.1), ("b", 0.2), ("c", 0.3), ("d", 5.0)) for i, v in enumerate(base + noise * rng.random(80))]
    return spark.createDataFrame(rows, "paradigm string, node_id long, score double")


def test_modes(scores):
    w = {"a": 0.5, "b": 0.3, "c": 0.2}
    ranks = {}
    for r in fusion.ranked(scores).collect():
        ranks.setdefault(r.node_id, {})[r.paradigm] = r.r
    got = {mode: {r.node_id: r.fused for r in fusion.fuse(scores, w, mode).collect()} for mode in ("select", "pairmax", "hybrid", "aom", "fuse")}
    for i, r in ranks.items():
        three = [r["a"], r["b"], r["c"]]
        assert got["select"][i] == r["a"] and got["pairmax"][i] == max(three) and got["hybrid"][i] == sorted(three)[1]
        assert got["fuse"][i] == pytest.approx(0.5 * r["a"] + 0.3 * r["b"] + 0.2 * r["c"])
        groups = fusion.aom_groups(["a", "b", "c"])
        assert got["aom"][i] == pytest.approx(np.mean([max(r[p] for p in g) for g in groups]))
    assert {r.fused for r in fusion.fuse(scores, {}, "fuse").collect()} == {0.0}
    assert {r.fused for r in fusion.fuse(scores, {"a": 0.0}, "fuse").collect()} == {0.0}
    with pytest.raises(ValueError):
        fusion.fuse(scores, w, "other")


def test_statistics_of_paradigms(scores, spark):
    q = {r.paradigm: r.ued for r in fusion.ued(scores).collect()}
    assert q.keys() == {"a", "b", "c", "d"} and all(0 <= v <= 1 for v in q.values())
    assert [r.ued for r in fusion.ued(scores.where("paradigm = 'a'")).collect()] == [0.5]
    assert {r.delta for r in fusion.prune(scores.where("paradigm in ('a', 'b')")).collect()} == {1}
    few = spark.createDataFrame([("a", i, float(i)) for i in range(4)], "paradigm string, node_id long, score double")
    assert fusion.tail_separation(few).first().tail_separation == 0.0
    deg = spark.createDataFrame([(i, i) for i in range(80)], "node_id long, degree long")
    assert set(fusion.mechanism_test(scores, deg)) >= {"consistency", "mechanism", "drop"}


def test_evaluation(spark):
    rows = spark.createDataFrame([(i, s, y) for i, (s, y) in enumerate(zip([0.1, 0.4, 0.35, 0.8], [0, 0, 1, 1], strict=True))], "node_id long, score double, y int")
    assert evaluate.auroc(rows, []).first().auroc == 0.75
    assert evaluate.average_precision(rows, []).first().ap == pytest.approx(0.8333, abs=1e-4)
    assert evaluate.recall_at(rows, [], 1).first().recall == 0.5
    ranks = spark.createDataFrame([("g", m, v) for m, v in (("a", 3.0), ("b", 2.0), ("c", None), ("d", None))], "dataset string, method string, value double")
    assert {r.method: r.rank for r in evaluate.method_ranks(ranks).collect()} == {"a": 1, "b": 2, "c": 3.5, "d": 3.5}
    all_ = spark.createDataFrame([(f"g{i}", m, float(v)) for i in range(6) for m, v in (("a", 3), ("b", 2), ("c", 1))], "dataset string, method string, value double")
    f = evaluate.friedman(evaluate.method_ranks(all_))
    assert f["chi2"] == pytest.approx(12.0) and f["ranks"]["a"] == 1.0 and f["p"] < 0.01


def test_decisions(spark):
    rows = spark.createDataFrame([("rich", "m", "g", 1, ["a", "b"], True, 0.5, 0.1, 1.0), ("rich", "m", "g", 2, ["b", "a"], True, 0.7, 0.3, 3.0), ("plain", "m", "g", 1, ["a"], False, 0.6, 0.2, 2.0)], "arm string, model string, dataset string, repeat int, selected array<string>, valid_json boolean, auroc double, auprc double, latency_s double")
    rep = {r.arm: r for r in evaluate.decision_report(rows).collect()}
    assert rep["rich"].stable and rep["rich"].latency == 3.0 and rep["plain"].validity == 0
    assert {r.paradigm for r in evaluate.majority_vote(rows).collect()} == {"a", "b"}
    assert evaluate.paired_arms(rows, "plain", "rich").first().changed == 1
    assert evaluate.arm_pivot(rows, ["m"]).count() == 2 and evaluate.median_of_models(rows).first().auroc == pytest.approx(0.6)
    assert catalog.validate_decision({"selected": ["a", "zz", "a"]}, ["a", "b"]) == {"valid_json": True, "selected": ["a"], "all_applicable": False, "invalid_names": ["zz"]}
    assert catalog.validate_decision(None, ["a"])["all_applicable"]


def test_catalog():
    fits = catalog.applicable({"num_nodes": 100, "homophily": 0.35, "feature_dim": 6})
    assert fits["local_affinity"] and not fits["homophily_violation"] and fits["conformity"] and not fits["subgraph_contrast"]
    assert catalog.PARADIGMS["local_affinity"].grounding({"homophily": 0.35}) == "homophily = 0.35 satisfies >= 0.3"
    r = catalog.recommend({"feature_dim": 120, "num_nodes": 5000, "feature_sparsity": 0.9, "avg_degree": 12, "homophily": 0.3})
    assert r["objectives"][:2] == ["gad_nr", "ego_matching"] and r["encoders"] == ["gat", "mlp"] and r["decoder"] == "none"
    assert len(catalog.complements({"feature_dim": 30, "num_nodes": 100}, 1)) == 4


def test_tape():
    rng = np.random.default_rng(0)
    a, b = Tensor(rng.normal(size=(3, 4))), Tensor(rng.normal(size=(4, 2)))
    f = lambda: ((a @ b).leaky().unit() * 2.0).sigmoid().log().mean()
    f().backward()
    slope, step = a.grad[1, 2], 1e-6
    a.value[1, 2] += step
    up = f().value
    a.value[1, 2] -= 2 * step
    assert (up - f().value) / (2 * step) == pytest.approx(slope, abs=1e-6)


@pytest.fixture(scope="module")
def graph(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (60, 5))
    x[5] += 8
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (160, 2)) if a != b]
    nodes = spark.createDataFrame([(i, v.tolist(), int(i == 5)) for i, v in enumerate(x)], "node_id long, features array<double>, label int").cache()
    return Graph(nodes, spark.createDataFrame(edges + [(b, a) for a, b in edges], "src long, dst long").cache(), "toy")


@pytest.mark.parametrize("name", sorted(neural.NEURAL))
def test_trained_detectors(graph, name):
    got = neural.NEURAL[name](graph, **({} if name == "linear_residual" else {"epochs": 5})).collect()
    assert len(got) == 60 and min(r.score for r in got) == 0 and max(r.score for r in got) == 1


def test_methods_of_parts(graph):
    import itertools

    local = neural.Local(np.arange(12), np.random.default_rng(0).normal(size=(12, 5)), np.arange(12), np.roll(np.arange(12), 1), np.arange(12) % 3)
    for objective, encoder in itertools.zip_longest(neural.OBJECTIVES, neural.ENCODERS, fillvalue="gcn"):
        got = neural.train_local({"objective": objective, "encoder": encoder, "decoder": "dual", "augmentation": neural.AUGMENTATIONS[len(objective) % 6], "epochs": 25, "hid": 8}, local)
        assert got.shape == (12,) and np.isfinite(got).all(), objective
    fused = neural.train_fusion(graph, [{"epochs": 3}, {"objective": "svdd", "epochs": 3}], "cross_attention")
    assert fused.count() == 60
    with pytest.raises(ValueError):
        neural.checked({"encoder": "none such"})
    with pytest.raises(ValueError):
        neural.in_one_task(graph, lambda g: g.ids, most=10)


def test_session(graph, spark, tmp_path):
    s = Session(spark)
    assert s.use(graph)["num_nodes"] == 60
    done = s.run(["homophily_violation", "density", "local_affinity", "nonsense"])
    assert set(done["failed"]) == {"nonsense"} and len(done["run"]) == 3
    s.register_paradigm("mine", "big first feature", lambda g: g.nodes.select("node_id", F.col("features")[0].alias("score")))
    s.run(["mine"])
    assert s.compose().mode in ("select", "aom", "hybrid", "fuse", "pairmax")
    assert s.top(5).count() == 5 and s.score_summary()["mode"] == s.gate.mode
    s.override_weight("density", "alpha", 0.0, "test")
    assert "density" not in s.weights.active()
    assert s.record_signals() == 4 and len(s.log.convergence(5)) >= 2
    assert s.convergent(2, record=True).count() == len(s.log.of_kind("convergence")) > 0
    card = s.node_card(5)
    assert card["scores"]["homophily_violation"]["percentile"] == pytest.approx(100 * 59 / 60)
    s.annotate([5], "looked at", cleared=True)
    assert 5 in s.log.conflicts()
    s.finding([5], "outlier", "stands out", 0.9)
    assert "stands out" in s.report(3)
    m = {r.paradigm: r for r in s.evaluate().collect()}
    assert m["homophily_violation"].auroc == 1.0 and "fused" in m
    assert explore.case_file(graph, s.table(), spark.createDataFrame([(5,)], "node_id long")).count() == 1
    assert explore.neighbourhood(graph, s.table(), 5)["isolated"] in (True, False)
    for a in catalog.ARTIFACTS:
        assert s.check_artifact(a, "density")["artifact"] == a
    s.save(str(tmp_path / "w"))
    t = Session(spark)
    t.use(graph)
    t.resume(str(tmp_path / "w"))
    assert t.table().count() == s.table().count() and len(t.log.rows) == len(s.log.rows)
    assert EvidenceLog.load(spark, str(tmp_path / "none")).rows == []
    s.build("quick", {"epochs": 3})
    s.train("quick")
    assert s.table().where("paradigm = 'trained:quick'").count() == 60


def test_streams(spark, tmp_path):
    rows = spark.sql("select timestamp_seconds(60 * id) as ts, 'click' as event_type, id % 3 as user_id from range(40)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, df in (("slots", events.slots(stream)), ("activity", events.activity(stream))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append" if name == "slots" else "complete").trigger(availableNow=True).start()
        q.awaitTermination(60)
        assert spark.table(name).count() > 0


def test_queries_train_in_full(spark, monkeypatch):
    assert {n: inspect.signature(f).parameters["epochs"].default for n, f in neural.NEURAL.items() if n != "linear_residual"} == dict.fromkeys(set(neural.NEURAL) - {"linear_residual"}, 100)
    assert inspect.signature(neural.subgraph_contrast).parameters["rounds"].default == 256
    given = {}
    for name in neural.NEURAL:
        monkeypatch.setitem(neural.NEURAL, name, lambda g, name=name, **options: given.update({name: options}))
    monkeypatch.setattr(neural, "train_method", lambda g, spec: given.update(composed_method=neural.checked(spec)["epochs"]))
    for name in ("user_graph", "keep", "Graph", "rounded"):
        monkeypatch.setattr(plans, name, lambda *a: type("G", (), {"nodes": None, "edges": None}))
    for name in [*(f"neural_{n}" for n in neural.NEURAL), "composed_method"]:
        plans.QUERIES[name](spark, "")
    assert given == dict.fromkeys(neural.NEURAL, {}) | {"composed_method": 100}


def dense_residual(x, src, dst, rounds, alpha, beta, gamma):
    n = len(x)
    a, eye = np.zeros((n, n)), np.eye(n)
    a[src, dst] = a[dst, src] = 1
    np.fill_diagonal(a, 0)
    laplace, gram, d_r, d_w = np.diag(a.sum(1)) - a, x @ x.T, np.ones(n), np.ones(n)
    r = np.linalg.solve((1 + beta) * eye + gamma * laplace, x)
    for _ in range(rounds):
        w = np.linalg.solve(gram + alpha * np.diag(d_w), gram - x @ r.T)
        d_w = 1 / (2 * np.maximum(np.sqrt((w**2).sum(1)), 1e-8))
        r = np.linalg.solve(eye + beta * np.diag(d_r) + gamma * laplace, x - w.T @ x)
        d_r = 1 / (2 * np.maximum(np.sqrt((r**2).sum(1)), 1e-8))
    return np.sqrt((r**2).sum(1))


def test_linear_residual_without_square_matrices(spark):
    rng = np.random.default_rng(2)
    for n, d, m in ((60, 8, 150), (200, 30, 700), (40, 3, 0)):
        x, src, dst = rng.normal(size=(n, d)), rng.integers(0, n, m), rng.integers(0, n, m)
        got = neural.residual_norms(neural.Local(np.arange(n), x, src, dst), 20, 0.01, 0.01, 0.01)
        assert np.allclose(got, dense_residual(x, src, dst, 20, 0.01, 0.01, 0.01), rtol=1e-5, atol=1e-7)
    nodes = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(3200, 4)).tolist())], "node_id long, features array<double>")
    edges = spark.createDataFrame([(i, (i * 7 + 1) % 3200) for i in range(3200)], "src long, dst long")
    assert neural.linear_residual(Graph(nodes, edges)).count() == 3200
