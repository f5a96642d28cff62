"""Gaps, candidate rules and logs on small tables; saving and resuming a session."""

import numpy as np
import pytest

from graphsieve.graph import Graph
from graphsieve.operators import fusion, replay, study
from graphsieve.session import Session
from graphsieve.sources.tables import keep, read_scores, write_scores


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(4)
    n = 80
    one = rng.normal(size=n)
    by = {"a": one, "b": one + rng.normal(size=n) * 0.1, "c": rng.normal(size=n), "d": -one}
    scores = spark.createDataFrame([(p, i, float(v)) for p, x in by.items() for i, v in enumerate(x)], "paradigm string, node_id long, score double")
    nodes = spark.createDataFrame([(i, [float(one[i]), float(i % 7), 1.0], int(i % 10 == 0)) for i in range(n)], "node_id long, features array<double>, label int")
    edges = spark.createDataFrame([(i, (i * k + 1) % n) for i in range(n) for k in (2, 3, 5) if i != (i * k + 1) % n], "src long, dst long")
    return by, scores, Graph(nodes, edges, "made")


def shares(x):
    return np.argsort(np.argsort(x)) / (len(x) - 1)


def test_clusters_follow_their_first_one():
    rho = {("a", "b"): 0.7, ("b", "c"): 0.9, ("a", "c"): 0.5, ("a", "d"): -0.8, ("b", "d"): 0.1, ("c", "d"): 0.1}
    assert study.clusters(["a", "b", "c", "d"], rho) == [["a", "b", "d"], ["c"]]
    assert study.clusters(["a", "b"], {}) == [["a", "b"]]


def test_gaps(made, spark):
    by, scores, _ = made
    found = study.diagnose_gaps(scores)
    assert found["coverage_clusters"] == [["a", "b", "d"], ["c"]] and found["num_paradigms"] == 4
    top = np.argsort(-by["a"])[:8]
    want = np.corrcoef(np.argsort(np.argsort(by["a"][top])), np.argsort(np.argsort(by["c"][top])))[0, 1]
    assert abs(found["tail_agreement"]["a|c"] - want) < 2e-3
    assert study.diagnose_gaps(scores.where("paradigm = 'a'"))["coverage_clusters"] == [["a"]]
    assert study.diagnose_gaps(scores.limit(0)) == {"signal_count": 0, "tail_agreement": {}, "bimodality": {}, "coverage_clusters": [[]]}


def test_rules(made):
    by, scores, graph = made
    got = lambda rule, sel, **k: {r.node_id: r.fused for r in study.by_rule(rule, scores, sel, graph, **{"always": True} | k).collect()}
    near = lambda x, want: np.allclose([x[i] for i in range(len(want))], want, atol=1e-9)
    assert near(got("order_decay", ["c", "a"]), (shares(by["c"]) + 0.5 * shares(by["a"])) / 1.5)
    assert near(got("lead_only", ["c", "a"]), shares(by["c"]))
    assert near(got("adjudicator", ["c", "a"], adjudication={"mode": "single", "view": " a "}), shares(by["a"]))
    shipped = {r.node_id: r.fused for r in fusion.compose(scores.where("paradigm in ('a', 'c')"), graph)[0].collect()}
    assert got("adjudicator", ["c", "a"]) == shipped == got("consensus_filter", ["c", "a"])
    kept = {r.node_id: r.fused for r in fusion.compose(scores.where("paradigm in ('a', 'b')"), graph)[0].collect()}
    assert got("consensus_filter", ["a", "b", "d"]) == kept  # d runs against the two others
    best = fusion.ued(scores.where("paradigm in ('a', 'b', 'c')")).orderBy("ued", ascending=False).first().paradigm
    assert near(got("ued_top1", ["a", "b", "c"]), shares(by[best]))
    rho = lambda p, q: np.corrcoef(shares(by[p]), shares(by[q]))[0, 1]
    w = {p: max(0.0, np.median([rho(p, q) for q in "abc" if q != p])) for p in "abc"}
    assert near(got("agreement_weight", ["a", "b", "c"]), sum(w[p] * shares(by[p]) for p in w) / sum(w.values()))
    with pytest.raises(ValueError):
        got("none such", ["a"])
    fused, _, gate = fusion.compose(scores.where("paradigm in ('a', 'b', 'c')"), graph)
    plain = {r.node_id: r.fused for r in fused.collect()}
    assert (got("lead_only", ["c", "a", "b"], always=False) == plain) == (gate.mode != "aom")


def test_rules_over_a_log_are_those_of_each_decision(made, spark):
    by, scores, graph = made
    sets = {1: ["c", "a", "b"], 2: ["a", "b", "d"], 3: ["c", "d", "a", "b"], 4: ["a"], 5: ["b", "c"]}
    log = spark.createDataFrame([(k, p, i) for k, ps in sets.items() for i, p in enumerate(ps)], "decision long, paradigm string, place int")
    answers = spark.createDataFrame([(1, "single", " a "), (2, "gate", None), (3, "single", "z")], "decision long, mode string, view string")
    found = replay.replay(scores, log, graph.degrees, graph.communities, graph.m / graph.n)
    found.fused = keep(found.fused, "fused")
    modes = {r.decision: r["mode"] for r in found.gates.collect()}
    told = {1: {"mode": "single", "view": " a "}, 2: {"mode": "gate"}, 3: {"mode": "single", "view": "z"}}
    for rule in ("order_decay", "agreement_weight", "consensus_filter", "drop_lowest_ued", "ued_top1", "lead_only", "adjudicator"):
        got = {}
        for r in study.by_rules(rule, scores, log, graph.degrees, graph.communities, graph.m / graph.n, answers, found).collect():
            got.setdefault(r.decision, {})[r.node_id] = r.fused
            assert modes[r.decision] == "aom" or not r.ruled
        for k in {"order_decay": (1,), "consensus_filter": (2,), "adjudicator": (1,)}.get(rule, ()):
            want = {r.node_id: r.fused for r in study.by_rule(rule, scores, sets[k], graph, told.get(k)).collect()}
            assert got[k].keys() == want.keys() and all(abs(got[k][n] - want[n]) < 1e-8 for n in want), (rule, k)
        assert got.keys() == sets.keys()


def test_arms_and_evidence(spark):
    rows = spark.createDataFrame([("x", p) for p in ("community", "contrastive", "density", "one_class", "spectral")] + [("y", "one_class"), ("y", "contrastive")], "dataset string, paradigm string")
    of = lambda arm, **k: {r.dataset: r.selected for r in study.arm_selection(arm, rows, **k).collect()}
    assert len(of("all_applicable")["x"]) == 5 and of("closed_form") == {"x": ["community", "density", "spectral"], "y": ["contrastive"]}
    drawn = [tuple(of("random3", seed=k)["x"]) for k in range(8)]
    assert all(len(set(d)) == 3 for d in drawn) and len(set(drawn)) > 1 and len(of("random3")["y"]) == 2 and drawn[0] == tuple(of("random3", seed=0)["x"])
    with pytest.raises(ValueError):
        study.arm_selection("other", rows)
    scores = spark.createDataFrame([("a", i, i / 3) for i in range(4)], "paradigm string, node_id long, score double")
    pack = study.evidence_pack({"num_nodes": 4, "density": 0.123456}, [{"name": "a", "assumption": "", "reason": "n is 4"}], study.landmarkers(scores))
    assert pack["profile"] == {"num_nodes": 4, "density": 0.1235} and pack["paradigms"] == [{"name": "a", "reason": "n is 4"}] and pack["statistics"]["a"]["mean"] == 0.5 and "domain" not in pack


def test_policies_and_logs(made, spark):
    _, scores, _ = made
    assert len(list(study.subsets(list("abcde"), 4))) == 5 + 10 + 10 + 5
    assert [r.place for r in study.policy(scores, "tail_separation", 2).orderBy("place").collect()] == [1, 2]
    results = spark.createDataFrame([("x", "a,b", 0.8), ("y", "a,b", 0.6), ("x", "a", 0.9), ("y", "a", 0.4)], "dataset string, selection string, auroc double")
    assert study.best_fixed(results).first().selection == "a,b"
    log = spark.createDataFrame([("m", 0.0), ("m", None), ("k:1", None), ("k:1", 0.7)], "model string, temperature double")
    assert study.canonical(log, ("k:",)).count() == 2 and study.canonical(log).count() == 1
    cat = spark.createDataFrame([("a", "old"), ("b", "old")], "paradigm string, description string")
    assert {tuple(r) for r in study.enriched(cat, cat.where("paradigm = 'b'").withColumn("description", cat.paradigm)).collect()} == {("a", "old"), ("b", "b")}


def test_scores_are_replaced_or_added(spark, tmp_path):
    frame = lambda v, p: spark.createDataFrame([(p, 1, v)], "paradigm string, node_id long, score double")
    path = str(tmp_path / "s")
    write_scores(frame(1.0, "a").union(frame(1.0, "b")), path, "x", 0)
    write_scores(frame(2.0, "a"), path, "x", 0)
    assert {(r.paradigm, r.score) for r in read_scores(spark, path, "x", 0).collect()} == {("a", 2.0), ("b", 1.0)}
    write_scores(frame(3.0, "a").union(frame(3.0, "c")), path, "x", 0, replace=False)
    assert {(r.paradigm, r.score) for r in read_scores(spark, path, "x", 0).collect()} == {("a", 2.0), ("b", 1.0), ("c", 3.0)}


def test_a_session_resumes_as_it_was(made, spark, tmp_path):
    _, scores, graph = made
    s = Session(spark)
    s.graph = graph
    for p in "abc":
        s.set_scores(p, scores.where(f"paradigm = '{p}'").select("node_id", "score"))
    s.compose()
    s.override_weight("a", "alpha", 0.5, "as a test")
    s.build("m", {"encoder": "gcn", "objective": "svdd", "decoder": "none", "augmentation": "none"})
    s.finding([3], "odd", "stands out", 0.9)
    before = [tuple(r) for r in s.top(10).collect()]
    s.save(str(tmp_path / "w"))
    s.save(str(tmp_path / "w"))
    t = Session(spark)
    t.graph = graph
    t.resume(str(tmp_path / "w"))
    assert [tuple(r) for r in t.top(10).collect()] == before
    assert t.weights.overrides == s.weights.overrides and t.gate == s.gate and set(t.methods) == {"m"}
    assert len(t.all_findings()) == 1 and t.session_info()["overrides"] == 1 and len(t.audit_trail(2)) == 2
    # scores changed after resuming take the place of the old ones
    t.set_scores("a", scores.where("paradigm = 'c'").select("node_id", "score"))
    t.save(str(tmp_path / "w"))
    u = Session(spark)
    u.graph = graph
    u.resume(str(tmp_path / "w"))
    assert {r.score for r in u.table().where("paradigm = 'a'").collect()} == {r.score for r in scores.where("paradigm = 'c'").collect()}
    assert u.method_scores("a", 3)["top"][0][1] == u.method_scores("c", 1)["top"][0][1]
    assert u.score_matrix().count() == 80 and u.component_info("encoders", "gcn")["name"] == "gcn"
    assert study.dataset_statistics({"num_nodes": 80, "x": 0.123456}, graph.nodes) == {"num_nodes": 80, "x": 0.1235, "anomaly_rate_pct": 10.0}
