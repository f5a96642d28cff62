"""Replay of decisions: the gate's conditions against the plain rules, one decision against many, measures by buckets."""

import random

import numpy as np
import pytest

from graphsieve.operators import evaluate, fusion, replay, study

NAMES = ["attribute_inflation", "clique_density", "contrastive", "local_affinity", "spectral", "trained:x", "trained:y"]


def test_gate_conditions_are_the_plain_rules(spark):
    rng = random.Random(4)
    rows, want = [], {}
    pairs = {(a, b): rng.choice([0.05, 0.3, 0.8, -0.6]) for i, a in enumerate(NAMES) for b in NAMES[i + 1 :] if rng.random() < 0.9}
    for avg_degree in (2.0, 9.0):
        for k in range(150):
            chosen = rng.sample(NAMES[2:] if k % 2 else NAMES, rng.randint(1, 5))
            of = lambda *values: {p: rng.choice(values) for p in chosen}  # noqa: B023, E731
            ued, tail, rho_d = of(0.0, 0.1, 0.2, 0.5, 0.9), of(0.1, 0.3, 0.5, 0.9), of(-0.9, 0.1, 0.59, 0.61)
            number = k + 1000 * int(avg_degree)
            rows += [(number, p, ued[p], tail[p], rho_d[p]) for p in chosen]
            want[number] = fusion.decide(chosen, ued, tail, pairs, rho_d, avg_degree), chosen
    weights = spark.createDataFrame(rows, "decision long, paradigm string, ued double, tail double, rho_d double")
    pair_rows = spark.createDataFrame([(*k, v) for k, v in pairs.items()], "a string, b string, rho double")
    modes = set()
    for avg_degree in (2.0, 9.0):
        own = weights.where(f"decision >= {1000 * int(avg_degree)} and decision < {1000 * int(avg_degree) + 1000}")
        for r in replay.decided(own, pair_rows, avg_degree).collect():
            gate, chosen = want[r.decision]
            stay = chosen if r.chosen is None else r.chosen
            assert (r.mode, r.reason, {p: float(p in stay) for p in chosen}) == (gate.mode, gate.reason, gate.deltas)
            assert (r.d is None) == (gate.d is None) and (r.d is None or abs(r.d - gate.d) < 1e-9 and abs(r.q - gate.q) < 1e-9)
            assert gate.trusted == (list(r.chosen) if r.trusted else [])
            modes.add(gate.reason.split(":")[0].split(" ")[-1])
    assert len(modes) >= 5


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(1)
    n = 120
    base = rng.random(n)
    scores = [(p, i, float(round(base[i] * w + rng.random() * (1 - w), 3))) for p, w in (("local_affinity", 0.9), ("spectral", 0.7), ("contrastive", 0.2), ("trained:x", 0.5), ("community", 0.0)) for i in range(n)]
    degrees = [(i, int(rng.integers(0, 9))) for i in range(n)]
    table = spark.createDataFrame(scores, "paradigm string, node_id long, score double")
    return table, spark.createDataFrame(degrees, "node_id long, degree long"), spark.createDataFrame([(i, i % 3) for i in range(n)], "node_id long, community long")


def test_many_decisions_equal_each_alone(spark, made):
    scores, degrees, communities = made
    sets = {1: ["local_affinity", "spectral"], 2: ["contrastive"], 3: ["local_affinity", "spectral", "contrastive", "community"], 4: ["trained:x", "spectral", "unknown"], 5: ["unknown"]}
    log = spark.createDataFrame([(k, p) for k, ps in sets.items() for p in ps + ps[:1]], "decision long, paradigm string")
    every = {b: replay.replay(scores, log, degrees, communities, 3.0, block=b) for b in (2, 1 << 14)}
    value = lambda df: {(r.decision, r.node_id): r.fused for r in df.collect()}
    got = value(every[1 << 14].fused)
    assert got == value(every[2].fused) and {k for k, _ in got} == {1, 2, 3, 4}
    for k, names in sets.items():
        if k < 5:
            alone = replay.single(scores.where(scores.paradigm.isin(names)), degrees, communities, 3.0)
            assert {(k, r.node_id): round(r.fused, 9) for r in alone.fused.collect()} == {key: round(v, 9) for key, v in got.items() if key[0] == k}
    # the fusion of the weights that the replay gives, by the function for overridden weights
    for k in (1, 3, 4):
        mode = every[2].gates.where(f"decision = {k}").first()["mode"]
        active = {r.paradigm: r.weight for r in every[2].weights.where(f"decision = {k} and final <> 0 and alpha <> 0").collect()}
        want = {r.node_id: r.fused for r in fusion.fuse(scores.where(scores.paradigm.isin([*active])), active, mode).collect()}
        assert all(abs(want[n] - v) < 1e-8 for (d, n), v in got.items() if d == k)


def test_empty_and_odd_inputs(spark, made):
    scores, degrees, communities = made
    none = replay.single(scores.limit(0), degrees, communities, 0.0)
    assert none.fused.collect() == [] and none.gates.collect() == []
    flat = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.5), ("b", 1, 0.5), ("b", 99, 0.7)], "paradigm string, node_id long, score double")
    got = replay.single(flat, degrees, communities, 0.0, {"b": False})
    assert {r.node_id for r in got.fused.collect()} <= {1, 2, 99} and got.weights.where("paradigm = 'b'").first().alpha == 0.0


def test_every_selection(spark):
    names = ["a", "b", "c", "d", "e"]
    got = {}
    for r in study.subset_log(spark, names).collect():
        got.setdefault(r.decision, set()).add(r.paradigm)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, study.subsets(names))) and all({names[i] for i in range(5) if m >> i & 1} == s for m, s in got.items())


def test_auroc_by_buckets_is_exact(spark):
    rng = np.random.default_rng(7)
    rows = [(g, float(np.round(rng.random(), d)), int(rng.random() < 0.3)) for g, d in (("ties", 1), ("fine", 6), ("flat", 0)) for _ in range(300)] + [("one", 0.5, 1), ("edge", 1.0, 1), ("edge", 0.0, 0)]
    frame = spark.createDataFrame(rows, "g string, score double, y int")
    want = {r.g: r.auroc for r in evaluate.auroc(frame, ["g"]).collect()}
    for buckets in (1, 7, 4096):
        got = {r.g: r.auroc for r in evaluate.auroc_by_buckets(frame, ["g"], buckets).collect()}
        assert got.keys() == want.keys() and all((want[g] is None and v is None) or abs(v - want[g]) < 1e-9 for g, v in got.items())


def test_equal_selections_are_worked_out_once(spark, made):
    scores, degrees, communities = made
    sets = {7: ["spectral", "community", "contrastive"], 3: ["contrastive", "spectral", "community"], 5: ["spectral"], 9: ["community", "spectral", "contrastive"]}
    log = spark.createDataFrame([(k, p) for k, ps in sets.items() for p in ps], "decision long, paradigm string")
    found = replay.replay(scores, log, degrees, communities, 3.0)
    assert {r.decision for r in found.once.select("decision").distinct().collect()} == {3, 5}
    rows = {k: {} for k in sets}
    for r in found.fused.collect():
        rows[r.decision][r.node_id] = r.fused
    assert rows[3] == rows[7] == rows[9] and len(rows[3]) == 120 and {r.decision for r in found.weights.collect()} == {r.decision for r in found.gates.collect()} == set(sets)
