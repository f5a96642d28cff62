"""The permutation index against brute force."""

import numpy as np
from pyspark.sql import functions as F

from graphsieve.llm import ann

SCHEMA = "vec_id long, embedding array<float>, v string, score int, label int"


def brute(rows, k=5):
    ok = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v) and len(v) == 16}
    ids = np.array(sorted(ok))
    m = np.array([ok[i] for i in ids])
    out = {}
    for q in ids[ids % 50 == 0].tolist():
        s = np.array([ann.cosines(m[j : j + 1], ok[q])[0] for j in range(len(ids))])
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), s[j]) for j in order]
    return out


def vectors(seed, n):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.standard_normal(16).astype(np.float32).tolist()) for i in range(n)]
    for i in range(n // 3):  # one vector with very many copies
        rows[3 * i] = (3 * i, rows[0][1])
    return rows


def run(spark, rows, **options):
    docs = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], SCHEMA)
    return ann.search(docs, F.col("vec_id") % 50 == 0, **options).collect()


def test_small_tables_are_exact(spark):
    rows = [*vectors(1, 240), (1000, None), (1050, [0.0] * 16), (1100, [float("nan")] * 16), (1150, [None] + [1.0] * 15), (None, [1.0] * 16), (1200, [1.0, 2.0]), (0, vectors(1, 240)[0][1])]
    got = {}
    for r in sorted(run(spark, rows), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(rows)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-15)


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 1500)
    rows = vectors(2, 5000)
    want = brute(rows)
    got = {(r.query_id, r.vec_id) for r in run(spark, rows)}
    assert len(got) == 5 * len(want)
    assert np.mean([(q, i) in got for q, found in want.items() for i, _ in found]) >= 0.9


def test_footrule():
    rng = np.random.default_rng(4)
    x, p = rng.standard_normal((40, 8)), rng.standard_normal((12, 8))
    index = ann.Index(x, p, 5)
    order = ann.orders(x, p, 5)
    q = ann.orders(rng.standard_normal((1, 8)), p, 5)[0]
    place = lambda o, pivot: o.tolist().index(pivot) if pivot in o else 5
    assert index.footrules(q).tolist() == [sum(abs(place(o, v) - place(q, v)) for v in range(12)) for o in order]


def test_few_or_none(spark):
    assert run(spark, []) == [] and run(spark, [(50, [1.0, 2.0])]) == []
    assert [(r.query_id, r.rank, r.vec_id) for r in run(spark, [(50, [1.0, 2.0]), (51, [2.0, 4.0])])] == [(50, 1, 51)]


def test_magnitude_does_not_tell(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((120, 4))
    plain = [(i, v.tolist()) for i, v in enumerate(x)]
    far = [(i, (v * 10.0 ** (300 if i % 2 else -300)).tolist()) for i, v in enumerate(x)]
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [[(r.query_id, r.rank, r.vec_id) for r in ann.search(frame(rows), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()] for rows in (plain, far)]
    assert got[0] == got[1] and len(got[0]) == 15
