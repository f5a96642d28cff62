"""Graphs kept as flags of pairs, beside the same graph with a row an edge."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphsieve import marked
from graphsieve.graph import Graph, label_propagation
from graphsieve.operators import explore
from graphsieve.sources import tables

NAN = float("nan")


@pytest.fixture(scope="module", params=[4096, 9])
def both(spark, request):
    """A marked graph of one block or several, with two lone nodes, and its plain twin."""
    rng = np.random.default_rng(4)
    seen = sorted({(int(u) * 1_000_003 - 5, int(c)) for u, c in rng.integers(0, 45, (110, 2))} | {(int(u) * 1_000_003 - 5, 99) for u in range(5, 17)})
    ids = sorted({u for u, _ in seen} | {7, 9})
    nodes = spark.createDataFrame([(u, [float(k % 7), NAN if k == 3 else float(k)]) for k, u in enumerate(ids)], "node_id long, features array<double>")
    before = marked.MARK_BLOCK
    marked.MARK_BLOCK = request.param
    graph = marked.Marked(nodes, spark.createDataFrame(seen, "user_id long, cell long"))
    assert graph.blocks == (1 if request.param == 4096 else 5)
    pairs = sorted({(a, b) for a, x in seen for b, y in seen if x == y and a != b})
    yield graph, Graph(nodes, spark.createDataFrame(pairs, "src long, dst long")), pairs
    marked.MARK_BLOCK = before


def table(df):
    return {r[0]: tuple("nan" if v != v else round(v, 9) for v in (r[1] if isinstance(r[1], list) else r[1:])) for r in df.collect()}


def test_sums_over_neighbours(both):
    graph, plain, pairs = both
    assert graph.m == len(pairs) == plain.m and table(graph.degrees) == table(plain.degrees)
    assert table(graph.neighbour_mean(graph.nodes, "features", 2)) == table(plain.neighbour_mean(plain.nodes, "features", 2))
    value = graph.nodes.select("node_id", F.col("features")[0].alias("v"))
    assert table(graph.neighbour_mean_scalar(value, "v")) == table(plain.neighbour_mean_scalar(value, "v"))
    # what is written is a bit a pair, not a row
    assert graph.units.count() <= graph.blocks * (graph.blocks + 1) // 2


def test_spectral_gap_of_flags(spark, monkeypatch):
    monkeypatch.setattr(marked, "MARK_BLOCK", 5)
    seen = [(u, c) for u in range(11) for c in (u, u + 1, 20 + u % 4)]
    a = np.array([[float(u != v and any((v, c) in seen for w, c in seen if w == u)) for v in range(11)] for u in range(11)])
    graph = marked.Marked(spark.range(11).selectExpr("id AS node_id", "array(1.0D) AS features"), spark.createDataFrame(seen, "user_id long, cell long"))
    assert abs(explore.spectral_gap(graph)["spectral_gap"] - np.linalg.eigvalsh(np.diag(a.sum(1)) - a)[1]) < 1e-6


def test_spectral_gap_of_flags_writes_no_table_a_step(both, monkeypatch):
    written, keep = [], tables.keep
    monkeypatch.setattr(tables, "keep", lambda df, name, by=None: written.append(name) or keep(df, name, by))  # explore asks for it when it runs
    graph, _, pairs = both
    ids = sorted(r.node_id for r in graph.nodes.collect())
    a = np.array([[float((u, v) in set(pairs)) for v in ids] for u in ids])
    found = explore.spectral_gap(graph)["spectral_gap"]
    assert not {"gap", "gap-step"} & {*written} and abs(found - np.linalg.eigvalsh(np.diag(a.sum(1)) - a)[1]) < 1e-6


def test_triangles_of_flags(both):
    graph, plain, _ = both
    columns = "node_id", "triangles", "degree", "clustering"
    assert table(graph.triangles.select(*columns)) == table(plain.triangles.select(*columns))


def test_labels_of_flags(both):
    graph, plain, _ = both
    labels = graph.nodes.select("node_id", F.pmod("node_id", F.lit(4)).alias("community"))
    count = lambda df: {(r.node_id, r.community): r.n for r in df.collect()}
    assert count(graph.votes(labels)) == count(plain.votes(labels))
    assert table(graph.least_neighbours()) == table(plain.least_neighbours())
    assert table(label_propagation(graph)) == table(label_propagation(plain))
