"""Isolation forest: how many random cuts part a node's features from a sample's, and conformity as the opposite.

Each tree is grown from SAMPLE nodes at most, drawn by a hash of node, tree and seed, in a task of its own, and kept
as flat arrays; all trees together are some 50,000 entries whatever the graph, which are broadcast. Then every node walks down all
trees, in blocks of rows. Cuts are uniform between a sample's extremes in a dimension that varies there, so scaling
a dimension changes nothing and features need no z-scores.

Null features, empty graphs: no score of their own (0 after scaling). Equal features get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphsieve.functions.stats import min_max
from graphsieve.graph import Graph

TREES, SAMPLE = 100, 256
TREE = "tree int, feature array<int>, cut array<double>, low array<int>, high array<int>, size array<int>"


def usual_depth(n: float) -> float:
    """The mean number of cuts that part one of ``n`` from the others in a random search tree."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def grow(x: np.ndarray, rng: np.random.Generator, deepest: int) -> dict[str, list]:
    """A tree over the rows of ``x`` as flat arrays; -1 as feature marks a leaf."""
    out: dict[str, list] = {"feature": [], "cut": [], "low": [], "high": [], "size": []}
    todo = [(np.arange(len(x)), 0, None, "low")]
    while todo:
        rows, depth, parent, side = todo.pop()
        at = len(out["size"])
        if parent is not None:
            out[side][parent] = at
        for name, value in (("feature", -1), ("cut", 0.0), ("low", -1), ("high", -1), ("size", len(rows))):
            out[name].append(value)
        least, most = (x[rows].min(0), x[rows].max(0)) if len(rows) else (np.zeros(0), np.zeros(0))
        varied = np.flatnonzero(most > least)
        if depth >= deepest or len(rows) <= 1 or not len(varied):
            continue
        f = int(varied[rng.integers(len(varied))])
        cut = float(rng.uniform(least[f], most[f]))
        below = x[rows, f] <= cut
        out["feature"][at], out["cut"][at] = f, cut
        todo += [(rows[~below], depth + 1, at, "high"), (rows[below], depth + 1, at, "low")]
    return out


def forest(graph: Graph, trees: int = TREES, sample: int = SAMPLE, seed: int = 1) -> DataFrame:
    """TREE: a row for each tree."""
    nodes = graph.nodes.where("features is not null").select("node_id", "features")
    n = nodes.count()
    # half more than wanted, so that nearly every tree gets its sample without a sort of all nodes
    share = min(1.0, 1.5 * sample / max(1, n))
    place = lambda t: F.xxhash64("node_id", t, F.lit(seed))
    drawn = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(place(t), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = nodes.withColumn("tree", F.explode(drawn)).withColumn("at", place(F.col("tree")))
    order = F.row_number().over(Window.partitionBy("tree").orderBy("at", "node_id"))
    chosen = rows.withColumn("k", order).where(F.col("k") <= sample).select("tree", "node_id", "features")
    deepest = int(np.ceil(np.log2(max(2, sample))))

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("node_id")
        x = np.array(table.column("features").to_pylist(), float).reshape(table.num_rows, -1)
        tree = table.column("tree")[0].as_py()
        made = grow(x, np.random.default_rng([seed, tree]), deepest)
        kinds = {"cut": pa.float64()}
        return pa.table({"tree": pa.array([tree], pa.int32()), **{k: pa.array([v], pa.list_(kinds.get(k, pa.int32()))) for k, v in made.items()}})

    return chosen.groupBy("tree").applyInArrow(build, TREE)


def depths(x: np.ndarray, tree: dict[str, np.ndarray]) -> np.ndarray:
    """The length of each row's path, with what its leaf's size would add."""
    at, depth = np.zeros(len(x), np.int64), np.zeros(len(x))
    inside = tree["feature"][at] >= 0
    while inside.any():
        here = at[inside]
        low = x[np.flatnonzero(inside), tree["feature"][here]] <= tree["cut"][here]
        at[inside] = np.where(low, tree["low"][here], tree["high"][here])
        depth[inside] += 1
        inside = tree["feature"][at] >= 0
    return depth + np.array([usual_depth(s) for s in tree["size"]])[at]


def isolation(graph: Graph, trees: int = TREES, sample: int = SAMPLE, seed: int = 1) -> DataFrame:
    """node_id, score: 2 to the power of minus the mean path length over the usual one; near 1 for who is parted early."""
    grown = [{k: np.array(v) for k, v in r.asDict().items() if k != "tree"} | {"n": r["size"][0]} for r in forest(graph, trees, sample, seed).orderBy("tree").collect()]  # ``trees`` rows of 2 * ``sample`` entries at most
    held = graph.nodes.sparkSession.sparkContext.broadcast(grown)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("features").to_pylist(), float).reshape(batch.num_rows, -1)
            total = np.zeros(batch.num_rows)
            for tree in held.value:
                total += depths(x, tree)
            usual = usual_depth(max((t["n"] for t in held.value), default=1))
            score = np.exp2(-total / len(held.value) / usual) if usual else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("node_id"), pa.array(score)], ["node_id", "score"])

    return graph.nodes.where("features is not null").select("node_id", "features").mapInArrow(run, "node_id long, score double")


def isolation_conformity(graph: Graph, trees: int = TREES, sample: int = SAMPLE, seed: int = 1) -> DataFrame:
    """node_id, score: who is hardest to part from the others stands out; scaled to 0..1."""
    found = graph.nodes.select("node_id").join(isolation(graph, trees, sample, seed), "node_id", "left")
    return min_max(found.select("node_id", (-F.col("score")).alias("score"))).fillna({"score": 0.0})
