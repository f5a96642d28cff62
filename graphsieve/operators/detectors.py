"""Detectors in closed form: a graph to node_id, score; higher is more anomalous, scaled to 0..1.

All are joins, aggregations and rank windows, except where a decomposition is asked for: singular vectors come from
the features' Gram matrix (dim x dim, whatever the number of nodes), eigenvectors of small graphs from one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphsieve.functions.stats import distance, dot, long_form, min_max, norm, ordinal_rank
from graphsieve.graph import Graph
from graphsieve.sources.tables import keep

#: Up to so many nodes the spectral detector takes exact eigenvectors.
EXACT_SPECTRAL = 3000
#: Rows of each side in one unit of the neighbour search, and numbers (rows times dimensions).
KNN_BLOCK, KNN_NUMBERS = 1 << 16, 1 << 22
#: Blocks that smaller tables are dealt into, so that 49 units share the work, and rows that a block has then at least.
KNN_SPREAD, KNN_LEAST = 7, 2048
#: The Gram matrix is summed up in the driver's memory: so long a feature vector at most.
GRAM_DIM = 8192


def everyone(graph: Graph, found: DataFrame, value: str, default) -> DataFrame:
    """All nodes, with ``default`` for those not found."""
    return graph.nodes.select("node_id").join(found, "node_id", "left").select("node_id", F.coalesce(value, default).alias("score"))


def local_affinity(graph: Graph) -> DataFrame:
    """1 minus the mean cosine with the neighbours; 1 for isolated nodes."""
    u = graph.units
    pairs = graph.weighted.join(u.select(F.col("node_id").alias("src"), F.col("u").alias("us")), "src").join(u.select(F.col("node_id").alias("dst"), F.col("u").alias("ud")), "dst")
    near = pairs.groupBy(F.col("src").alias("node_id")).agg((F.sum(dot("us", "ud") * F.col("w")) / F.sum("w")).alias("near"))
    return min_max(everyone(graph, near.select("node_id", (1 - F.col("near")).alias("far")), "far", F.lit(1.0)))


def homophily_violation(graph: Graph) -> DataFrame:
    """Distance from the neighbours' mean; isolated nodes get the others' median, or 0.5."""
    far = graph.neighbour_distance
    middle = far.agg(F.coalesce(F.percentile("distance", 0.5), F.lit(0.5)).alias("middle"))
    rows = graph.nodes.select("node_id").join(far, "node_id", "left").crossJoin(F.broadcast(middle))  # one row
    return min_max(rows.select("node_id", F.coalesce("distance", "middle").alias("score")))


def community(graph: Graph) -> DataFrame:
    """Distance from the community's centroid over the mean distance there; 0 in communities of one."""
    from graphsieve.functions.stats import mean_vector

    members = graph.nodes.select("node_id", "features").join(graph.communities, "node_id")
    centre = members.groupBy("community").agg(mean_vector("features", graph.dim).alias("centre"), F.count("*").alias("size"))
    far = members.join(centre, "community").select("node_id", "community", F.when(F.col("size") < 2, 0.0).otherwise(distance("features", "centre")).alias("far"), "size")
    usual = far.groupBy("community").agg(F.avg("far").alias("usual"))
    scored = far.join(usual, "community").select("node_id", (F.col("far") / F.when(F.col("size") < 2, F.lit(1.0)).otherwise(F.greatest("usual", F.lit(1e-8)))).alias("score"))
    return min_max(scored)


def spectral_signal(graph: Graph) -> DataFrame:
    """node_id, s: the length of the features."""
    return graph.nodes.select("node_id", norm("features").alias("s"))


def spectral_residual(graph: Graph) -> DataFrame:
    """Half of |s - Ps| and half of |s - PPs|, with P the mean over neighbours (0 without any)."""
    signal = spectral_signal(graph)
    once = signal.select("node_id").join(graph.neighbour_mean_scalar(signal, "s"), "node_id", "left").select("node_id", F.coalesce("mean", F.lit(0.0)).alias("p1"))
    twice = graph.neighbour_mean_scalar(once, "p1").withColumnRenamed("mean", "p2")
    rows = signal.join(once, "node_id").join(twice, "node_id", "left")
    return min_max(rows.select("node_id", (0.5 * F.abs(F.col("s") - F.col("p1")) + 0.5 * F.abs(F.col("s") - F.coalesce("p2", F.lit(0.0)))).alias("score")))


def spectral(graph: Graph, most: int = EXACT_SPECTRAL) -> DataFrame:
    """Energy of the features' length in the upper half of the 50 smoothest Laplacian eigenvectors; above ``most`` nodes ``spectral_residual``.

    The bound is known before anything is gathered; a graph of so few nodes fits one task.
    """
    if graph.n > most or graph.n < 4:
        return spectral_residual(graph)
    signal = spectral_signal(graph).select(F.lit(0).alias("one"), "node_id", "s")
    pairs = graph.weighted.select(F.lit(0).alias("one"), "src", "dst", "w")

    def solve(nodes: pa.Table, edges: pa.Table) -> pa.Table:
        ids, s = nodes.column("node_id").to_numpy(), nodes.column("s").to_numpy()
        order = np.argsort(ids)
        ids, s = ids[order], s[order]
        a = np.zeros((len(ids), len(ids)))
        np.add.at(a, (np.searchsorted(ids, edges.column("src").to_numpy()), np.searchsorted(ids, edges.column("dst").to_numpy())), edges.column("w").to_numpy())
        a = (a + a.T) / 2
        _, u = np.linalg.eigh(np.diag(a.sum(1)) - a)
        k = min(50, len(ids) - 2)
        high = u[:, k // 2 : k]
        score = ((high.T @ s) ** 2 * high**2).sum(1)
        return pa.table({"node_id": pa.array(ids), "score": pa.array(score)})

    return min_max(signal.groupBy("one").cogroup(pairs.groupBy("one")).applyInArrow(solve, "node_id long, score double"))


def gram(graph: Graph) -> np.ndarray:
    """The features' dim x dim Gram matrix: summed per task in numpy, then over tasks."""
    dim = graph.dim
    if dim > GRAM_DIM:
        raise ValueError(f"features have {dim} dimensions, more than {GRAM_DIM}")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = np.array(batch.column("features").to_pylist(), float).reshape(-1, dim)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    rows = graph.nodes.select("features").mapInArrow(partial, "i long, row array<double>")
    sums = rows.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((dim, dim))
    out[sums.column("i").to_numpy(), sums.column("j").to_numpy()] = sums.column("v").to_numpy()
    return out


def svd_residual(graph: Graph, rank: int = 5) -> DataFrame:
    """node_id, residual: length of what the first right singular vectors (uncentred) leave of the features; 0 if there are none."""
    k = min(rank, graph.dim - 1)
    if k < 1:
        return graph.nodes.select("node_id", F.lit(0.0).alias("residual"))
    _, vectors = np.linalg.eigh(gram(graph))
    top = vectors[:, ::-1][:, :k].T.tolist()
    # what is left has the squared length of the features without that of the projections
    inside = sum((F.pow(dot("features", F.array(*[F.lit(float(x)) for x in v])), F.lit(2)) for v in top), F.lit(0.0))
    return graph.nodes.select("node_id", F.sqrt(F.greatest(F.lit(0.0), F.pow(norm("features"), F.lit(2)) - inside)).alias("residual"))


def conformity(graph: Graph) -> DataFrame:
    """Minus the residual of a low-rank fit: who fits too well stands out."""
    return min_max(svd_residual(graph).select("node_id", (-F.col("residual")).alias("score")))


def peripheral_mismatch(graph: Graph) -> DataFrame:
    """Mean ordinal rank of: few neighbours, a large low-rank residual, features unlike the neighbours' (z-scores), clustering."""
    long = long_form(graph.nodes)
    moments = long.groupBy("dim").agg(F.avg("value").alias("mu"), F.greatest(F.stddev_pop("value"), F.lit(1e-9)).alias("sd"))
    z = long.join(moments, "dim").select("node_id", "dim", ((F.col("value") - F.col("mu")) / F.col("sd")).alias("z"))
    z = z.groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "z"))), lambda e: e["z"]).alias("z"))  # dim entries a node
    mean = graph.neighbour_mean(z, "z", graph.dim)
    zero = F.transform("z", lambda x: F.lit(0.0))
    apart = z.join(mean, "node_id", "left").select("node_id", distance("z", F.coalesce("mean", zero)).alias("apart"))
    rows = graph.triangles.join(svd_residual(graph), "node_id").join(apart, "node_id").withColumn("few", -F.col("degree"))
    top = F.greatest(F.count("*").over(Window.partitionBy()) - 1, F.lit(1))
    parts = [ordinal_rank(c, []) / top for c in ("few", "residual", "apart", "clustering")]
    return min_max(rows.select("node_id", (sum(parts[1:], parts[0]) / 4).alias("score")))


def attribute_inflation(graph: Graph) -> DataFrame:
    """Mean over the dimensions that vary of the ordinal rank's share; one shuffle by dimension, one by node."""
    long = long_form(graph.nodes)
    varied = long.groupBy("dim").agg(F.stddev_pop("value").alias("sd"), F.count("*").alias("n")).where("sd > 1e-12")
    ranked = long.join(varied, "dim").select("node_id", (ordinal_rank("value", ["dim"]) / F.greatest(F.col("n") - 1, F.lit(1))).alias("r"))
    return min_max(everyone(graph, ranked.groupBy("node_id").agg(F.avg("r").alias("r")), "r", F.lit(0.0)))


def clique_density(graph: Graph) -> DataFrame:
    """Triangles times clustering coefficient."""
    return min_max(graph.triangles.select("node_id", (F.col("triangles") * F.col("clustering")).alias("score")))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of numbers; null entries are NaN."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def nearest(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, k: int, with_self: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For rows of ``x``, some at once: node, other, distance of the ``k`` nearest rows of ``y``, ties to the smaller id.

    A product of matrices gives squared distances up to rounding; whoever may be among the nearest by these is then measured exactly.
    """
    size_y = (y * y).sum(1)
    rows = max(1, (1 << 22) // max(1, len(y)))  # some 32 MB of distances at once
    for at in range(0, len(x), rows):
        part, own = x[at : at + rows], ids[at : at + rows]
        size = (part * part).sum(1)
        rough = size[:, None] + size_y - 2 * (part @ y.T)
        allowed = np.ones(rough.shape, bool) if with_self else own[:, None] != others
        rough[~allowed | np.isnan(rough)] = np.inf
        last = np.partition(rough, min(k, len(y)) - 1, axis=1)[:, min(k, len(y)) - 1]
        slack = np.nan_to_num(1e-9 * (size + np.nanmax(size_y, initial=0.0))) + 1e-12
        row, col = np.nonzero((rough <= (last + slack)[:, None]) & allowed)
        d = np.sqrt(((y[col] - part[row]) ** 2).sum(1))
        order = np.lexsort((others[col], d, row))
        row, col, d = row[order], col[order], d[order]
        first = np.searchsorted(row, row)
        near = np.arange(len(row)) - first < k
        yield own[row[near]], others[col[near]], d[near]


def knn_blocks(n: int, dim: int) -> int:
    """Blocks of each side: as few as memory allows, since each node is shipped once a block, but enough to share the work."""
    return max(1, -(-n // max(1, min(KNN_BLOCK, KNN_NUMBERS // max(1, dim)))), min(KNN_SPREAD, -(-n // KNN_LEAST)))


def neighbours(nodes: DataFrame, k: int, with_self: bool) -> DataFrame:
    """node_id, other, d, place: the ``k`` nearest by Euclidean distance, ties to the smaller id.

    Nodes are dealt into blocks; each pair of blocks is a unit that keeps k rows a node, so memory is bounded
    and what is shuffled is each node once a block and k rows a node and block, not all pairs.
    """
    n, dim = nodes.agg(F.count("*"), F.max(F.size("features"))).first()
    n_blocks = knn_blocks(n, dim or 0)
    every = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    own = F.pmod(F.xxhash64("node_id"), F.lit(n_blocks)).cast("int")
    left = nodes.select(own.alias("i"), every.alias("j"), "node_id", "features")
    right = nodes.select(every.alias("i"), own.alias("j"), "node_id", "features")

    def unit(a: pa.Table, b: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if a.num_rows and b.num_rows:
            found += nearest(a.column("node_id").to_numpy(), matrix(a.column("features")), b.column("node_id").to_numpy(), matrix(b.column("features")), k, with_self)
        return pa.table({name: np.concatenate([f[i] for f in found]) for i, name in enumerate(("node_id", "other", "d"))})

    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(unit, "node_id long, other long, d double")
    place = F.row_number().over(Window.partitionBy("node_id").orderBy("d", "other"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def density(graph: Graph) -> DataFrame:
    """Local outlier factor over min(20, n - 1) neighbours, the node itself left out."""
    k = min(20, graph.n - 1)
    if k < 1:
        return graph.nodes.select("node_id", F.lit(0.0).alias("score"))
    near = keep(neighbours(graph.nodes, k, with_self=False), "lof")
    reach_k = near.groupBy(F.col("node_id").alias("other")).agg(F.max("d").alias("kd"))
    lrd = near.join(reach_k, "other").groupBy("node_id").agg((1 / (F.avg(F.greatest("kd", "d")) + 1e-10)).alias("lrd"))
    theirs = near.join(lrd.select(F.col("node_id").alias("other"), F.col("lrd").alias("o")), "other").groupBy("node_id").agg(F.avg("o").alias("o"))
    return min_max(lrd.join(theirs, "node_id").select("node_id", (F.col("o") / F.col("lrd")).alias("score")))


def attr_struct_mismatch(graph: Graph) -> DataFrame:
    """Difference of the ordinal ranks of attribute distance (mean of 10 nearest, itself among them) and distance from the neighbours' mean."""
    k = min(10, graph.n - 1)
    near = neighbours(graph.nodes, max(1, k), with_self=True).groupBy("node_id").agg(F.avg("d").alias("attr"))
    rows = graph.nodes.select("node_id").join(near, "node_id").join(graph.neighbour_distance, "node_id", "left")
    lone = rows.agg(F.avg(F.when(F.col("distance").isNull(), F.col("attr"))).alias("lone"))
    rows = rows.crossJoin(F.broadcast(lone)).select("node_id", "attr", F.coalesce("distance", "lone").alias("struct"))  # one row
    return min_max(rows.select("node_id", F.abs(ordinal_rank("attr", []) - ordinal_rank("struct", [])).cast("double").alias("score")))


CLOSED_FORM = {f.__name__: f for f in (local_affinity, homophily_violation, density, community, spectral, attr_struct_mismatch, conformity, peripheral_mismatch, attribute_inflation, clique_density)}


def run_detector(name: str, graph: Graph, **options) -> DataFrame:
    """node_id, score of a detector by its name; ValueError for an unknown one."""
    from graphsieve.operators.neural import NEURAL

    known = CLOSED_FORM | NEURAL
    if name not in known:
        raise ValueError(f"unknown detector {name!r}; known: {', '.join(sorted(known))}")
    return known[name](graph, **options)


def run_all(graph: Graph, names: list[str], **options) -> tuple[DataFrame | None, dict[str, str]]:
    """paradigm, node_id, score of several detectors, each written down; and what went wrong with the others."""
    rows, failed = None, {}
    for name in names:
        try:
            got = keep(run_detector(name, graph, **options).select(F.lit(name).alias("paradigm"), "node_id", "score"), f"score-{name}")
        except Exception as error:  # one detector's failure is a result of the run
            failed[name] = str(error)[:300]
            continue
        rows = got if rows is None else rows.unionByName(got)
    return rows, failed
