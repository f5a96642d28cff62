"""Sources and sinks: Parquet tables, cached scores, logs, and graphs derived from relational tables."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or one temporary folder for a local session that has none, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        application = spark.sparkContext.applicationId
        found = _own_folders.setdefault(application, "") or tempfile.mkdtemp(prefix="graphsieve-")
        _own_folders[application] = found
    return found.rstrip("/")


def keep(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder, gone at the session's end; ``by``: a column with a folder for each value."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    df.write.parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def load_graph(spark: SparkSession, nodes_path: str, edges_path: str):
    """A graph from two Parquet tables."""
    from graphsieve.graph import Graph

    return Graph(spark.read.parquet(nodes_path), spark.read.parquet(edges_path))


def adapt(nodes: DataFrame, edges: DataFrame, name: str = "adapted"):
    """A graph with symmetric, distinct, loop-free edges and labels 0 or 1."""
    from graphsieve.graph import Graph

    flat = Graph(nodes, edges).symmetric
    return Graph(nodes.withColumn("label", (F.coalesce("label", F.lit(0)) > 0).cast("int")) if "label" in nodes.columns else nodes, flat, name)


def write_scores(scores: DataFrame, path: str, dataset: str, seed: int, replace: bool = True) -> None:
    """paradigm, node_id, score as partitions by data set, seed and paradigm.

    What is there of these paradigms is replaced (``scores`` must not read it then); without ``replace`` it stays, and only paradigms that are missing are added.
    """
    rows = scores.withColumn("dataset", F.lit(dataset)).withColumn("seed", F.lit(seed))
    if replace:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "seed", "paradigm").parquet(path)
        return
    try:
        there = scores.sparkSession.read.parquet(path).select("dataset", "seed", "paradigm").distinct()
        rows = rows.join(F.broadcast(there), ["dataset", "seed", "paradigm"], "left_anti")  # a row a partition folder
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    rows.write.mode("append").partitionBy("dataset", "seed", "paradigm").parquet(path)


def read_scores(spark: SparkSession, path: str, dataset: str, seed: int) -> DataFrame:
    return spark.read.parquet(path).where((F.col("dataset") == dataset) & (F.col("seed") == seed)).select("paradigm", "node_id", "score")


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    """Log rows, or none where there is no log yet."""
    try:
        return spark.read.schema(schema).json(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def to_markdown(df: DataFrame, digits: int = 4) -> str:
    """A report table of all rows; for small results."""
    rows = df.collect()
    cell = lambda v: f"{v:.{digits}f}" if isinstance(v, float) else json.dumps(v, default=str) if isinstance(v, (list, dict)) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows])


def to_latex(df: DataFrame, digits: int = 4) -> str:
    """The rows of a LaTeX table body."""
    cell = lambda v: f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("_", r"\_")
    return "\n".join(" & ".join(cell(v) for v in r) + r" \\" for r in df.collect())


#: Order lines in one task of the part graph, whose pairs are some twice as many.
LINES = 1 << 18


def part_graph(spark: SparkSession, folder: str, least_orders: int = 1):
    """Parts that share orders: features from parts and their order lines, community by brand.

    The pairs come from each order's distinct parts. Edges are stored once, lower id first; Graph's views mirror them.
    Lines and pairs are dealt to as many tasks as there are lines for, so a task's memory stays the same whatever the table's size.
    """
    from graphsieve.graph import Graph

    lines, part = table(spark, folder, "lineitem"), table(spark, folder, "part")
    means = lines.groupBy("l_partkey").agg(F.avg("l_quantity").alias("q"), F.avg("l_extendedprice").alias("e"), F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"))
    joined = part.join(means, part["p_partkey"] == means["l_partkey"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).cast("double")
    brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("long")
    nodes = joined.select(F.col("p_partkey").alias("node_id"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice").cast("double"), zero("q"), zero("e"), zero("d"), zero("t")).alias("features"), brand.alias("community"))
    tasks = max(spark.sparkContext.defaultParallelism, 1 + lines.count() // LINES)
    own = lines.select("l_orderkey", "l_partkey").repartition(tasks, "l_orderkey").distinct()
    pairs = own.select("l_orderkey", F.col("l_partkey").alias("a")).join(own.select("l_orderkey", F.col("l_partkey").alias("b")), "l_orderkey").where("a < b").select("a", "b").repartition(tasks, "a", "b")
    if least_orders > 1:
        pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least_orders)
    pairs = pairs.select("a", "b").distinct()
    edges = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(pairs.select("b", "a"))
    return Graph(nodes, edges, f"part{least_orders}")


#: Users of each side in one unit of the pairs that share a cell.
SHARE_BLOCK = 2048


def shared_cells(seen: DataFrame, blocks: int) -> DataFrame:
    """block, ids, at, cells, sizes: the distinct rows (user_id, cell: longs) of each block of users in arrays, users by id, rows by cell."""
    dealt = seen.select(F.pmod(F.xxhash64("user_id"), F.lit(blocks)).cast("int").alias("block"), "user_id", "cell")

    def pack(rows: pa.Table) -> pa.Table:
        ids, at = np.unique(rows.column("user_id").to_numpy(), return_inverse=True)
        cells = rows.column("cell").to_numpy()
        each, sizes = np.unique(cells, return_counts=True)
        places = at[np.argsort(cells, kind="stable")].astype(np.int16)  # a block has far fewer users
        return pa.table({"block": rows.column("block")[:1], "ids": pa.array([ids]), "at": pa.array([places]), "cells": pa.array([each]), "sizes": pa.array([sizes.astype(np.int32)])})

    return keep(dealt.groupBy("block").applyInArrow(pack, "block int, ids array<long>, at array<short>, cells array<long>, sizes array<int>"), "shared-cells")


def meetings(packed: DataFrame, blocks: int, result, schema: str) -> DataFrame:
    """``result`` (i, j, ids of both, flags of who meets whom) of each unit of two blocks i <= j that has a row on both sides; None for none."""
    last = F.lit(blocks - 1)
    left = packed.select(F.col("block").alias("i"), F.explode(F.sequence("block", last)).alias("j"), *(F.col(c).alias(c) for c in ("ids", "at", "cells", "sizes")))
    right = packed.select(F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"), *(F.col(c).alias(c) for c in ("ids", "at", "cells", "sizes")))

    def mark(a: pa.Table, b: pa.Table) -> pa.Table:
        if not (a.num_rows and b.num_rows):
            return result(0, 0, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 0), bool))
        (p, x, u, m), (q, y, v, n) = (tuple(t.column(c).combine_chunks().flatten().to_numpy() for c in ("ids", "at", "cells", "sizes")) for t in (a, b))
        u, v = np.repeat(u, m), np.repeat(v, n)
        met = np.zeros((len(p), len(q)), bool)
        # each row of the left side meets the right side's run of its cell
        first, end = np.searchsorted(v, u, "left"), np.searchsorted(v, u, "right")
        total, at = np.cumsum(end - first), 0
        while at < len(u):  # some 2^22 meetings at once
            stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 22), "right")))
            n = (end - first)[at:stop]
            row = np.repeat(np.arange(at, stop), n)
            met[x[row], y[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]]] = True
            at = stop
        return result(a.column("i")[0].as_py(), a.column("j")[0].as_py(), p, q, met)

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(mark, schema)


def sharing_pairs(seen: DataFrame, block: int = SHARE_BLOCK) -> DataFrame:
    """a, b (a < b): distinct pairs of users that share a cell, from distinct rows (user_id, cell: longs).

    A block's rows are packed into one row of arrays; a unit marks the pairs of two blocks in a table of flags, so nothing is shuffled by
    pair, and a pair that shares many cells is made once.
    """
    blocks = max(1, -(-seen.select("user_id").distinct().count() // block))

    def pairs(i: int, j: int, p: np.ndarray, q: np.ndarray, met: np.ndarray) -> pa.Table:
        row, col = np.nonzero(met & (p[:, None] < q) if i == j else met)
        return pa.table({"a": np.minimum(p[row], q[col]), "b": np.maximum(p[row], q[col])})

    return meetings(shared_cells(seen, blocks), blocks, pairs, "a long, b long")


def user_graph(spark: SparkSession, folder: str):
    """Users who did the same kind of thing in the same ten minutes; features from their events."""
    from graphsieve.marked import Marked

    events = table(spark, folder, "events")
    kinds = [r[0] for r in events.select("event_type").distinct().orderBy("event_type").collect()]  # a feature for each, so few
    counts = [F.sum(F.when(F.col("event_type") == k, 1.0).otherwise(0.0)).alias(f"k{i}") for i, k in enumerate(kinds)]
    nodes = events.groupBy(F.col("user_id").alias("node_id")).agg(*counts, F.avg("value").alias("mean"), F.max("value").alias("most"))
    nodes = nodes.select("node_id", F.array(*[f"k{i}" for i in range(len(kinds))], F.coalesce("mean", F.lit(0.0)), F.coalesce("most", F.lit(0.0))).alias("features"))
    # epoch seconds cut to ten minutes; a cell is a slot and a kind
    slot, known = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 600), [k for k in kinds if k is not None]
    cell = slot * len(known) + F.array_position(F.array(*map(F.lit, known)), F.col("event_type")) if known else F.lit(None).cast("long")
    seen = events.select(F.col("user_id").cast("long").alias("user_id"), cell.alias("cell")).where("user_id is not null and cell is not null").distinct()
    return Marked(nodes, seen, "users")


def embedding_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """node_id, features, label of the embeddings table."""
    rows = table(spark, folder, "embeddings").where("embedding is not null")
    return rows.select(F.col("vec_id").alias("node_id"), F.col("embedding").cast("array<double>").alias("features"), "label")
