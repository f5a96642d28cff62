"""Approximate nearest neighbours by a permutation index.

A vector is represented by its PREFIX nearest of PIVOTS pivots in order of nearness. In a shard, each pivot's
inverted file gives the vectors' places of that pivot in their order (as every file lists a good part of the shard, it is a row with a
place for each vector, PREFIX for those that do not have the pivot). A query walks the files
of its own pivots and gets every vector's footrule distance (how far apart the places are, summed; a
missing pivot counts as last); the nearest SHARE of the shard by that distance are compared exactly.

Pivots are drawn from all vectors by a hash, so they are a bounded sample and 64 kB or so. Every vector is
indexed, once: vectors lie in shards of about SHARD, and each shard is built in one place, past which the queries stream; it
returns one row a query. No shard is left out for a query: on vectors without structure the nearest ones lie anywhere, and fewer
candidates lose recall (README). Equal vectors are one entry, which stands
for its least ids (one more than are asked for), so copies never pile up; equal queries are searched once.

Vectors that are null, zero, of another length than the first pivot, or hold null or non-finite components take
no part, neither as queries nor as candidates. Null ids take no part. An empty table gives an empty result.
Scores are cosines in double precision, of vectors of any magnitude; ties go to the smaller id. Rows that repeat an id and vector count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphsieve.llm.common import written

PIVOTS, PREFIX, SHARE, LEAST = 128, 64, 0.1, 300
SHARD = 16384


def scaled(vectors: np.ndarray) -> np.ndarray:
    """The vectors by powers of two, which changes no cosine, so that squares neither overflow nor vanish."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=-1, keepdims=True))[1])


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Row by row, so that a pair's value doesn't depend on its neighbours in memory."""
    return np.einsum("ij,j->i", vectors, query) / (np.sqrt(np.einsum("ij,ij->i", vectors, vectors)) * np.sqrt(np.einsum("j,j->", query, query)))


def orders(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first."""
    near = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ (pivots / np.linalg.norm(pivots, axis=1, keepdims=True)).T
    return np.argsort(-near, axis=1, kind="stable")[:, :prefix]


class Index:
    """Inverted files of one shard."""

    def __init__(self, vectors: np.ndarray, pivots: np.ndarray, prefix: int = PREFIX):
        self.vectors, self.pivots, self.prefix = scaled(vectors), scaled(pivots), min(prefix, len(pivots))
        order = orders(self.vectors, self.pivots, self.prefix)
        #: a file for each pivot: its place in each vector's order
        self.files = np.full((len(pivots), len(vectors)), self.prefix, np.int16)
        self.files[order, np.arange(len(vectors))[:, None]] = np.arange(self.prefix, dtype=np.int16)

    def footrules(self, query_order: np.ndarray) -> np.ndarray:
        """The distance of each vector's order from the query's."""
        m = self.prefix
        # a query's pivot at place i, which the vector has at place p (m: not at all), adds |p - i|; the vector's other pivots add what they lack to m
        out = np.zeros(self.files.shape[1], np.int32)
        for place, pivot in enumerate(query_order.tolist()):
            file = self.files[pivot]
            out += np.abs(file - np.int16(place)) + file
        # sum over the vector's own pivots of m - p is m (m + 1) / 2, of which the shared ones are taken off again
        return out + (m * (m + 1) // 2 - m * m)

    def search(self, queries: np.ndarray, k: int, share: float = SHARE, least: int = LEAST) -> list[tuple[np.ndarray, np.ndarray]]:
        """Rows and cosines of the ``k`` nearest among the candidates of each query; all that tie with the last one stay."""
        n, found = min(len(self.vectors), max(least, k, int(np.ceil(share * len(self.vectors))))), []
        queries = scaled(queries)
        for query, order in zip(queries, orders(queries, self.pivots, self.prefix), strict=True):
            distance = self.footrules(order)
            some = np.arange(len(distance)) if n == len(distance) else np.argpartition(distance, n - 1)[:n]
            score = cosines(self.vectors[some], query)
            if k < n:
                kept = score >= np.partition(score, n - k)[n - k]
                some, score = some[kept], score[kept]
            found.append((some, score))
        return found


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and ``v`` (doubles) of the rows that take part, by their own doing."""
    chosen = rows.select(rows[id_col].cast("long").alias("vec_id"), rows[vector_col].cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return chosen.where(fine)


def search(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row for which ``is_query`` (a Column over vec_id) holds."""
    spark = rows.sparkSession
    good = usable(rows, id_col, vector_col)
    least = Window.partitionBy("v").orderBy("vec_id")
    # a window by the vector, whose first k + 1 rows Spark also takes before the shuffle
    members = good.distinct().withColumn("n", F.row_number().over(least)).where(F.col("n") <= k + 1)
    pivots = [r.v for r in good.select("v", F.xxhash64("v").alias("h")).distinct().orderBy("h").limit(PIVOTS).collect()]
    length = len(pivots[0]) if pivots else 0
    matrix = np.array([p for p in pivots if len(p) == length], float).reshape(-1, max(1, length))
    entries = written(members.where(F.size("v") == length).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "ann-entries")
    asked = written(good.where((F.size("v") == length) & is_query).select("vec_id", F.col("v")).distinct(), "ann-queries")
    searched = asked.select("v").distinct()
    n_shards = max(1, -(-entries.count() // SHARD))
    held = entries.select(F.pmod(F.xxhash64("v"), F.lit(n_shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "v", "ids")
    wanted = searched.select(F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"), F.lit(True).alias("asks"), "v", F.lit(None).cast("array<bigint>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, vectors, ids, index = None, [], [], None
        for batch in batches:
            shard, asks = batch.column("shard").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            for part in np.split(np.arange(len(shard)), np.flatnonzero((np.diff(shard) != 0) | (asks[1:] != asks[:-1])) + 1):
                if not len(part):
                    continue
                own = batch.slice(part[0], len(part))
                v = own.column("v").flatten().to_numpy().reshape(len(part), length)
                if shard[part[0]] != at:
                    at, vectors, ids, index = shard[part[0]], [], [], None
                if not asks[part[0]]:
                    vectors.append(v)
                    ids += own.column("ids").to_pylist()
                elif vectors:
                    if index is None:
                        index, vectors = Index(np.concatenate(vectors), matrix), [None]
                    best = []
                    for some, score in index.search(v, k + 1, share):
                        best.append(sorted((-s, i) for row, s in zip(some.tolist(), score.tolist(), strict=True) for i in ids[row])[: k + 1])
                    yield pa.RecordBatch.from_arrays([own.column("v"), pa.array([[i for _, i in x] for x in best], pa.list_(pa.int64())), pa.array([[-s for s, _ in x] for x in best], pa.list_(pa.float64()))], ["v", "near_ids", "scores"])

    rows = held.union(wanted).repartition("shard").sortWithinPartitions("shard", "asks")
    found = rows.mapInArrow(run, "v array<double>, near_ids array<long>, scores array<double>")
    found = found.select("v", F.explode(F.arrays_zip("near_ids", "scores")).alias("x")).select("v", F.col("x.near_ids").alias("vec_id"), F.col("x.scores").alias("score"))
    near = Window.partitionBy("v").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("n", F.row_number().over(near)).where(F.col("n") <= k + 1).select("v", "vec_id", "score")
    pairs = asked.select(F.col("vec_id").alias("query_id"), "v").join(best, "v").where("query_id <> vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
