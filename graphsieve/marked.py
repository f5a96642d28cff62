"""A graph of users that share a cell, kept as flags: one bit a pair of users, in units of two blocks of users.

Such a graph has far more edges than rows it comes from. Sums over neighbours, degrees, votes and triangles are products of
the units' flags with what the blocks' users hold, so no edge is ever a row of its own; a unit's memory is the same at every size.
What a unit multiplies is a column or a few of the node table, eight bytes a node, which joins the units by broadcast; where one sum
follows another many times (``sums``), it lies on the driver in between.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphsieve.graph import Graph
from graphsieve.sources.tables import keep, meetings, shared_cells, sharing_pairs

#: Users of a block at most; blocks that fewer users are dealt into, and users that a block has then at least.
MARK_BLOCK, MARK_SPREAD, MARK_LEAST = 4096, 7, 256
#: Rows of flags that are numbers at once, and as many as stay in a core's cache.
STRIP, NARROW = 512, 32
#: Bytes of parts of sums that the driver takes as they are; more are added up by tasks first.
GATHERED = 1 << 26


def mark_blocks(n: int) -> int:
    return max(1, -(-n // MARK_BLOCK), min(MARK_SPREAD, -(-n // MARK_LEAST)))


def flags(bits: bytes, cols: int) -> np.ndarray:
    """A unit's flags as numbers 0 and 1, a row a user of the first block."""
    return np.unpackbits(np.frombuffer(bits, np.uint8).reshape(-1, -(-cols // 8)), axis=1, count=cols)


def numbers(lists) -> np.ndarray:
    return lists.values.to_numpy(zero_copy_only=False).astype(float, copy=False)


def product(met: np.ndarray, x: np.ndarray) -> np.ndarray:
    """met @ x by strips; numbers that are not finite reach only those who meet them."""
    wild = np.flatnonzero(~np.isfinite(x).all(1))
    tame = np.where(np.isfinite(x), x, 0.0) if len(wild) else x
    out = np.concatenate([met[at : at + STRIP].astype(float) @ tame for at in range(0, len(met), STRIP)]) if len(met) else np.zeros((0, x.shape[1]))
    for k in wild:
        out[met[:, k] > 0] += np.where(np.isfinite(x[k]), 0.0, x[k])
    return out


def products(bits: bytes, cols: int, x: np.ndarray, y: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
    """A unit's flags @ x, and their transpose @ y if there is one; flags become numbers once for both."""
    if not (np.isfinite(x).all() and (y is None or np.isfinite(y).all())):
        met = flags(bits, cols)
        return product(met, x), None if y is None else product(met.T, y)
    rows = np.frombuffer(bits, np.uint8).reshape(-1, -(-cols // 8))
    out, back = np.zeros((len(rows), x.shape[1])), None if y is None else np.zeros((x.shape[1], cols))
    for at in range(0, len(rows), NARROW):
        met = np.unpackbits(rows[at : at + NARROW], axis=1, count=cols).astype(float)
        out[at : at + NARROW] = met @ x
        if back is not None:
            back += y[at : at + NARROW].T @ met
    return out, None if back is None else back.T


class Marked(Graph):
    """``seen``: distinct rows user_id, cell. Users that share a cell are joined by an edge each way."""

    def __init__(self, nodes: DataFrame, seen: DataFrame, name: str = "marked"):
        for k, v in (("nodes", nodes), ("seen", seen), ("name", name)):
            object.__setattr__(self, k, v)

    @cached_property
    def undirected(self) -> DataFrame:
        return sharing_pairs(self.seen)  # distinct already

    @cached_property
    def edges(self) -> DataFrame:
        return self.symmetric

    @cached_property
    def m(self) -> int:
        return self.simple_degrees.agg(F.sum("degree")).first()[0] or 0

    @cached_property
    def blocks(self) -> int:
        return mark_blocks(self.seen.select("user_id").distinct().count())

    @cached_property
    def packed(self) -> DataFrame:
        return shared_cells(self.seen, self.blocks)

    @cached_property
    def members(self) -> DataFrame:
        """block, place, node_id of all users that share or might share a cell."""
        return keep(self.packed.select("block", F.posexplode("ids").alias("place", "node_id")), "members")

    @cached_property
    def units(self) -> DataFrame:
        """i, j, cols, bits: the flags of two blocks i <= j, rows and columns by id, without loops; written once."""

        def pack(i: int, j: int, p: np.ndarray, q: np.ndarray, met: np.ndarray) -> pa.Table:
            if i == j:
                np.fill_diagonal(met, False)
            some = met.any()
            rows = {"i": [i], "j": [j], "cols": [len(q)], "bits": [np.packbits(met, axis=1).tobytes()]} if some else {"i": [], "j": [], "cols": [], "bits": []}
            return pa.table(rows, pa.schema([("i", pa.int32()), ("j", pa.int32()), ("cols", pa.int32()), ("bits", pa.binary())]))

        return keep(meetings(self.packed, self.blocks, pack, "i int, j int, cols int, bits binary"), "units")

    def columns(self, values: DataFrame, vector: str, width: int) -> DataFrame:
        """block, x: ``vector`` (as many numbers a node as ``width``) of each block's users in one array, users by id; null and missing ones are 0."""
        rows = self.members.join(values.select("node_id", F.transform(vector, lambda v: F.coalesce(v.cast("double"), F.lit(0.0))).alias("v")), "node_id", "left")
        none = F.array(*[F.lit(0.0)] * width)
        lists = rows.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("v", none).alias("v")))).alias("all"))  # a block's users
        return lists.select("block", F.flatten(F.transform("all", lambda e: e["v"])).alias("x"))

    def beside(self, x: DataFrame) -> DataFrame:
        """The units with what their blocks hold: x for the columns, y for the rows."""
        rows = self.units.join(F.broadcast(x.select(F.col("block").alias("j"), "x")), "j")
        return rows.join(F.broadcast(x.select(F.col("block").alias("i"), F.col("x").alias("y"))), "i").select("i", "j", "cols", "bits", "x", "y")

    def parts(self, x: DataFrame, width: int, count: bool) -> DataFrame:
        """block, total: each task's sums of ``x`` (block, x) over the neighbours of the block's users, with their number behind each if asked for."""

        def times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}

            def out() -> Iterator[pa.RecordBatch]:
                for block, total in sums.items():
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([total.ravel()], pa.list_(pa.float64()))], ["block", "total"])
                sums.clear()

            def given(v) -> np.ndarray:
                rows = numbers(v).reshape(-1, width)
                return np.concatenate([rows, np.ones((len(rows), 1))], 1) if count else rows

            for batch in batches:
                for at in range(batch.num_rows):
                    i, j, cols, bits, x, y = (batch.column(c)[at] for c in range(6))
                    found = products(bits.as_buffer(), cols.as_py(), given(x), None if i == j else given(y))
                    for k, v in zip((i.as_py(), j.as_py()), found, strict=True):
                        if v is not None:
                            sums[k] = sums[k] + v if k in sums else v
                    if sum(v.nbytes for v in sums.values()) > 1 << 26:
                        yield from out()
            yield from out()

        return self.beside(x).mapInArrow(times, "block int, total array<double>")

    @cached_property
    def starts(self) -> np.ndarray:
        """Where each block's members begin among all, by block and place; their number at the end."""
        sizes = np.zeros(self.blocks + 1, np.int64)
        for r in self.packed.select("block", F.size("ids").alias("n")).collect():
            sizes[r["block"] + 1] = r["n"]
        return np.cumsum(sizes)

    @cached_property
    def even(self) -> DataFrame:
        """The units in tasks of as many each, held for many sums: in memory where there is room, else on disk."""
        units = self.units.select("i", "j", "cols", "bits")
        n, tasks = units.count(), units.sparkSession.sparkContext.defaultParallelism
        return units.repartition(max(1, min(n, tasks), -(-n // 8))).persist(StorageLevel.MEMORY_AND_DISK)

    def release(self) -> None:
        if "even" in self.__dict__:
            self.__dict__.pop("even").unpersist()

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Over neighbours, of ``x``, a row a member (by block and place), on the driver; one job, to which x goes by broadcast."""
        starts, width, context = self.starts, x.shape[1], self.units.sparkSession.sparkContext
        given = context.broadcast(np.ascontiguousarray(x, float))

        def times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x, totals = given.value, {}
            own = lambda k: x[starts[k] : starts[k + 1]]
            out = lambda: [pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.ascontiguousarray(v).tobytes()], pa.binary())], ["block", "total"]) for k, v in totals.items()]
            for batch in batches:
                for at in range(batch.num_rows):
                    i, j, cols, bits = (batch.column(c)[at] for c in range(4))
                    i, j = i.as_py(), j.as_py()
                    for k, v in zip((i, j), products(bits.as_buffer(), cols.as_py(), own(j), None if i == j else own(i)), strict=True):
                        if v is not None:
                            totals[k] = totals[k] + v if k in totals else v
                    if sum(v.nbytes for v in totals.values()) > GATHERED:
                        yield from out()
                        totals.clear()
            yield from out()

        def added(parts: pa.Table) -> pa.Table:
            return pa.table({"block": parts.column("block")[:1], "total": pa.array([sum(np.frombuffer(v.as_buffer()) for v in parts.column("total")).tobytes()])})

        parts = self.even.mapInArrow(times, "block int, total binary")
        if x.nbytes * context.defaultParallelism > GATHERED:
            parts = parts.groupBy("block").applyInArrow(added, "block int, total binary")
        found, out = parts.toArrow(), np.zeros(x.shape)
        for k, v in zip(found.column("block").to_pylist(), found.column("total"), strict=True):
            out[starts[k] : starts[k + 1]] += np.frombuffer(v.as_buffer()).reshape(-1, width)
        given.destroy()
        return out

    def near_sum(self, values: DataFrame, vector: str, width: int) -> DataFrame:
        """node_id, total, n: the sum of ``vector`` over a node's neighbours, and their number; only nodes with neighbours."""

        def joined(ids: pa.Table, parts: pa.Table) -> pa.Table:
            if not (ids.num_rows and parts.num_rows):
                return pa.table({"node_id": pa.array([], pa.int64()), "total": pa.array([], pa.list_(pa.float64())), "n": pa.array([], pa.int64())})
            nodes = ids.column("ids").combine_chunks().flatten().to_numpy()
            total = sum(numbers(part) for part in parts.column("total")).reshape(len(nodes), width + 1)
            total, nodes = total[total[:, -1] > 0], nodes[total[:, -1] > 0]
            return pa.table({"node_id": nodes, "total": pa.array(list(total[:, :-1]), pa.list_(pa.float64())), "n": total[:, -1].astype(np.int64)})

        parts = self.parts(self.columns(values, vector, width), width, True)
        return self.packed.select("block", "ids").groupBy("block").cogroup(parts.groupBy("block")).applyInArrow(joined, "node_id long, total array<double>, n long")

    def neighbour_mean(self, values: DataFrame, vector: str, dim: int) -> DataFrame:
        return self.near_sum(values, vector, dim).select("node_id", F.transform("total", lambda t: t / F.col("n")).alias("mean"))

    def neighbour_mean_scalar(self, values: DataFrame, value: str) -> DataFrame:
        found = self.near_sum(values.select("node_id", F.array(value).alias("v")), "v", 1)
        return found.select("node_id", (F.col("total")[0] / F.col("n")).alias("mean"))

    @cached_property
    def simple_degrees(self) -> DataFrame:
        out = self.near_sum(self.nodes.select("node_id", F.array(F.lit(0.0)).alias("v")), "v", 1)
        return keep(self.nodes.select("node_id").join(out, "node_id", "left").select("node_id", F.coalesce("n", F.lit(0)).alias("degree")), "degrees")

    @property
    def degrees(self) -> DataFrame:
        return self.simple_degrees

    @cached_property
    def vectors(self) -> DataFrame:
        """A row a block; nodes that share nothing have rows of their own."""
        found = self.members.join(self.simple_degrees, "node_id").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", "node_id", "degree"))).alias("all"))  # a block's users
        blocks = found.select(F.col("block").cast("long").alias("key"), F.transform("all", lambda e: e["node_id"]).alias("ids"), F.transform("all", lambda e: e["degree"].cast("double")).alias("degree"))
        lone = self.nodes.select("node_id").join(self.members, "node_id", "left_anti")
        return keep(blocks.unionByName(lone.select((-1 - F.monotonically_increasing_id()).alias("key"), F.array("node_id").alias("ids"), F.array(F.lit(0.0)).alias("degree"))), "vectors")

    def balanced_sum(self, values: DataFrame, value: str) -> DataFrame:
        blocks = values.where("key >= 0").select(F.col("key").cast("int").alias("block"), F.col(value).alias("x"))

        def summed(parts: pa.Table) -> pa.Table:
            return pa.table({"key": parts.column("block")[:1].cast(pa.int64()), "total": pa.array([sum(numbers(part) for part in parts.column("total"))])})

        return self.parts(blocks, 1, False).groupBy("block").applyInArrow(summed, "key long, total array<double>")

    def placed(self, rows: DataFrame) -> DataFrame:
        """``rows`` (block, place) with their node_id."""
        return rows.join(self.members, ["block", "place"])

    def least_neighbours(self) -> DataFrame:
        def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(batch.num_rows):
                    i, j, cols, bits = (batch.column(c)[at] for c in range(4))
                    met = flags(bits.as_buffer(), cols.as_py())
                    for block, other, own in ((i, j, met), *(() if i == j else ((j, i, met.T),))):
                        place = np.flatnonzero(own.any(1))
                        first = own[place].argmax(1) if len(place) else place  # ids ascend within a block
                        full = lambda v: np.full(len(place), v.as_py(), np.int32)  # noqa: B023, E731
                        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (full(block), place.astype(np.int32), full(other), first.astype(np.int32))], ["block", "place", "other", "at"])

        found = self.units.select("i", "j", "cols", "bits").mapInArrow(least, "block int, place int, other int, at int")
        ids = found.join(self.members.select(F.col("block").alias("other"), F.col("place").alias("at"), F.col("node_id").alias("id")), ["other", "at"])
        return self.placed(ids.groupBy("block", "place").agg(F.min("id").alias("least"))).select("node_id", "least")

    def votes(self, labels: DataFrame) -> DataFrame:
        """Counted within units by label, so a row is a node, a block and a label among its neighbours there."""
        rows = self.members.join(labels, "node_id").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", "community"))).alias("all"))  # a block's users
        x = rows.select("block", F.transform("all", lambda e: e["community"]).alias("x"))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(batch.num_rows):
                    i, j, cols, bits, x, y = (batch.column(c)[at] for c in range(6))
                    met = flags(bits.as_buffer(), cols.as_py())
                    for block, own, given in ((i, met, x), *(() if i == j else ((j, met.T, y),))):
                        label = given.values.to_numpy()
                        order = np.argsort(label, kind="stable")
                        each, first = np.unique(label[order], return_index=True)
                        for top in range(0, len(own), STRIP):
                            n = np.add.reduceat(own[top : top + STRIP][:, order], first, axis=1, dtype=np.int64)
                            place, which = np.nonzero(n)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), block.as_py(), np.int32)), pa.array((place + top).astype(np.int32)), pa.array(each[which]), pa.array(n[place, which])], ["block", "place", "community", "n"])

        found = self.beside(x).mapInArrow(count, "block int, place int, community long, n long")
        return self.placed(found.groupBy("block", "place", "community").agg(F.sum("n").alias("n"))).select("node_id", "community", "n")

    @cached_property
    def triangles(self) -> DataFrame:
        """By triples of blocks i <= j <= k, whose units of flags meet: products of matrices, masked by the third."""
        last, tasks = F.lit(self.blocks - 1), self.blocks * (self.blocks + 1) * (self.blocks + 2) // 6
        u, a, b = self.units, F.col("i"), F.col("j")
        role = lambda name, *key: u.select(*(k.alias(c) for k, c in zip(key, "hik", strict=True)), F.lit(name).alias("role"), "cols", "bits")
        dealt = role(0, a, b, F.explode(F.sequence("j", last))).union(role(1, F.explode(F.sequence(F.lit(0), "i")), a, b)).union(role(2, a, F.explode(F.sequence("i", "j")), b))

        def count(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
            h, i, k = (v.as_py() for v in key)
            met = {rows.column("role")[r].as_py(): flags(rows.column("bits")[r].as_buffer(), rows.column("cols")[r].as_py()).astype(np.float32) for r in range(rows.num_rows)}
            out: list[tuple[int, np.ndarray]] = []
            if len(met) == 3:
                x, y, z = met[0], met[1], met[2]

                def closed(left: np.ndarray, right: np.ndarray, over: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                    row, col = np.zeros(len(over)), np.zeros(over.shape[1])
                    for top in range(0, len(over), STRIP):
                        p = (left[top : top + STRIP] @ right) * over[top : top + STRIP]
                        row[top : top + STRIP] = p.sum(1, dtype=float)
                        col += p.sum(0, dtype=float)
                    return row, col

                row, col = closed(x, y, z)
                # a triangle with two corners in one block is met from both of them
                if h == i == k:
                    out = [(h, row / 2)]
                elif h == i:
                    out = [(h, row), (k, col / 2)]
                elif i == k:
                    out = [(h, row / 2), (k, col)]
                else:
                    out = [(h, row), (k, col), (i, closed(x.T, z, y)[0])]
            return pa.table({"block": pa.array([o[0] for o in out], pa.int32()), "total": pa.array([o[1] for o in out], pa.list_(pa.float64()))})

        parts = dealt.repartition(tasks if tasks < 4096 else 4096, "h", "i", "k").groupBy("h", "i", "k").applyInArrow(count, "block int, total array<double>")
        corners = self.placed(parts.select("block", F.posexplode("total").alias("place", "t")).groupBy("block", "place").agg(F.sum("t").cast("long").alias("triangles"))).select("node_id", "triangles")
        out = self.simple_degrees.join(corners, "node_id", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))
        d = F.col("degree")
        return out.withColumn("clustering", F.when(d < 2, F.lit(0.0)).otherwise(2 * F.col("triangles") / (d * (d - 1))))
