"""The attributed graph: node and edge tables and what follows from them.

``nodes``: node_id long, features array<double>, optional label int and community long. ``edges``: src, dst long;
directed, repeated entries are multiplicity. Neighbour means follow the direction of edges (src to dst);
triangles, clustering and communities use the simple undirected view. Ids need not be dense.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphsieve.functions.stats import distance, mean_vector, unit
from graphsieve.sources.tables import keep


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    name: str = "graph"

    @cached_property
    def dim(self) -> int:
        """The features' length, by the node with the least id; 0 without nodes."""
        row = self.nodes.select(F.size("features").alias("d")).first()
        return row.d if row else 0

    @cached_property
    def n(self) -> int:
        return self.nodes.count()

    @cached_property
    def m(self) -> int:
        """Directed edge entries."""
        return self.edges.count()

    @cached_property
    def weighted(self) -> DataFrame:
        """src, dst, w: repeated entries summed."""
        return self.edges.groupBy("src", "dst").agg(F.count("*").alias("w"))

    @cached_property
    def undirected(self) -> DataFrame:
        """a < b: distinct pairs without loops."""
        return self.edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()

    @cached_property
    def symmetric(self) -> DataFrame:
        """src, dst: each undirected pair both ways."""
        return self.undirected.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(self.undirected.select("b", "a"))

    @cached_property
    def degrees(self) -> DataFrame:
        """node_id, degree: edge entries that leave each node, 0 for isolated ones."""
        out = self.edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("degree"))
        return self.nodes.select("node_id").join(out, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).alias("degree"))

    @cached_property
    def simple_degrees(self) -> DataFrame:
        """node_id, degree in the simple undirected view."""
        out = self.symmetric.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("degree"))
        return self.nodes.select("node_id").join(out, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).alias("degree"))

    def neighbour_mean(self, values: DataFrame, vector: str, dim: int) -> DataFrame:
        """node_id, mean: of ``vector`` over the nodes an edge leads to, by multiplicity; nodes without edges are left out."""
        joined = self.weighted.join(values.select(F.col("node_id").alias("dst"), vector), "dst")
        return joined.groupBy(F.col("src").alias("node_id")).agg(mean_vector(vector, dim, "w").alias("mean"))

    def neighbour_mean_scalar(self, values: DataFrame, value: str) -> DataFrame:
        """node_id, mean of a number over out-neighbours; nodes without edges are left out."""
        joined = self.weighted.join(values.select(F.col("node_id").alias("dst"), value), "dst")
        return joined.groupBy(F.col("src").alias("node_id")).agg((F.sum(F.col(value) * F.col("w")) / F.sum("w")).alias("mean"))

    @cached_property
    def balanced(self) -> DataFrame:
        """src, dst, w: the mean of both directions' entries, loops left out; written down."""
        half = self.edges.where("src <> dst").groupBy("src", "dst").agg((F.count("*") / 2).alias("w"))
        return keep(half.union(half.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w")), "balanced")

    @cached_property
    def vectors(self) -> DataFrame:
        """key, ids, degree: the rows of lists that vectors over the nodes are kept in, here a node each, and sums of the balanced weights."""
        sums = self.balanced.groupBy(F.col("src").alias("node_id")).agg(F.sum("w").alias("d"))
        return self.nodes.select("node_id").join(sums, "node_id", "left").select(F.col("node_id").alias("key"), F.array("node_id").alias("ids"), F.array(F.coalesce("d", F.lit(0.0))).alias("degree"))

    def balanced_sum(self, values: DataFrame, value: str) -> DataFrame:
        """key, total: a vector's sums over neighbours, by balanced weights; rows without edges are left out."""
        joined = self.balanced.join(values.select(F.col("key").alias("dst"), F.col(value)[0].alias("v")), "dst")
        return joined.groupBy(F.col("src").alias("key")).agg(F.array(F.sum(F.col("w") * F.col("v"))).alias("total"))

    @cached_property
    def triangles(self) -> DataFrame:
        """node_id, triangles, degree, clustering: in the simple undirected view.

        Edges point from the lower to the higher (degree, id), so a hub leads to few others, and the number of
        wedges stays below m to the power 1.5 whatever the hubs.
        """
        flat = keep(self.undirected, "pairs")
        ends = flat.select(F.explode(F.array("a", "b")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("degree")).join(self.nodes.select("node_id"), "node_id", "left_semi")
        pairs = flat.join(ends.select(F.col("node_id").alias("a"), F.col("degree").alias("da")), "a").join(ends.select(F.col("node_id").alias("b"), F.col("degree").alias("db")), "b")
        up = F.struct("da", "a") < F.struct("db", "b")
        rising = keep(pairs.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("v")), "rising")
        wedges = rising.select("u", F.col("v").alias("x")).join(rising.select("u", F.col("v").alias("y")), "u").where("x < y")
        closed = wedges.join(flat, (F.col("x") == F.col("a")) & (F.col("y") == F.col("b")))
        deg = self.nodes.select("node_id").join(ends, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).alias("degree"))
        corners = closed.select(F.explode(F.array("u", "x", "y")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("triangles"))
        out = deg.join(corners, "node_id", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))
        d = F.col("degree")
        return out.withColumn("clustering", F.when(d < 2, F.lit(0.0)).otherwise(2 * F.col("triangles") / (d * (d - 1))))

    def least_neighbours(self) -> DataFrame:
        """node_id, least: the smallest id among a node's neighbours; without neighbours left out."""
        return self.symmetric.groupBy(F.col("src").alias("node_id")).agg(F.min("dst").alias("least"))

    def votes(self, labels: DataFrame) -> DataFrame:
        """node_id, community, n: how many neighbours have each label."""
        return self.symmetric.join(labels.withColumnRenamed("node_id", "dst"), "dst").groupBy(F.col("src").alias("node_id"), "community").agg(F.count("*").alias("n"))

    @cached_property
    def communities(self) -> DataFrame:
        """node_id, community: the given column, or else a deterministic partition by label propagation."""
        if "community" in self.nodes.columns:
            return self.nodes.select("node_id", F.col("community").cast("long").alias("community"))
        return label_propagation(self)

    @cached_property
    def community_edges(self) -> DataFrame:
        """src, dst, cs, cd: edges with both ends' communities."""
        c = self.communities
        return self.edges.join(c.select(F.col("node_id").alias("src"), F.col("community").alias("cs")), "src").join(c.select(F.col("node_id").alias("dst"), F.col("community").alias("cd")), "dst").select("src", "dst", "cs", "cd")

    def induced(self, ids: DataFrame) -> DataFrame:
        """The edges with both ends in ``ids`` (node_id)."""
        return self.edges.join(ids.select(F.col("node_id").alias("src")).distinct(), "src", "left_semi").join(ids.select(F.col("node_id").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")

    def two_hop(self) -> DataFrame:
        """src, dst: distinct pairs over one node between, without loops."""
        first, second = self.symmetric.select("src", F.col("dst").alias("mid")), self.symmetric.select(F.col("src").alias("mid"), "dst")
        return first.join(second, "mid").where("src <> dst").select("src", "dst").distinct()

    @cached_property
    def neighbour_distance(self) -> DataFrame:
        """node_id, distance from the neighbours' mean; without neighbours left out."""
        mean = self.neighbour_mean(self.nodes, "features", self.dim)
        return self.nodes.select("node_id", "features").join(mean, "node_id").select("node_id", distance("features", "mean").alias("distance"))

    @cached_property
    def units(self) -> DataFrame:
        """node_id, u: features over their length."""
        return self.nodes.select("node_id", unit("features").alias("u"))


class Derived(Graph):
    """A graph made from other tables: each side is written down when it is first asked for, the edges by their source."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, name: str = "derived"):
        for k, v in (("raw_nodes", nodes), ("raw_edges", edges), ("name", name)):
            object.__setattr__(self, k, v)

    @cached_property
    def nodes(self) -> DataFrame:
        return keep(self.raw_nodes, "nodes")

    @cached_property
    def edges(self) -> DataFrame:
        return keep(self.raw_edges, "edges")


def label_propagation(graph: Graph, rounds: int = 10) -> DataFrame:
    """node_id, community: each round a node takes its neighbours' most frequent label, the least of several; labels start as ids.

    Votes are counted by node and label before the choice, so a hub's neighbours never meet in one place; in the first round every
    label has one vote, and the least neighbour is the choice. Each round is written down, which keeps plans short and survives lost executors.
    """
    labels = graph.nodes.select("node_id", F.col("node_id").alias("community"))
    for i in range(rounds):
        if i:
            own = graph.votes(labels).groupBy("node_id").agg(F.min(F.struct(-F.col("n"), "community")).alias("best")).select("node_id", F.col("best.community").alias("best"))
        else:
            own = graph.least_neighbours().select("node_id", F.col("least").alias("best"))
        new = keep(labels.select("node_id", F.col("community").alias("old")).join(own, "node_id", "left").select("node_id", "old", F.coalesce("best", "old").alias("community")), "labels")
        labels = new.select("node_id", "community")
        if new.where("old <> community").isEmpty():
            break
    return labels
