"""Subgraphs sampled by random walks: a row for each sample and place, and the edges among a sample's nodes.

Which neighbour a walk takes follows from a hash of seed, walk and step, so a sample is the same however the tables are dealt.
Neighbours are numbered by node once; a step is then a join on (node, number) that gives one row a walk, however
many neighbours a hub has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphsieve.graph import Graph
from graphsieve.sources.tables import keep


def choice(seed: int, walk: str, step: int, n: Column) -> Column:
    """A number below ``n`` from the first 32 bits of md5 of ``seed:walk:step``."""
    text = F.concat_ws(":", F.lit(seed), F.col(walk), F.lit(step))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), n)


def walks(graph: Graph, targets: DataFrame | None = None, length: int = 4, seed: int = 1) -> DataFrame:
    """sample (the target), place, node: ``length`` nodes of a walk over undirected edges from each target on; a target without neighbours is alone."""
    numbered = graph.symmetric.select(F.col("src").alias("node"), "dst", (F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1).cast("long").alias("number"))
    numbered = keep(numbered, "walk-neighbours")
    degrees = numbered.groupBy("node").agg(F.count("*").alias("n"))
    here = (graph.nodes if targets is None else targets).select(F.col("node_id").alias("sample"), F.col("node_id").alias("node"))
    out = here.select("sample", F.lit(0).alias("place"), "node")
    for step in range(1, length):
        asked = here.join(degrees, "node").select("sample", "node", choice(seed, "sample", step, F.col("n")).alias("number"))
        here = keep(asked.join(numbered, ["node", "number"]).select("sample", F.col("dst").alias("node")), "walk")
        out = out.unionByName(here.select("sample", F.lit(step).alias("place"), "node"))
    return out


def members(rows: DataFrame) -> DataFrame:
    """sample, place, node: each node of a sample once, at its first place."""
    return rows.groupBy("sample", "node").agg(F.min("place").alias("place")).select("sample", "place", "node")


def induced(graph: Graph, rows: DataFrame) -> DataFrame:
    """sample, src, dst, w: the edges among each sample's nodes with their multiplicity; pairs of a sample's places meet the edges, so a hub's other edges are never touched."""
    own = members(rows)
    pairs = own.select("sample", F.col("node").alias("src")).join(own.select("sample", F.col("node").alias("dst")), "sample")
    return pairs.join(graph.weighted, ["src", "dst"]).select("sample", "src", "dst", "w")
