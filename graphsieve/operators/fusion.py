"""Diagnosis of score tables and their label-free composition.

Scores are a long table: paradigm, node_id, score. Everything that grows with the nodes is a window or an
aggregation; what comes to the driver has a row for each paradigm or pair of them.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphsieve.functions.stats import FLAT, average_rank, percentile_rank, safe_corr

#: Fixed names: detectors that are trusted when their precondition holds, and companions of clique_density by density.
TRUSTED = ["conformity", "linear_residual", "peripheral_mismatch", "attribute_inflation", "clique_density"]
COMPANIONS = {True: ["subgraph_contrast", "contrastive", "local_affinity"], False: ["local_affinity", "subgraph_contrast", "contrastive"]}
TRAINED = "trained:"


def ranked(scores: DataFrame) -> DataFrame:
    """The scores with r, their percentile rank within the paradigm; as they are if they have it."""
    return scores if "r" in scores.columns else scores.withColumn("r", percentile_rank("score", ["paradigm"]))


def spearman_pairs(scores: DataFrame) -> DataFrame:
    """a, b, rho for a < b: rank correlation over the nodes that both score."""
    r = ranked(scores)
    pairs = r.select("node_id", F.col("paradigm").alias("a"), F.col("r").alias("ra")).join(r.select("node_id", F.col("paradigm").alias("b"), F.col("r").alias("rb")), "node_id").where("a < b")
    return pairs.groupBy("a", "b").agg(safe_corr("ra", "rb").alias("rho"))


def gamma(scores: DataFrame) -> DataFrame:
    """paradigm, gamma: 1 over the sum of absolute rank correlations with all paradigms, itself included."""
    pairs = spearman_pairs(scores)
    both = pairs.select(F.col("a").alias("paradigm"), "rho").union(pairs.select("b", "rho"))
    own = scores.groupBy("paradigm").agg(F.when(F.stddev_pop("score") < FLAT, 0.0).otherwise(1.0).alias("own"))
    sums = both.groupBy("paradigm").agg(F.sum(F.abs("rho")).alias("s"))
    return own.join(sums, "paradigm", "left").select("paradigm", F.when(F.col("s").isNull(), 1.0).otherwise(1 / F.greatest(F.col("own") + F.col("s"), F.lit(1e-8))).alias("gamma"))


def tail_separation(scores: DataFrame) -> DataFrame:
    """paradigm, tail_separation: how far the rows above the 90th percentile lie from the others; 0 below 20 rows.

    The distribution functions of two sets on either side of a threshold are 1 apart, so that term is a constant.
    """
    cut = scores.groupBy("paradigm").agg(F.percentile("score", 0.9).alias("p90"))
    rows = scores.join(cut, "paradigm")
    tail, body = F.when(F.col("score") > F.col("p90"), F.col("score")), F.when(F.col("score") <= F.col("p90"), F.col("score"))
    s = rows.groupBy("paradigm").agg(F.count("*").alias("n"), F.count(tail).alias("nt"), F.count(body).alias("nb"), F.avg(tail).alias("mt"), F.avg(body).alias("mb"), F.stddev_pop(tail).alias("st"), F.stddev_pop(body).alias("sb"))
    apart = (F.col("mt") - F.col("mb")) / F.greatest("sb", F.lit(FLAT))
    spread = F.col("st") / F.greatest("mt", F.lit(FLAT))
    value = 0.4 * F.least(apart / 5, F.lit(1.0)) + 0.4 + 0.2 / (1 + spread)
    fine = (F.col("n") >= 20) & (F.col("nt") >= 2) & (F.col("nb") >= 2)
    return s.select("paradigm", F.when(fine, F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))).otherwise(0.0).alias("tail_separation"))


def ued(scores: DataFrame) -> DataFrame:
    """paradigm, ued: agreement with the other paradigms' median rank in the upper tenth, disagreement elsewhere. Alone: 0.5."""
    r = ranked(scores)
    # ranks of one node: as many entries as paradigms
    every = r.groupBy("node_id").agg(F.collect_list(F.struct("paradigm", "r")).alias("all"))
    joined = r.join(every, "node_id").withColumn("rest", F.array_sort(F.transform(F.filter("all", lambda e: e["paradigm"] != F.col("paradigm")), lambda e: e["r"])))
    k = F.size("rest")
    half = F.floor(k / 2).cast("int")
    at = lambda i: F.element_at("rest", F.greatest(i, F.lit(1)))
    middle = F.when(k == 0, F.lit(None)).when(k % 2 == 1, at(half + 1)).otherwise((at(half) + at(half + 1)) / 2)
    rows = joined.withColumn("e", middle).select("paradigm", "node_id", "r", "e")
    cut = rows.groupBy("paradigm").agg(F.percentile("r", 0.9).alias("p90"))
    rows = rows.join(cut, "paradigm").withColumn("side", F.col("r") > F.col("p90"))
    sides = rows.withColumn("rr", average_rank("r", ["paradigm", "side"])).withColumn("re", average_rank("e", ["paradigm", "side"]))
    agg = sides.groupBy("paradigm", "side").agg(F.count("*").alias("n"), safe_corr("rr", "re").alias("rho"), F.count("e").alias("others"))
    tail = F.max(F.when(F.col("side") & (F.col("n") > 5), 0.6 * F.greatest(F.lit(0.0), F.col("rho"))))
    body = F.max(F.when(~F.col("side") & (F.col("n") > 20), 0.4 * (1 - F.abs("rho"))))
    return agg.groupBy("paradigm").agg(F.when(F.max("others") == 0, 0.5).otherwise(F.coalesce(tail, F.lit(0.0)) + F.coalesce(body, F.lit(0.0))).alias("ued"))


def bimodality(scores: DataFrame) -> DataFrame:
    """paradigm, bimodality: (skewness squared + 1) over (not excess) kurtosis."""
    return scores.groupBy("paradigm").agg(F.when(F.stddev_pop("score") < FLAT, 0.0).otherwise((F.pow(F.skewness("score"), F.lit(2)) + 1) / (F.kurtosis("score") + 3)).alias("bimodality"))


def consensus(scores: DataFrame) -> DataFrame:
    """node_id, consensus: the median percentile rank."""
    return ranked(scores).groupBy("node_id").agg(F.percentile("r", 0.5).alias("consensus"))


def prune(scores: DataFrame) -> DataFrame:
    """paradigm, rho, sparsity, delta: whether a paradigm stays, by its rank correlation with the consensus. Below three all stay."""
    r = ranked(scores)
    joined = r.join(consensus(scores), "node_id")
    again = joined.withColumn("rc", average_rank("consensus", ["paradigm"]))
    rho = again.groupBy("paradigm").agg(safe_corr("r", "rc").alias("rho"), F.percentile("score", 0.9).alias("p90"), F.count("*").alias("n"))
    over = scores.join(rho.select("paradigm", "p90"), "paradigm").groupBy("paradigm").agg(F.avg(F.when(F.col("score") > F.col("p90"), 1.0).otherwise(0.0)).alias("over"))
    # one row a paradigm from here on
    count = scores.select("paradigm").distinct().agg(F.count("*").alias("k"))
    rows = rho.join(over, "paradigm").join(ued(scores), "paradigm").crossJoin(F.broadcast(count))
    sparsity = F.exp(-3 * F.greatest(F.lit(0.0), F.col("over") - 0.1))
    drop = (F.col("rho") < -0.05) | ((F.col("rho") < 0.05) & (F.col("ued") < 0.2))
    delta = F.when((F.col("k") < 3) | F.col("paradigm").startswith(TRAINED), 1).when(drop, 0).otherwise(1)
    return rows.select("paradigm", "rho", sparsity.alias("sparsity"), delta.alias("delta"))


def mechanism_test(scores: DataFrame, degrees: DataFrame) -> dict:
    """Whether the degree explains the paradigms' agreement: sign consistency, then agreement before and after taking the degree out."""
    rows = scores.join(degrees.select("node_id", F.col("degree").cast("double").alias("degree")), "node_id")
    r = rows.withColumn("rs", average_rank("score", ["paradigm"])).withColumn("rd", average_rank("degree", ["paradigm"]))
    rho = {x["paradigm"]: x["rho"] for x in r.groupBy("paradigm").agg(safe_corr("rs", "rd").alias("rho")).collect()}
    signs = [np.sign(v) for v in rho.values() if abs(v) > 0.1]
    consistency = abs(sum(signs)) / len(rho) if rho else 0.0
    fit = rows.groupBy("paradigm").agg(F.regr_slope("score", "degree").alias("slope"), F.regr_intercept("score", "degree").alias("base"))
    left = rows.join(fit, "paradigm").select("paradigm", "node_id", (F.col("score") - F.coalesce("slope", F.lit(0.0)) * F.col("degree") - F.coalesce("base", F.lit(0.0))).alias("score"))

    def agreement(s: DataFrame) -> float:
        both = s.groupBy("node_id").agg(F.avg("score").alias("mean")).join(consensus(s), "node_id")
        ranks = both.withColumn("a", average_rank("mean", [])).withColumn("b", average_rank("consensus", []))
        return ranks.agg(safe_corr("a", "b").alias("rho")).first()["rho"]

    raw, residual = agreement(scores), agreement(left)
    drop = (raw - residual) / max(abs(raw), 1e-8)
    return {"degree_rho": rho, "consistency": float(consistency), "raw": raw, "residual": residual, "drop": drop, "mechanism": bool(consistency >= 0.6 and drop > 0.25)}


@dataclass
class Weights:
    """Per paradigm alpha, beta, gamma, delta and what they came from; overrides are kept as a record."""

    rows: dict[str, dict[str, float]]
    mode: str = "fuse"
    overrides: list[dict] = field(default_factory=list)

    def weight(self, name: str) -> float:
        w = self.rows.get(name)
        return abs(w["alpha"] * w["beta"] * w["gamma"] * w["delta"]) if w else 1.0

    def active(self) -> list[str]:
        return [p for p, w in self.rows.items() if w["alpha"] != 0 and w["delta"] != 0]

    def override(self, paradigm: str, factor: str, value: float, reason: str) -> None:
        if factor not in ("alpha", "beta", "gamma", "delta"):
            raise ValueError(f"no factor {factor!r}")
        if paradigm not in self.rows:
            raise ValueError(f"no paradigm {paradigm!r}")
        self.overrides.append({"paradigm": paradigm, "factor": factor, "old": self.rows[paradigm][factor], "new": value, "reason": reason})
        self.rows[paradigm][factor] = value


def compute_weights(scores: DataFrame, degrees: DataFrame, communities: DataFrame, applicable: dict[str, bool] | None = None) -> Weights:
    """alpha by applicability, beta by quality, gamma by redundancy, delta by pruning."""
    from graphsieve.operators.replay import single

    return weights_of(single(scores, degrees, communities, 0.0, applicable))


def weights_of(found) -> Weights:
    """Those of a replay's only decision, as they were before its gate."""
    rows = {}
    for x in found.weights.orderBy("paradigm").collect():  # a row for each paradigm
        rows[x["paradigm"]] = {k: float(x[k]) for k in ("alpha", "beta", "gamma", "delta")} | {"excess_mass": x["tail"], "mechanism_flag": x["flagged"], "ued": x["ued"]}
    return Weights(rows)


@dataclass
class Gate:
    mode: str
    reason: str
    deltas: dict[str, float]
    d: float | None = None
    q: float | None = None
    trusted: list[str] = field(default_factory=list)


def decide(names: list[str], quality: dict[str, float], tails: dict[str, float], rho: dict[tuple[str, str], float], degree_rho: dict[str, float], avg_degree: float) -> Gate:
    """The fusion mode from the paradigms' statistics alone; the first rule that fits decides."""
    names = sorted(names)
    keep_all = dict.fromkeys(names, 1.0)
    if len(names) <= 1:
        return Gate("select", "at most one paradigm", keep_all)
    note = ""
    trusted = [p for p in TRUSTED if p in names]
    if trusted:
        chosen = list(trusted)
        companion = None
        if "clique_density" in trusted:
            fits = lambda p: p in names and abs(degree_rho.get(p, 0.0)) < 0.6 and tails.get(p, 0.0) >= 0.3
            companion = next((p for p in COMPANIONS[avg_degree >= 8] if fits(p)), None)
            if companion:
                chosen.append(companion)
            else:
                note = "clique_density found no companion; "
        if not ("clique_density" in trusted and companion is None):
            mode = "select" if len(chosen) == 1 else "pairmax" if len(chosen) == 2 and "clique_density" in chosen else "aom"
            return Gate(mode, f"trusted: {', '.join(chosen)}", {p: float(p in chosen) for p in names}, trusted=chosen)
    pairs = [abs(rho.get((min(a, b), max(a, b)), 0.0)) for a, b in combinations(names, 2)]
    d = 1 - float(np.mean(pairs))
    values = [quality[p] for p in names]
    q = max(values) / max(float(np.median(values)), 0.01)
    order = sorted(names, key=lambda p: (-quality[p], p))
    top, second = order[0], order[1]
    if quality[top] >= 2 * quality[second] and all(tails[top] >= tails[p] for p in names):
        return Gate("select", f"{note}{top} dominates", {p: float(p == top) for p in names}, d, q)
    trained, fast = [tails[p] for p in names if p.startswith(TRAINED)], [tails[p] for p in names if not p.startswith(TRAINED)]
    if trained and max(trained) > 1.5 * max(fast, default=0.0):
        return Gate("fuse", f"{note}trained methods separate their tails best", keep_all, d, q)
    mode = "select" if q > 2.5 else "aom" if d > 0.4 and q < 2 else "select" if d < 0.3 else "hybrid"
    return Gate(mode, f"{note}diversity {d:.3f}, quality ratio {q:.3f}", keep_all, d, q)


def gate(scores: DataFrame, degrees: DataFrame, avg_degree: float) -> Gate:
    """``decide`` on a score table."""
    from graphsieve.operators.replay import single

    return gate_of(single(scores, degrees, degrees.select("node_id", F.lit(0).cast("long").alias("community")), avg_degree))


def gate_of(found) -> Gate:
    """That of a replay's only decision."""
    names = [x["paradigm"] for x in found.weights.select("paradigm").orderBy("paradigm").collect()]
    x = found.gates.first()
    if x is None:
        return Gate("select", "at most one paradigm", {})
    stay = names if x["chosen"] is None else x["chosen"]
    return Gate(x["mode"], x["reason"], {p: float(p in stay) for p in names}, x["d"], x["q"], list(x["chosen"]) if x["trusted"] else [])


def aom_groups(names: list[str], repeats: int = 10, seed: int = 42) -> list[list[str]]:
    """Groups of a third of the names (two at least) from repeated shuffles of the sorted names."""
    rng, order, out = np.random.RandomState(seed), np.arange(len(names)), []
    size, names = max(2, len(names) // 3), sorted(names)
    for _ in range(repeats):
        rng.shuffle(order)
        out += [[names[i] for i in order[at : at + size]] for at in range(0, len(order), size)]
    return out


def wide_ranks(scores: DataFrame, names: list[str]) -> DataFrame:
    """node_id and a percentile rank column for each name."""
    return ranked(scores.where(F.col("paradigm").isin(names))).groupBy("node_id").pivot("paradigm", names).agg(F.first("r"))


def fuse(scores: DataFrame, weights: dict[str, float], mode: str) -> DataFrame:
    """node_id, fused: from the active paradigms' ranks and their weights.

    select: the heaviest. pairmax: the greatest rank. hybrid: the median of the three heaviest. aom: the average of the
    groups' greatest. fuse: the weighted mean. Nothing active, or no weight: 0.
    """
    names = sorted(weights)
    if not names:
        return scores.select("node_id").distinct().withColumn("fused", F.lit(0.0))
    wide = wide_ranks(scores, names)
    col: dict[str, Column] = {p: F.coalesce(F.col(f"`{p}`"), F.lit(0.0)) for p in names}
    heaviest = sorted(names, key=lambda p: (-weights[p], p))
    greatest = lambda cols: reduce(lambda a, b: F.greatest(a, b), cols)

    def median(cols: list[Column]) -> Column:
        ordered = F.array_sort(F.array(*cols))
        k = len(cols)
        return ordered[k // 2] if k % 2 else (ordered[k // 2 - 1] + ordered[k // 2]) / 2

    if mode == "select":
        value = col[heaviest[0]]
    elif mode == "pairmax":
        value = greatest([col[p] for p in names])
    elif mode == "hybrid":
        value = median([col[p] for p in heaviest[:3]])
    elif mode == "aom":
        if len(names) <= 2:
            value = median([col[p] for p in names])
        else:
            groups = aom_groups(names)
            value = sum((greatest([col[p] for p in g]) for g in groups), F.lit(0.0)) / len(groups)
    elif mode == "fuse":
        total = sum(weights.values())
        value = sum((col[p] * weights[p] for p in names), F.lit(0.0)) / total if total >= 1e-8 else F.lit(0.0)
    else:
        raise ValueError(f"no fusion mode {mode!r}")
    return wide.select("node_id", value.alias("fused"))


def compose(scores: DataFrame, graph, applicable: dict[str, bool] | None = None) -> tuple[DataFrame, Weights, Gate]:
    """Weights, then the gate, then fusion: node_id, fused; the weights and the gate's decision. One decision's replay."""
    from graphsieve.operators.replay import single

    found = single(scores, graph.degrees, graph.communities, graph.m / max(1, graph.n), applicable)
    weights, decision = weights_of(found), gate_of(found)
    for p, delta in decision.deltas.items():
        if decision.trusted or delta == 0:
            weights.rows[p]["delta"] = delta
    weights.mode = decision.mode
    return found.fused.select("node_id", "fused"), weights, decision


def score_level_fusion(scores: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """node_id, fused: weighted sum of scores scaled to 0..1, equal weights by default."""
    names = sorted(weights) if weights else [r[0] for r in scores.select("paradigm").distinct().orderBy("paradigm").collect()]
    share = weights or dict.fromkeys(names, 1 / max(1, len(names)))
    ends = scores.groupBy("paradigm").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    w = F.create_map(*[x for p in names for x in (F.lit(p), F.lit(float(share[p])))])
    rows = scores.where(F.col("paradigm").isin(names)).join(ends, "paradigm")
    return rows.groupBy("node_id").agg(F.sum((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-10) * w[F.col("paradigm")]).alias("fused"))
