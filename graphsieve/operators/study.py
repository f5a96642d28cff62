"""What studies of selections need: gaps of a set of detectors, candidate fusion rules, policies, and decision logs.

Scores are a long table: paradigm, node_id, score. Ranks, correlations and fusions are windows and aggregations over it; what comes
to the driver has a row for each paradigm or pair of them. A selection is a list of paradigms, the first of them the lead.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphsieve.functions.stats import average_rank, ordinal_rank, safe_corr
from graphsieve.operators import evaluate, fusion, replay
from graphsieve.sources.tables import keep

#: A paradigm with more quality than this gives a signal; rank correlations above that make a cluster.
SIGNAL, CLUSTER = 0.3, 0.6
CLOSED_FORM = ["attribute_inflation", "clique_density", "community", "conformity", "density", "homophily_violation", "local_affinity", "peripheral_mismatch", "spectral", "attr_struct_mismatch"]


# --- gaps ----------------------------------------------------------------------------------------------------------


def tail_agreement(scores: DataFrame) -> DataFrame:
    """a, b, rho for a < b: rank correlation over the tenth of the nodes that ``a`` ranks highest (ties to the larger id)."""
    r = fusion.ranked(scores)
    place = F.row_number().over(Window.partitionBy("paradigm").orderBy(F.desc("r"), F.desc("node_id")))
    n = F.count("*").over(Window.partitionBy("paradigm"))
    tail = r.withColumn("place", place).withColumn("n", n).where(F.col("place") <= F.col("n") - F.floor(F.col("n") * 9 / 10))
    pairs = tail.select("node_id", F.col("paradigm").alias("a"), F.col("r").alias("ra")).join(r.select("node_id", F.col("paradigm").alias("b"), F.col("r").alias("rb")), "node_id").where("a < b")
    again = pairs.withColumn("ra", average_rank("ra", ["a", "b"])).withColumn("rb", average_rank("rb", ["a", "b"]))
    return again.groupBy("a", "b").agg(safe_corr("ra", "rb").alias("rho"))


def clusters(names: list[str], rho: dict[tuple[str, str], float], least: float = CLUSTER) -> list[list[str]]:
    """Groups of paradigms that agree with the group's first one, in the order of ``names``; fewer than three are one group."""
    if len(names) < 3:
        return [list(names)]
    out: list[list[str]] = []
    for name in names:
        own = next((c for c in out if abs(rho.get((c[0], name), rho.get((name, c[0]), 0.0))) > least), None)
        out.append([name]) if own is None else own.append(name)
    return out


def diagnose_gaps(scores: DataFrame) -> dict:
    """What a set of paradigms covers, without labels: signals, agreement in the tails, bimodality, clusters of the alike."""
    names = [r[0] for r in scores.select("paradigm").distinct().orderBy("paradigm").collect()]
    if len(names) < 2:
        return {"signal_count": len(names), "tail_agreement": {}, "bimodality": {}, "coverage_clusters": [names]}
    quality = {r["paradigm"]: r["ued"] for r in fusion.ued(scores).collect()}
    rho = {(r["a"], r["b"]): r["rho"] for r in fusion.spearman_pairs(scores).collect()}
    # fixed names of what is reported
    return {
        "signal_count": sum(v > SIGNAL for v in quality.values()),
        "ued_scores": {k: round(v, 3) for k, v in quality.items()},
        "tail_agreement": {f"{r['a']}|{r['b']}": round(r["rho"], 3) for r in tail_agreement(scores).collect()},
        "bimodality": {r["paradigm"]: round(r["bimodality"], 4) for r in fusion.bimodality(scores).collect()},
        "coverage_clusters": clusters(names, rho),
        "num_paradigms": len(names),
    }


def consensus_reliability(scores: DataFrame) -> DataFrame:
    """reliability: the mean absolute rank correlation over all pairs of paradigms; 0 without a pair."""
    return fusion.spearman_pairs(scores).agg(F.coalesce(F.avg(F.abs("rho")), F.lit(0.0)).alias("reliability"))


def probe_tail_separation(scores: DataFrame) -> DataFrame:
    """paradigm, separation: how many deviations of the lower nine tenths the mean of the upper one lies above theirs; 0 below 20 rows."""
    cut = scores.groupBy("paradigm").agg(F.percentile("score", 0.9).alias("p90"))
    high, low = F.when(F.col("score") > F.col("p90"), F.col("score")), F.when(F.col("score") <= F.col("p90"), F.col("score"))
    s = scores.join(cut, "paradigm").groupBy("paradigm").agg(F.count("*").alias("n"), F.count(high).alias("nh"), F.count(low).alias("nl"), F.avg(high).alias("mh"), F.avg(low).alias("ml"), F.stddev_pop(low).alias("sl"))
    fine = (F.col("n") >= 20) & (F.col("nh") >= 2) & (F.col("nl") >= 2)
    return s.select("paradigm", F.when(fine, (F.col("mh") - F.col("ml")) / (F.col("sl") + 1e-9)).otherwise(0.0).alias("separation"))


def landmarkers(scores: DataFrame) -> DataFrame:
    """paradigm and the mean, deviation and quantiles of its scores."""
    return scores.groupBy("paradigm").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), *(F.percentile("score", q).alias(f"p{round(100 * q)}") for q in (0.5, 0.9, 0.95, 0.99)))


#: Fixed names of the candidate rules.
RULES = ("gate", "consensus_filter", "agreement_weight", "order_decay", "lead_only", "ued_top1", "drop_lowest_ued", "adjudicator")


# --- candidate rules -----------------------------------------------------------------------------------------------


def rank_shares(scores: DataFrame) -> DataFrame:
    """The scores with r, their ordinal rank within the paradigm as a share from 0 to 1."""
    n = F.count("*").over(Window.partitionBy("paradigm"))
    return scores.withColumn("r", ordinal_rank("score", ["paradigm"]) / F.greatest(n - 1, F.lit(1)))


def agreement_with_others(scores: DataFrame) -> DataFrame:
    """paradigm, rho: rank correlation with the mean rank of the other paradigms; means that agree to twelve places tie."""
    r = rank_shares(scores)
    sums = r.groupBy("node_id").agg(F.sum("r").alias("total"), F.count("*").alias("k"))
    others = r.join(sums, "node_id").withColumn("others", F.round((F.col("total") - F.col("r")) / F.greatest(F.col("k") - 1, F.lit(1)), 12))
    return others.withColumn("ro", ordinal_rank("others", ["paradigm"])).groupBy("paradigm").agg(safe_corr("r", "ro").alias("rho"))


def weighted_ranks(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """node_id, fused: the weighted mean of rank shares."""
    w = F.create_map(*[x for p, v in weights.items() for x in (F.lit(p), F.lit(float(v)))])
    own = rank_shares(scores.where(F.col("paradigm").isin([*weights])))
    return own.groupBy("node_id").agg((F.sum(F.col("r") * w[F.col("paradigm")]) / sum(weights.values())).alias("fused"))


def order_decay(scores: DataFrame, selection: list[str]) -> DataFrame:
    """The selection's order as weights: each half of the one before."""
    return weighted_ranks(scores, {p: 0.5**i for i, p in enumerate(selection)})


def lead_only(scores: DataFrame, selection: list[str]) -> DataFrame:
    return weighted_ranks(scores, {selection[0]: 1.0})


def lead_if_best(scores: DataFrame, selection: list[str], graph, measure: str = "tail_separation") -> DataFrame:
    """The lead alone where it has the highest tail separation (or ``ued``) of the selection, else the gate's fusion."""
    chosen = scores.where(F.col("paradigm").isin(selection))
    best = getattr(fusion, measure)(chosen).orderBy(F.desc(measure), "paradigm").first()
    return lead_only(scores, selection) if best and best["paradigm"] == selection[0] else fusion.compose(chosen, graph)[0]


def by_rule(rule: str, scores: DataFrame, selection: list[str], graph, adjudication: dict | None = None, always: bool = False) -> DataFrame:
    """node_id, fused of a selection under a candidate rule; the gate's fusion where the rule leaves it to the gate.

    Rules hold where the gate would average maxima (mode aom), ``always`` everywhere, as without a graph, which leaves no gate to ask.
    """
    chosen = scores.where(F.col("paradigm").isin(selection))
    if rule not in RULES:
        raise ValueError(f"no rule {rule!r}")
    if graph is not None and not always:
        fused, _, decision = fusion.compose(chosen, graph)
        if decision.mode != "aom":
            return fused
    gate = lambda names: fusion.compose(scores.where(F.col("paradigm").isin(names)), graph)[0]
    if rule == "gate" or (rule in ("consensus_filter", "drop_lowest_ued") and len(selection) < 3):
        return gate(selection)
    if rule == "consensus_filter":
        against = {r["paradigm"] for r in agreement_with_others(chosen).where("rho < 0").collect()}
        return gate([p for p in selection if p not in against] or selection)
    if rule == "agreement_weight":
        if len(selection) == 1:
            return lead_only(scores, selection)
        pairs = fusion.spearman_pairs(chosen)
        both = pairs.select(F.col("a").alias("paradigm"), "rho").union(pairs.select("b", "rho"))
        weights = {r["paradigm"]: max(r["w"], 0.0) for r in both.groupBy("paradigm").agg(F.percentile("rho", 0.5).alias("w")).collect()}
        return weighted_ranks(scores, weights) if sum(weights.values()) > 0 else gate(selection)
    if rule in ("ued_top1", "drop_lowest_ued"):
        quality = [r["paradigm"] for r in fusion.ued(chosen).orderBy(F.desc("ued"), "paradigm").collect()]
        return lead_only(scores, quality) if rule == "ued_top1" else gate([p for p in selection if p != quality[-1]])
    if rule == "adjudicator":
        view = (adjudication or {}).get("view", "").strip()
        single = (adjudication or {}).get("mode") == "single" and view in selection
        return lead_only(scores, [view]) if single else gate(selection)
    return {"order_decay": order_decay, "lead_only": lead_only}[rule](scores, selection)


def by_rules(rule: str, scores: DataFrame, log: DataFrame, degrees: DataFrame, communities: DataFrame, avg_degree: float, answers: DataFrame | None = None, found: replay.Replay | None = None) -> DataFrame:
    """decision, node_id, fused, ruled for all decisions of a log (decision, paradigm, place: 0 is the lead) under one rule, in one plan.

    Only decisions whose gate averages maxima (mode aom) are ruled; the others, and those that a rule leaves to the gate, are fused by the
    gate. ``answers`` (decision, mode, view) are those of an adjudicator. Rules that drop paradigms replay what is left; ``found``: the log's
    replay, if it is at hand.
    """
    if rule not in RULES:
        raise ValueError(f"no rule {rule!r}")
    found = found or replay.replay(scores, log, degrees, communities, avg_degree)
    if rule == "gate":
        return found.fused.withColumn("ruled", F.lit(False))
    open_ = found.gates.where("mode = 'aom'").select("decision")
    own = log.join(found.weights.select("decision", "paradigm", "ued"), ["decision", "paradigm"]).join(open_, "decision")
    own = own.join(own.groupBy("decision").agg(F.count("*").alias("k")), "decision")
    first = lambda *order: F.row_number().over(Window.partitionBy("decision").orderBy(*order)) == 1
    if rule in ("consensus_filter", "drop_lowest_ued"):
        if rule == "drop_lowest_ued":
            gone = own.where("k >= 3").withColumn("worst", first("ued", F.desc("paradigm"))).where("worst")
        else:
            gone = own.where("k >= 3").join(agreements(scores, own), ["decision", "paradigm"]).where("rho < 0")
            gone = gone.join(gone.groupBy("decision", "k").agg(F.count("*").alias("n")).where("n < k").select("decision"), "decision", "left_semi")
        gone = keep(gone.select("decision", "paradigm"), "rule-dropped")
        touched = gone.select("decision").distinct()
        left = log.join(touched, "decision", "left_semi").join(gone, ["decision", "paradigm"], "left_anti")
        ruled = replay.replay(scores, left, degrees, communities, avg_degree).fused
    else:
        if rule == "order_decay":
            weights = own.withColumn("w", F.pow(F.lit(0.5), F.col("place")))
        elif rule == "lead_only":
            weights = own.where("place = 0").withColumn("w", F.lit(1.0))
        elif rule == "ued_top1":
            weights = own.withColumn("best", first(F.desc("ued"), "paradigm")).where("best").withColumn("w", F.lit(1.0))
        elif rule == "adjudicator":
            if answers is None:
                return found.fused.withColumn("ruled", F.lit(False))
            views = answers.where("mode = 'single'").select("decision", F.trim("view").alias("paradigm")).distinct()
            weights = own.join(views, ["decision", "paradigm"]).withColumn("w", F.lit(1.0))
        else:
            pairs = fusion.spearman_pairs(scores)
            both = pairs.select(F.col("a").alias("paradigm"), F.col("b").alias("other"), "rho").union(pairs.select("b", "a", "rho"))
            near = own.join(both, "paradigm").join(own.select("decision", F.col("paradigm").alias("other")), ["decision", "other"])
            near = near.groupBy("decision", "paradigm").agg(F.greatest(F.percentile("rho", 0.5), F.lit(0.0)).alias("near"))
            weights = own.join(near, ["decision", "paradigm"], "left").withColumn("w", F.when(F.col("k") == 1, 1.0).otherwise(F.coalesce("near", F.lit(0.0))))
        total = weights.groupBy("decision").agg(F.sum("w").alias("all")).where(F.col("all") > 0)
        weights = keep(weights.join(total, "decision").select("decision", "paradigm", (F.col("w") / F.col("all")).alias("w")), "rule-weights")
        touched = weights.select("decision").distinct()
        ruled = rank_shares(scores).join(weights, "paradigm").groupBy("decision", "node_id").agg(F.sum(F.col("r") * F.col("w")).alias("fused"))
    return ruled.withColumn("ruled", F.lit(True)).unionByName(found.fused.join(touched, "decision", "left_anti").withColumn("ruled", F.lit(False)))


def agreements(scores: DataFrame, log: DataFrame) -> DataFrame:
    """decision, paradigm, rho: rank correlation with the mean rank of the decision's other paradigms; means that agree to twelve places tie."""
    rows = rank_shares(scores).join(log.select("decision", "paradigm"), "paradigm")
    sums = rows.groupBy("decision", "node_id").agg(F.sum("r").alias("total"), F.count("*").alias("k"))
    others = rows.join(sums, ["decision", "node_id"]).withColumn("others", F.round((F.col("total") - F.col("r")) / F.greatest(F.col("k") - 1, F.lit(1)), 12))
    return others.withColumn("ro", ordinal_rank("others", ["decision", "paradigm"])).groupBy("decision", "paradigm").agg(safe_corr("r", "ro").alias("rho"))


# --- policies ------------------------------------------------------------------------------------------------------


def subsets(names: list[str], most: int = 4) -> Iterator[list[str]]:
    """All selections of one to ``most`` paradigms."""
    for k in range(1, most + 1):
        yield from map(list, combinations(sorted(names), k))


def subset_log(spark: SparkSession, names: list[str], most: int = 4) -> DataFrame:
    """decision, paradigm: every selection of one to ``most`` of the names, its number having the bits of its members' places."""
    if len(names) > 62:
        raise ValueError("a selection's number has 62 bits")
    masks = spark.range(1, 1 << len(names)).where(F.bit_count("id") <= most)
    bits = F.filter(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda b: F.getbit(F.col("id"), b) == 1)
    return masks.select(F.col("id").alias("decision"), F.explode(F.transform(bits, lambda b: F.get(F.array(*map(F.lit, names)), b))).alias("paradigm"))


def subset_search(scores: DataFrame, labels: DataFrame, degrees: DataFrame, communities: DataFrame, avg_degree: float, names: list[str], most: int = 4, buckets: int = 1 << 12) -> DataFrame:
    """mask, size, mode, auroc: every selection of one to ``most`` paradigms, replayed in one plan and measured in one pass (``labels``: node_id, label)."""
    found = replay.replay(scores, subset_log(scores.sparkSession, names, most), degrees, communities, avg_degree)
    rows = found.fused.join(labels.select("node_id", "label"), "node_id").select("decision", F.round("fused", replay.PLACES).alias("score"), (F.col("label") > 0).cast("long").alias("y"))
    measured = evaluate.auroc_by_buckets(rows, ["decision"], buckets)
    size = found.weights.groupBy("decision").agg(F.count("*").alias("size"))
    return measured.join(size, "decision").join(found.gates.select("decision", "mode"), "decision").select(F.col("decision").alias("mask"), "size", "mode", "auroc")


def policy(scores: DataFrame, measure: str, k: int) -> DataFrame:
    """paradigm, place and the measure (``ued`` or ``tail_separation``) of the ``k`` best by it."""
    found = getattr(fusion, measure)(scores)
    # a row for each paradigm
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.desc(measure), "paradigm"))).where(F.col("place") <= k)


def arm_selection(arm: str, applicable: DataFrame, seed: int = 0, closed_form: list[str] | None = None) -> DataFrame:
    """dataset, selected: what a policy without a model selects of the paradigms that apply (dataset, paradigm).

    all_applicable: all; random3: three (or all of fewer) by a hash of data set, name and seed; closed_form: those of that kind, or else the first.
    """
    if arm not in ("all_applicable", "random3", "closed_form"):
        raise ValueError(f"no arm {arm!r}")
    own = Window.partitionBy("dataset")
    rows = applicable.select("dataset", "paradigm").distinct()
    if arm == "random3":
        drawn = F.md5(F.concat_ws(":", "dataset", "paradigm", F.lit(str(seed))))
        rows = rows.withColumn("k", F.row_number().over(own.orderBy(drawn, "paradigm"))).where("k <= 3")
    elif arm == "closed_form":
        closed = F.col("paradigm").isin(CLOSED_FORM if closed_form is None else closed_form)
        rows = rows.withColumn("closed", closed).withColumn("any", F.max("closed").over(own)).withColumn("k", F.row_number().over(own.orderBy("paradigm"))).where("closed or (not any and k = 1)")
    return rows.groupBy("dataset").agg(F.array_sort(F.collect_list("paradigm")).alias("selected"))


def evidence_pack(profile: dict, paradigms: list[dict], statistics: DataFrame, domain: str | None = None) -> dict:
    """What a selection is to be based on: the profile, the paradigms that apply (without empty fields), landmarkers of fast ones by name, and what the graph is."""
    rounded = lambda v: round(v, 4) if isinstance(v, float) else v
    stats = {r["paradigm"]: {k: rounded(v) for k, v in r.asDict().items() if k != "paradigm"} for r in statistics.orderBy("paradigm").collect()}  # a row for each paradigm
    pack = {"profile": {k: rounded(v) for k, v in profile.items()}, "paradigms": [{k: v for k, v in p.items() if v} for p in paradigms], "statistics": stats}
    return ({"domain": domain} if domain else {}) | pack


def best_fixed(results: DataFrame) -> DataFrame:
    """selection, mean: the selection with the best mean over all data sets (columns dataset, selection, auroc)."""
    return results.groupBy("selection").agg(F.avg("auroc").alias("mean"), F.count_distinct("dataset").alias("datasets")).orderBy(F.desc("datasets"), F.desc("mean"), "selection").limit(1).select("selection", "mean")


# --- logs ----------------------------------------------------------------------------------------------------------


def canonical(decisions: DataFrame, always: tuple[str, ...] = ()) -> DataFrame:
    """Decisions at temperature 0, and those without a temperature of models whose names begin with one of ``always``."""
    named = F.lit(False)
    for prefix in always:
        named = named | F.col("model").startswith(prefix)
    return decisions.where((F.col("temperature") == 0) | (F.col("temperature").isNull() & named))


def first_of(rows: DataFrame, keys: list[str], order: Column | str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")


def with_adjudications(decisions: DataFrame, answers: DataFrame) -> DataFrame:
    """The decisions with mode and view of the answer for their data set and selection; mode ``gate`` where there is none."""
    own = decisions.withColumn("selection", F.concat_ws(",", "selected"))
    joined = own.join(answers.select("dataset", "selection", "mode", "view"), ["dataset", "selection"], "left")
    return joined.withColumn("mode", F.coalesce("mode", F.lit("gate")))


def enriched(catalog: DataFrame, better: DataFrame) -> DataFrame:
    """A catalog (paradigm, description) with the descriptions that ``better`` has instead."""
    return catalog.join(better.select("paradigm", F.col("description").alias("_better")), "paradigm", "left").withColumn("description", F.coalesce("_better", "description")).drop("_better")


def dataset_statistics(profile: dict, nodes: DataFrame) -> dict:
    """A profile's fields and the share of labelled anomalies in percent."""
    rate = nodes.agg(F.avg((F.coalesce("label", F.lit(0)) > 0).cast("int")).alias("rate")).first()["rate"]
    return {k: round(v, 4) if isinstance(v, float) else v for k, v in profile.items()} | {"anomaly_rate_pct": round(100 * (rate or 0.0), 2)}
