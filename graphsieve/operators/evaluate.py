"""Measurement against labels, the last step of all, and comparison of methods over data sets and decisions."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphsieve.functions.stats import average_rank, chi2_tail, f_tail, studentized_range


def labelled(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """scores with y, 1 for anomalies (label above 0); nodes without a label are left out."""
    return scores.join(labels.where("label is not null").select("node_id", (F.col("label") > 0).cast("int").alias("y")), "node_id")


def auroc(rows: DataFrame, by: list[str], value: str = "score") -> DataFrame:
    """by, auroc of ``value`` against y, ties counted half; null where a class is missing."""
    ranked = rows.withColumn("_r", average_rank(value, by))
    p, n = F.sum("y"), F.sum(1 - F.col("y"))
    return ranked.groupBy(*by).agg(F.when((p > 0) & (n > 0), (F.sum(F.when(F.col("y") == 1, F.col("_r"))) - p * (p + 1) / 2) / (p * n)).alias("auroc"))


def auroc_by_buckets(rows: DataFrame, by: list[str], buckets: int = 1 << 12) -> DataFrame:
    """by, auroc of ``score`` (0 to 1) against ``y``, exactly, ties counting half; null with one class only.

    Positives meet the negatives in lower buckets by sums over buckets, of which a group has a bounded number; only rows of buckets with both
    kinds are ranked among themselves, by their distinct scores. So no task sees a whole group.
    """
    kept = rows.select(*by, "score", "y", F.least(F.floor(F.col("score") * buckets), F.lit(buckets - 1)).alias("bucket"))
    values = kept.groupBy(*by, "bucket", "score").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    below = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = values.groupBy(*by, "bucket").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).withColumn("lower", F.coalesce(F.sum("q").over(below), F.lit(0)))
    mixed = sums.where("p > 0 and q > 0").select(*by, "bucket")
    inner = Window.partitionBy(*by, "bucket").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    within = values.join(mixed, [*by, "bucket"], "left_semi").withColumn("less", F.coalesce(F.sum("q").over(inner), F.lit(0)))
    won = within.groupBy(*by).agg(F.sum(F.col("p") * (F.col("less") + F.col("q") / 2)).alias("within"))
    total = sums.groupBy(*by).agg(F.sum("p").alias("n_p"), F.sum("q").alias("n_q"), F.sum(F.col("p") * F.col("lower")).alias("across"))
    return total.join(won, by, "left").select(*by, F.try_divide(F.col("across") + F.coalesce("within", F.lit(0.0)), F.col("n_p") * F.col("n_q")).alias("auroc"))


def average_precision(rows: DataFrame, by: list[str], value: str = "score") -> DataFrame:
    """by, ap: the sum over distinct thresholds of recall gained times precision there; null without anomalies."""
    steps = rows.groupBy(*by, value).agg(F.sum("y").alias("tp"), F.count("*").alias("k"))
    down = Window.partitionBy(*by).orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gained = steps.withColumn("pr", F.sum("tp").over(down) / F.sum("k").over(down))
    return gained.groupBy(*by).agg(F.try_divide(F.sum(F.col("tp") * F.col("pr")), F.sum("tp")).alias("ap"))


def recall_at(rows: DataFrame, by: list[str], k: int, value: str = "score") -> DataFrame:
    """by, hits, recall, precision of the ``k`` highest, ties to the smaller id."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), "node_id"))
    total = rows.groupBy(*by).agg(F.sum("y").alias("p"))
    hits = rows.withColumn("_p", place).where(F.col("_p") <= k).groupBy(*by).agg(F.sum("y").alias("hits"))
    joined = hits.join(total, by) if by else hits.crossJoin(F.broadcast(total))  # one row
    return joined.select(*by, "hits", (F.col("hits") / F.greatest("p", F.lit(1))).alias("recall"), (F.col("hits") / k).alias("precision"))


def measure(scores: DataFrame, labels: DataFrame, ks: tuple[int, ...] = (50, 100, 200)) -> DataFrame:
    """paradigm, auroc, ap, and recall_k for each k."""
    rows = labelled(scores, labels)
    out = auroc(rows, ["paradigm"]).join(average_precision(rows, ["paradigm"]), "paradigm")
    for k in ks:
        out = out.join(recall_at(rows, ["paradigm"], k).select("paradigm", F.col("recall").alias(f"recall_{k}")), "paradigm")
    return out


def seed_summary(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by, mean and population deviation over seeds."""
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("runs"))


def method_ranks(rows: DataFrame) -> DataFrame:
    """dataset, method, rank of ``value``, highest first; those without a value share the last places."""
    k = F.count("*").over(Window.partitionBy("dataset"))
    known = F.when(F.col("value").isNotNull() & ~F.isnan("value"), F.col("value"))
    rows = rows.withColumn("_v", known).withColumn("_neg", -known)
    missing = F.sum(F.when(F.col("_v").isNull(), 1).otherwise(0)).over(Window.partitionBy("dataset"))
    ranked = F.rank().over(Window.partitionBy("dataset").orderBy(F.col("_neg").asc_nulls_last())) + (F.count("*").over(Window.partitionBy("dataset", "_neg")) - 1) / 2
    return rows.select("dataset", "method", F.when(F.col("_v").isNull(), k - (missing - 1) / 2).otherwise(ranked).alias("rank"))


#: Critical values of the studentised range over the root of two (Nemenyi) and of Bonferroni-Dunn at 0.05, for 2 to 10 methods.
NEMENYI = [1.960, 2.343, 2.569, 2.728, 2.850, 2.949, 3.031, 3.102, 3.164]
BONFERRONI_DUNN = [1.960, 2.241, 2.394, 2.498, 2.576, 2.638, 2.690, 2.724, 2.773]


def friedman(ranks: DataFrame) -> dict:
    """Average ranks, the Friedman statistic with its p, Iman and Davenport's F with its p, and critical differences for any number of methods."""
    rows = ranks.groupBy("method").agg(F.avg("rank").alias("r"), F.count("*").alias("n")).orderBy("r", "method").collect()
    k, n = len(rows), max((r["n"] for r in rows), default=0)
    if k < 2 or n < 1:
        return {"ranks": {r["method"]: r["r"] for r in rows}, "n": n, "k": k, "chi2": 0.0, "p": 1.0, "f": 0.0, "p_f": 1.0}
    chi2 = 12 * n / (k * (k + 1)) * (sum(r["r"] ** 2 for r in rows) - k * (k + 1) ** 2 / 4)
    rest = n * (k - 1) - chi2
    f = (n - 1) * chi2 / rest if rest > 1e-12 else float("inf")
    scale = (k * (k + 1) / (6 * n)) ** 0.5
    nemenyi = NEMENYI[k - 2] if k - 2 < len(NEMENYI) else studentized_range(k) / 2**0.5
    dunn = BONFERRONI_DUNN[k - 2] if k - 2 < len(BONFERRONI_DUNN) else NormalDist().inv_cdf(1 - 0.05 / (2 * (k - 1)))
    p_f = f_tail(f, k - 1, (k - 1) * (n - 1)) if n > 1 else 1.0
    return {"ranks": {r["method"]: r["r"] for r in rows}, "n": n, "k": k, "chi2": chi2, "p": chi2_tail(chi2, k - 1), "f": f, "p_f": p_f, "cd_nemenyi": nemenyi * scale, "cd_bonferroni_dunn": dunn * scale}


def latest(rows: DataFrame, keys: list[str], when: str = "ts") -> DataFrame:
    """The latest row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(when)))).where("_n = 1").drop("_n")


def majority_vote(decisions: DataFrame, share: float = 0.5) -> DataFrame:
    """dataset, paradigm: named by that share of the decisions; if none is, the most named one."""
    total = decisions.groupBy("dataset").agg(F.count("*").alias("n"))
    votes = decisions.select("dataset", F.explode(F.array_distinct("selected")).alias("paradigm")).groupBy("dataset", "paradigm").agg(F.count("*").alias("v")).join(total, "dataset")
    best = F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc("v"), "paradigm"))
    passed = F.max(F.when(F.col("v") >= share * F.col("n"), 1).otherwise(0)).over(Window.partitionBy("dataset"))
    return votes.withColumn("_b", best).withColumn("_p", passed).where((F.col("v") >= share * F.col("n")) | ((F.col("_p") == 0) & (F.col("_b") == 1))).select("dataset", "paradigm", F.col("v").alias("votes"))


def median_of_models(decisions: DataFrame) -> DataFrame:
    """dataset, auroc: the median over models of their means."""
    return decisions.groupBy("dataset", "model").agg(F.avg("auroc").alias("m")).groupBy("dataset").agg(F.percentile("m", 0.5).alias("auroc"))


def decision_report(decisions: DataFrame) -> DataFrame:
    """arm, model, dataset: validity, whether all repeats chose the same set, means, and the upper median of the latency."""
    chosen = F.concat_ws(",", F.array_sort("selected"))
    return decisions.groupBy("arm", "model", "dataset").agg(
        F.avg(F.col("valid_json").cast("int")).alias("validity"), (F.count_distinct(chosen) == 1).alias("stable"), F.avg("auroc").alias("auroc"), F.avg("auprc").alias("auprc"), F.element_at(F.array_sort(F.collect_list("latency_s")), F.floor(F.count("latency_s") / 2).cast("int") + 1).alias("latency")
    )  # repeats of one cell, a few rows


def arm_pivot(decisions: DataFrame, models: list[str]) -> DataFrame:
    """dataset, arm, and each model's mean."""
    return decisions.groupBy("dataset", "arm").pivot("model", models).agg(F.avg("auroc"))


def paired_arms(decisions: DataFrame, a: str, b: str) -> DataFrame:
    """dataset, means of both arms over the repeats they share, their difference, how many repeats chose other sets, and whether the second arm is worse."""
    side = lambda arm, tag: decisions.where(F.col("arm") == arm).select("dataset", "repeat", F.col("auroc").alias(f"auroc_{tag}"), F.array_sort("selected").alias(f"set_{tag}"))
    both = side(a, "a").join(side(b, "b"), ["dataset", "repeat"], "full_outer")
    return both.groupBy("dataset").agg(F.avg("auroc_a").alias("mean_a"), F.avg("auroc_b").alias("mean_b"), (F.avg("auroc_b") - F.avg("auroc_a")).alias("delta"), F.sum(F.when(F.col("set_a") != F.col("set_b"), 1).otherwise(0)).alias("changed"), (F.avg("auroc_b") < F.avg("auroc_a")).cast("int").alias("worse"))


def probe_admission(rows: DataFrame) -> DataFrame:
    """paradigm, budget: probes whose rank correlation with the full run has a median of 0.5 and a least of 0; budget 20 before others."""
    good = rows.groupBy("paradigm", "budget").agg(F.percentile("rho", 0.5).alias("median"), F.min("rho").alias("least")).where("median >= 0.5 and least >= 0")
    order = F.row_number().over(Window.partitionBy("paradigm").orderBy((F.col("budget") != 20).cast("int"), "budget"))
    return good.withColumn("_n", order).where("_n = 1").select("paradigm", "budget", "median", "least")
