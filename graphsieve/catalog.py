"""What is known about detectors and artifacts, and rules on a graph's profile.

A precondition is property -> (comparison, threshold); a property that the profile lacks does not speak against.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPARE = {">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, "<": lambda a, b: a < b}


@dataclass(frozen=True)
class Paradigm:
    name: str
    assumption: str
    needs: Mapping[str, tuple[str, float]] = field(default_factory=dict)
    cost: str = "fast"
    detector: str = ""
    agent_created: bool = False

    def applies(self, profile: Mapping[str, float]) -> bool:
        return all(p not in profile or profile[p] is None or COMPARE[op](profile[p], t) for p, (op, t) in self.needs.items())

    def grounding(self, profile: Mapping[str, float]) -> str:
        show = lambda v: f"{v:.3g}" if isinstance(v, float) else str(v)
        return "; ".join(f"{p} = {show(profile.get(p))} satisfies {op} {t:g}" for p, (op, t) in self.needs.items())


#: Fixed thresholds of the detectors' preconditions.
PARADIGMS = {
    p.name: p
    for p in (
        Paradigm("local_affinity", "normal nodes resemble their neighbours", {"homophily": (">=", 0.3)}),
        Paradigm("homophily_violation", "anomalies lie far from their neighbours' mean", {"homophily": (">=", 0.4)}),
        Paradigm("density", "anomalies lie in sparse regions of attribute space", {"num_nodes": (">=", 30)}),
        Paradigm("community", "anomalies lie far from their community's centre", {"num_communities": (">=", 2)}),
        Paradigm("spectral", "anomalies carry high-frequency energy", {"num_nodes": (">=", 30)}),
        Paradigm("attr_struct_mismatch", "attribute and structure disagree about anomalies", {"feature_dim": (">=", 2)}),
        Paradigm("conformity", "anomalies fit the common template too well", {"feature_dup_rate": (">=", 0.4)}),
        Paradigm("linear_residual", "anomalies resist linear self-representation", {"feature_sparsity": ("<=", 0.3), "feature_dim": (">=", 100), "num_nodes": ("<=", 30000)}),
        Paradigm("peripheral_mismatch", "anomalies hang loosely on the graph and fit it badly", {"num_nodes": ("<=", 500)}),
        Paradigm("attribute_inflation", "anomalies have large values throughout", {"avg_degree": ("<=", 5), "num_nodes": (">=", 500), "feature_dim": ("<=", 100)}),
        Paradigm("clique_density", "anomalies form dense cliques", {"feature_sparsity": (">=", 0.9), "feature_dim": (">=", 100)}),
        Paradigm("reconstruction", "anomalies reconstruct badly", {"feature_dim": (">=", 2)}, "deep"),
        Paradigm("contrastive", "anomalies are unstable under masking", {"num_nodes": (">=", 50)}, "deep"),
        Paradigm("adversarial", "a discriminator takes anomalies for noise", {"num_nodes": (">=", 500)}, "deep"),
        Paradigm("one_class", "normal nodes lie around one centre", {"feature_dim": (">=", 2)}, "deep"),
        Paradigm("subgraph_contrast", "anomalies disagree with the subgraphs around them", {"feature_dim": (">=", 100)}, "deep"),
    )
}


@dataclass(frozen=True)
class Artifact:
    name: str
    threshold: float
    paradigms: tuple[str, ...]
    description: str


ARTIFACTS = {
    a.name: a
    for a in (
        Artifact("degree_confound", 0.7, ("reconstruction", "spectral", "adversarial", "density"), "the score follows the degree"),
        Artifact("community_size", 0.6, ("community", "contrastive"), "the top falls into one community"),
        Artifact("feature_sparsity", 0.5, ("one_class", "homophily_violation", "attr_struct_mismatch"), "the top is sparser than the rest"),
        Artifact("reconstruction_capacity", 0.6, ("reconstruction", "attr_struct_mismatch"), "the top has few neighbours"),
        Artifact("detector_redundancy", 0.8, ("contrastive", "local_affinity"), "two detectors say the same"),
    )
}


def applicable(profile: Mapping[str, float], catalog: Mapping[str, Paradigm] = PARADIGMS) -> dict[str, bool]:
    return {name: p.applies(profile) for name, p in catalog.items()}


def catalog_frame(spark: SparkSession, catalog: Mapping[str, Paradigm] = PARADIGMS) -> DataFrame:
    """paradigm, property, op, threshold: a row for each condition, and one without property where there is none."""
    rows = [(p.name, k, op, float(t)) for p in catalog.values() for k, (op, t) in (p.needs or {None: (None, 0.0)}).items()]
    return spark.createDataFrame(rows, "paradigm string, property string, op string, threshold double")


def applicable_frame(conditions: DataFrame, profile: DataFrame) -> DataFrame:
    """paradigm, applies; ``profile`` has property, value."""
    v, t = F.col("value"), F.col("threshold")
    holds = F.when(F.col("op") == ">=", v >= t).when(F.col("op") == "<=", v <= t).when(F.col("op") == ">", v > t).when(F.col("op") == "<", v < t)
    return conditions.join(profile, "property", "left").groupBy("paradigm").agg(F.min(F.coalesce(holds, F.lit(True)).cast("int")).alias("applies"))


def artifacts_for(name: str) -> list[Artifact]:
    return [a for a in ARTIFACTS.values() if name in a.paradigms]


#: What a profile recommends, as rows (part, needs, choice). Of encoder, decoder and sizes the first row that fits counts; of the others all that fit, in this order.
INJECTED = {"feature_sparsity": (">=", 0.4), "feature_dim": (">=", 50)}
ALONE = frozenset("gad_nr ego_matching contrastive svdd local_affinity".split())
ADVICE = [
    ("encoders", {"homophily": (">=", 0.7)}, ["gcn"]),
    ("encoders", {"homophily": ("<", 0.4)}, ["gat", "mlp"]),
    ("encoders", {}, ["gcn", "gin"]),
    ("objectives", {"avg_degree": (">=", 10)} | INJECTED, ["gad_nr"]),
    ("objectives", {"feature_sparsity": (">=", 0.5), "feature_dim": (">=", 100)}, ["ego_matching"]),
    ("objectives", {}, ["reconstruction"]),
    ("objectives", {"feature_dim": (">=", 20)}, ["contrastive"]),
    ("objectives", {}, ["svdd"]),
    ("decoder", {"alone": (">=", 1)}, "none"),
    ("decoder", {"feature_dim": (">=", 5), "avg_degree": (">=", 2)}, "dual"),
    ("decoder", {"feature_dim": ("<", 5)}, "dot_product"),
    ("decoder", {}, "feature_mlp"),
    ("augmentations", {"homophily": ("<", 0.4)}, ["edge_truncation"]),
    ("augmentations", {"contrastive_first": (">=", 1), "feature_dim": (">=", 20)}, ["feature_mask"]),
    ("augmentations", {}, ["none"]),
    ("hid", {"feature_dim": ("<=", 200)}, 64),
    ("hid", {}, 128),
    ("layers", {"num_nodes": ("<", 3000)}, 2),
    ("layers", {}, 4),
    ("lr", {"num_nodes": ("<=", 15000)}, 0.004),
    ("lr", {}, 0.001),
    ("epochs", {"num_nodes": ("<=", 15000)}, 200),
    ("epochs", {}, 100),
    ("batch", {"num_nodes": ("<=", 20000)}, 0),
    ("batch", {}, 4096),
    ("neighbours", {"num_nodes": ("<=", 20000)}, -1),
    ("neighbours", {}, 10),
    ("complements", {"num_nodes": ("<=", 20000)}, [{"name": "recon-gcn", "encoder": "gcn", "objective": "reconstruction", "decoder": "dual", "alpha": 0.5}]),
    ("complements", {"num_nodes": (">", 20000)}, [{"name": "recon-gcn", "encoder": "gcn", "objective": "reconstruction", "decoder": "feature_mlp", "alpha": 0.5}]),
    ("complements", {"feature_dim": ("<=", 64), "num_nodes": ("<=", 20000)}, [{"name": "recon-struct", "encoder": "gcn", "objective": "reconstruction", "decoder": "dual", "alpha": 0.2}]),
    ("complements", {"feature_dim": (">=", 20)}, [{"name": "contrastive-gcn", "encoder": "gcn", "objective": "contrastive", "decoder": "none", "augmentation": "feature_mask", "rate": 0.3}]),
    ("complements", {"signal_count": ("<", 4)}, [{"name": "svdd-gcn", "encoder": "gcn", "objective": "svdd", "decoder": "none"}]),
]


def advised(part: str, p: Mapping[str, float]) -> list:
    """The choices of the rows of ADVICE that fit, in order."""
    return [choice for name, needs, choice in ADVICE if name == part and all(COMPARE[op](p[k], t) for k, (op, t) in needs.items())]


def recommend(p: Mapping[str, float]) -> dict:
    """Encoders, objectives, decoder, augmentations and sizes for a profile, best first."""
    objectives = sum(advised("objectives", p), [])
    known = dict(p) | {"alone": float(objectives[0] in ALONE), "contrastive_first": float(objectives[0] == "contrastive")}
    return {
        "encoders": advised("encoders", known)[0],
        "objectives": objectives,
        "decoder": advised("decoder", known)[0],
        "augmentations": sum(advised("augmentations", known), []),
        "sizes": {k: advised(k, known)[0] for k in ("hid", "layers", "lr", "epochs", "batch", "neighbours")},
        "likely_injected": all(COMPARE[op](p[k], t) for k, (op, t) in INJECTED.items()),
    }


def complements(p: Mapping[str, float], signal_count: int) -> list[dict]:
    """Specifications of one to four methods that add what the closed forms may miss."""
    return [dict(x) for x in sum(advised("complements", dict(p) | {"signal_count": signal_count}), [])]


def validate_decision(decision: Mapping | None, known: list[str], most: int = 4) -> dict:
    """The named paradigms without repeats, known ones first ``most``, and the invalid names; none chosen means all known ones."""
    named = decision.get("selected") if isinstance(decision, Mapping) else None
    valid = isinstance(named, list) and all(isinstance(x, str) for x in named)
    distinct = [*dict.fromkeys(named)] if valid else []
    chosen = [x for x in distinct if x in known][:most]
    return {"valid_json": valid, "selected": chosen or list(known), "all_applicable": not chosen, "invalid_names": [x for x in distinct if x not in known]}
