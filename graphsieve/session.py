"""The analyst's session: a graph, its scores, an append-only evidence log, and what can be asked of them.

The evidence log is small by nature (findings and notes of one session) and lies on the driver until it is saved as
JSON lines through Spark; everything that has a row for each node stays in frames. Asking never writes evidence
unless ``record=True``.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphsieve import catalog
from graphsieve.functions.stats import norm
from graphsieve.graph import Graph
from graphsieve.operators import detectors, evaluate, explore, fusion, neural, study
from graphsieve.sources.tables import keep, load_graph, read_json, to_markdown, write_scores

EVIDENCE = "id string, source_paradigm string, evidence_type string, data string, nodes array<long>, interpretation string, confidence double, ts double, related array<string>"
KINDS = ("signal", "artifact", "convergence", "annotation", "finding")
STATES = ("idle", "exploring", "measuring", "diagnosing", "composing", "reporting")


@dataclass
class Evidence:
    source_paradigm: str
    evidence_type: str
    data: dict
    nodes: list[int]
    interpretation: str
    confidence: float
    ts: float
    related: list[str] = field(default_factory=list)

    @property
    def id(self) -> str:
        return hashlib.sha256(f"{self.source_paradigm}:{self.evidence_type}:{self.ts}".encode()).hexdigest()[:12]


class EvidenceLog:
    def __init__(self):
        self.rows: list[Evidence] = []
        self.trace: list[dict] = []

    def add(self, paradigm: str, kind: str, data: dict | None = None, nodes: list[int] | None = None, interpretation: str = "", confidence: float = 1.0, related: list[str] | None = None) -> str:
        if kind not in KINDS:
            raise ValueError(f"no kind of evidence {kind!r}")
        e = Evidence(paradigm, kind, data or {}, sorted(nodes or []), interpretation, confidence, time.time(), related or [])
        self.rows.append(e)
        return e.id

    def log(self, tool: str, params: dict, summary: str) -> None:
        self.trace.append({"ts": time.time(), "tool": tool, "params": params, "result_summary": summary})

    def of_node(self, node: int) -> list[Evidence]:
        return [e for e in self.rows if node in e.nodes]

    def of_kind(self, kind: str) -> list[Evidence]:
        return [e for e in self.rows if e.evidence_type == kind]

    def of_paradigm(self, paradigm: str) -> list[Evidence]:
        return [e for e in self.rows if e.source_paradigm == paradigm]

    def convergence(self, node: int) -> list[str]:
        """Paradigms with a signal on the node."""
        return sorted({e.source_paradigm for e in self.of_node(node) if e.evidence_type == "signal"})

    def conflicts(self) -> list[int]:
        """Nodes that a signal flags and an annotation clears."""
        flagged = {n for e in self.of_kind("signal") for n in e.nodes}
        cleared = {n for e in self.of_kind("annotation") if e.data.get("cleared") for n in e.nodes}
        return sorted(flagged & cleared)

    def summary(self) -> dict:
        return {"by_type": dict(Counter(e.evidence_type for e in self.rows)), "conflicts": self.conflicts(), "trace_length": len(self.trace)}

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(e.id, e.source_paradigm, e.evidence_type, json.dumps(e.data, default=str), e.nodes, e.interpretation, float(e.confidence), e.ts, e.related) for e in self.rows], EVIDENCE)

    def save(self, spark: SparkSession, path: str) -> None:
        self.frame(spark).coalesce(1).write.mode("overwrite").json(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> EvidenceLog:
        out = cls()
        for r in read_json(spark, path, EVIDENCE).orderBy("ts").collect():
            out.rows.append(Evidence(r.source_paradigm, r.evidence_type, json.loads(r.data), list(r.nodes or []), r.interpretation, r.confidence, r.ts, list(r.related or [])))
        return out


class Session:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.graph: Graph | None = None
        self.reset()

    def reset(self) -> None:
        self.scores: DataFrame | None = None
        self.weights: fusion.Weights | None = None
        self.gate: fusion.Gate | None = None
        self.fused: DataFrame | None = None
        self.known: dict | None = None
        self.log, self.state = EvidenceLog(), "idle"
        self.paradigms, self.artifacts = dict(catalog.PARADIGMS), dict(catalog.ARTIFACTS)
        self.methods: dict[str, dict] = {}
        self.custom: dict[str, Callable[[Graph], DataFrame]] = {}

    def to(self, state: str) -> None:
        if state not in STATES:
            raise ValueError(f"no state {state!r}")
        self.state = state
        self.log.log("state", {"state": state}, state)

    # --- data
    def load(self, nodes_path: str, edges_path: str) -> dict:
        return self.use(load_graph(self.spark, nodes_path, edges_path))

    def use(self, graph: Graph) -> dict:
        self.reset()
        self.graph = graph
        self.log.log("load", {"name": graph.name}, graph.name)
        return {"name": graph.name, "num_nodes": graph.n, "num_edges": graph.m}

    def need(self) -> Graph:
        if self.graph is None:
            raise ValueError("no graph is loaded")
        return self.graph

    def profile(self) -> dict:
        if self.known is None:
            self.known = explore.profile(self.need())
            self.log.log("profile", {}, f"{self.known['num_nodes']} nodes")
        return self.known

    # --- measuring
    def applicable(self) -> list[dict]:
        p = self.profile()
        return [{"name": x.name, "assumption": x.assumption, "reason": x.grounding(p)} for x in self.paradigms.values() if x.applies(p)]

    def register_paradigm(self, name: str, assumption: str, detector: str | Callable[[Graph], DataFrame]) -> None:
        """A detector under a new name: one that exists, or a function from a graph to node_id, score."""
        if callable(detector):
            self.custom[name] = detector
        elif detector not in detectors.CLOSED_FORM | neural.NEURAL:
            raise ValueError(f"unknown detector {detector!r}")
        self.paradigms[name] = catalog.Paradigm(name, assumption, detector=detector if isinstance(detector, str) else "", agent_created=True)

    def register_artifact(self, name: str, threshold: float, paradigms: tuple[str, ...], description: str) -> None:
        self.artifacts[name] = catalog.Artifact(name, threshold, tuple(paradigms), description)

    def detect(self, name: str, **options) -> DataFrame:
        g = self.need()
        p = self.paradigms.get(name)
        if name in self.custom:
            return self.custom[name](g)
        if name in self.methods:
            return neural.train_method(g, self.methods[name])
        return detectors.run_detector(p.detector or name if p else name, g, **options)

    def set_scores(self, name: str, rows: DataFrame) -> None:
        """Scores under a name, in place of earlier ones; what was composed from them is forgotten."""
        new = keep(rows.select(F.lit(name).alias("paradigm"), "node_id", F.col("score").cast("double").alias("score")), "scores")
        self.scores = new if self.scores is None else self.scores.where(F.col("paradigm") != name).unionByName(new)
        self.weights = self.gate = self.fused = None

    def run(self, names: list[str] | None = None, cost: str | None = None, **options) -> dict:
        """Runs detectors (all applicable ones, or those of a cost); failures are part of the result."""
        names = names or [x["name"] for x in self.applicable() if cost is None or self.paradigms[x["name"]].cost == cost]
        failed = {}
        for name in names:
            try:
                self.set_scores(name, self.detect(name, **options))
            except Exception as error:  # one detector's failure is a result of the run
                failed[name] = str(error)[:300]
        done = [n for n in names if n not in failed]
        self.log.log("run", {"names": names}, f"{len(done)} run, {len(failed)} failed")
        return {"run": done, "failed": failed}

    def table(self) -> DataFrame:
        if self.scores is None:
            raise ValueError("no scores yet")
        return self.scores

    # --- composing
    def compose(self) -> fusion.Gate:
        """Weights, gate, fusion; overrides of weights stay."""
        old = self.weights.overrides if self.weights else []
        p = self.profile()
        fits = {n: x.applies(p) for n, x in self.paradigms.items()}
        fused, self.weights, self.gate = fusion.compose(self.table(), self.need(), fits)
        if old:
            for o in old:
                if o["paradigm"] in self.weights.rows:
                    self.weights.override(o["paradigm"], o["factor"], o["new"], o["reason"])
            fused = fusion.fuse(self.table(), {n: self.weights.weight(n) for n in self.weights.active()}, self.gate.mode)
        self.fused = keep(fused, "fused")
        self.log.log("compose", {}, f"{self.gate.mode}: {self.gate.reason}")
        return self.gate

    def override_weight(self, paradigm: str, factor: str, value: float, reason: str) -> None:
        if self.weights is None:
            self.compose()
        self.weights.override(paradigm, factor, value, reason)
        self.fused = keep(fusion.fuse(self.table(), {n: self.weights.weight(n) for n in self.weights.active()}, self.gate.mode), "fused")

    def top(self, k: int = 50) -> DataFrame:
        """The highest fused nodes with all scores."""
        if self.fused is None:
            self.compose()
        best = self.fused.orderBy(F.desc("fused"), "node_id").limit(k)
        wide = self.table().join(best.select("node_id"), "node_id", "left_semi").groupBy("node_id").pivot("paradigm").agg(F.first("score"))
        return best.join(wide, "node_id").orderBy(F.desc("fused"), "node_id")

    def score_summary(self) -> dict:
        if self.fused is None:
            self.compose()
        s = self.fused.agg(F.avg("fused").alias("mean"), F.stddev_pop("fused").alias("std"), *(F.percentile("fused", q).alias(f"p{round(100 * q)}") for q in (0.9, 0.95, 0.99))).first()
        return {"mode": self.gate.mode, "weights": {p: self.weights.weight(p) for p in self.weights.rows}, "fused": s.asDict()}

    # --- evidence
    def record_signals(self, most: int = 200) -> int:
        """A signal for each paradigm's nodes above its 95th percentile (the highest ``most`` of them)."""
        s = self.table()
        cut = s.groupBy("paradigm").agg(F.percentile("score", 0.95).alias("p95"))
        rows = explore.top(s.join(cut, "paradigm").where("score > p95"), most).groupBy("paradigm").agg(F.collect_list("node_id").alias("ids")).collect()
        for r in rows:
            self.log.add(r["paradigm"], "signal", {"above": 95}, list(r["ids"]))
        return len(rows)

    def degree_correlation(self, record: bool = False) -> DataFrame:
        found = explore.degree_correlation(self.table(), self.need().degrees)
        if record:
            for r in found.where("artifact = 1").collect():
                self.log.add(r["paradigm"], "artifact", {"check": "degree_confound", "rho": r["rho"]}, interpretation="the score follows the degree")
        return found

    def check_artifact(self, name: str, paradigm: str, record: bool = False) -> dict:
        got = explore.check_artifact(name, self.need(), self.table().where(F.col("paradigm") == paradigm))
        if record and got["detected"]:
            self.log.add(paradigm, "artifact", got)
        return got

    def convergent(self, least: int = 3, k: int = 50, record: bool = False) -> DataFrame:
        found = explore.convergent(self.table(), least, k)
        if record:
            for r in found.collect():  # k rows at most
                self.log.add("convergence", "convergence", {"flaggers": r["flaggers"].split(",")}, [r["node_id"]])
        return found

    def finding(self, nodes: list[int], kind: str, reasoning: str, confidence: float, evidence: list[str] | None = None, checks: list[str] | None = None) -> str:
        return self.log.add("analyst", "finding", {"anomaly_type": kind, "artifact_checks_passed": checks or []}, nodes, reasoning, confidence, evidence)

    def annotate(self, nodes: list[int], text: str, cleared: bool = False) -> str:
        return self.log.add("analyst", "annotation", {"cleared": cleared}, nodes, text)

    def node_card(self, node_id: int) -> dict:
        ids = self.spark.createDataFrame([(node_id,)], "node_id long")
        g = self.need()
        rows = explore.node_view(self.table(), ids).collect()
        own = g.nodes.where(F.col("node_id") == node_id).select(norm("features").alias("norm")).join(F.broadcast(g.degrees.where(F.col("node_id") == node_id)), how="cross").collect()  # one row each
        if not own:
            raise ValueError(f"no node {node_id}")
        return {"node_id": node_id, "degree": own[0]["degree"], "norm": own[0]["norm"], "scores": {r["paradigm"]: {"score": r["score"], "percentile": r["percentile"], "flagged": bool(r["flagged"])} for r in rows}, "convergence": self.log.convergence(node_id), "evidence": [asdict(e) | {"id": e.id} for e in self.log.of_node(node_id)]}

    def report(self, k: int = 20) -> str:
        """A markdown report: graph, decision, highest nodes, findings."""
        g = self.profile()
        lines = [f"# {self.need().name}", "", f"{g['num_nodes']} nodes, {g['num_edges']} edges, mean degree {g['avg_degree']:.2f}.", "", "## Highest nodes", "", to_markdown(self.top(k)), "", f"Mode {self.gate.mode}: {self.gate.reason}", "", "## Findings", ""]
        return "\n".join(lines + [f"- {e.interpretation} (nodes {e.nodes}, confidence {e.confidence:g})" for e in self.log.of_kind("finding")])

    # --- methods of parts
    def recommend(self) -> dict:
        return catalog.recommend(self.profile())

    def build(self, name: str, spec: dict | str) -> dict:
        """Registers a composed method; ``spec`` may name a recipe."""
        if isinstance(spec, str):
            if spec not in neural.RECIPES:
                raise ValueError(f"no recipe {spec!r}")
            spec = neural.RECIPES[spec]
        self.methods[name] = neural.checked(spec)
        return self.methods[name]

    def train(self, name: str) -> None:
        self.set_scores(f"{fusion.TRAINED}{name}", neural.train_method(self.need(), self.methods[name]))

    def auto_build(self, most: int = 2, epochs: int | None = None) -> list[str]:
        """Builds and trains the recommended methods."""
        r = self.recommend()
        names = []
        for objective in r["objectives"][:most]:
            spec = {"encoder": r["encoders"][0], "objective": objective, "decoder": r["decoder"], "augmentation": r["augmentations"][0] if objective == "contrastive" else "none", **{k: r["sizes"][k] for k in ("hid", "layers", "lr", "epochs")}}
            name = f"{r['encoders'][0]}-{objective}"
            self.build(name, spec | ({"epochs": epochs} if epochs else {}))
            self.train(name)
            names.append(name)
        return names

    def hybrid(self, epochs: int | None = None) -> fusion.Gate:
        """Fast detectors, complements for what they miss, weights, gate and fusion."""
        self.run(cost="fast")
        signals = fusion.ued(self.table()).where("ued > 0.3").count()
        for spec in catalog.complements(self.profile(), signals):
            spec = dict(spec)
            name = spec.pop("name")
            self.build(name, spec | ({"epochs": epochs} if epochs else {}))
            self.train(name)
            self.paradigms[f"{fusion.TRAINED}{name}"] = replace(catalog.Paradigm(name, "complements the fast detectors"), agent_created=True)
        flat = [r["paradigm"] for r in self.table().groupBy("paradigm").agg(F.stddev_pop("score").alias("sd")).where("sd <= 1e-6").collect()]
        self.scores = self.table().where(~F.col("paradigm").isin(flat)) if flat else self.scores
        return self.compose()

    # --- at the end
    def evaluate(self) -> DataFrame:
        """Measures scores and the fusion against labels."""
        if "label" not in self.need().nodes.columns:
            raise ValueError("the graph has no labels")
        rows = self.table()
        if self.fused is not None:
            rows = rows.unionByName(self.fused.select(F.lit("fused").alias("paradigm"), "node_id", F.col("fused").alias("score")))
        return evaluate.measure(rows, self.graph.nodes)

    def save(self, folder: str) -> None:
        """Scores as Parquet, in place of older ones, evidence and what is decided as JSON."""
        names = []
        if self.scores is not None:
            self.scores = keep(self.scores, "scores")  # it may read what is replaced
            names = [r[0] for r in self.scores.select("paradigm").distinct().orderBy("paradigm").collect()]
            write_scores(self.scores, f"{folder}/scores", self.need().name, 0)
        if self.log.rows:
            self.log.save(self.spark, f"{folder}/evidence")
        weights = {"rows": self.weights.rows, "mode": self.weights.mode, "overrides": self.weights.overrides} if self.weights else None
        meta = {"name": self.need().name, "state": self.state, "profile": self.known, "paradigms": names, "weights": weights, "gate": asdict(self.gate) if self.gate else None, "methods": self.methods, "trace": self.log.trace}
        self.spark.createDataFrame([(json.dumps(meta, default=str),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{folder}/workspace")

    def resume(self, folder: str) -> None:
        """A saved session for the graph in use: scores, evidence, trace, profile, weights with overrides, gate, fusion and methods."""
        from graphsieve.sources.tables import read_scores

        meta = json.loads("\n".join(r[0] for r in self.spark.read.text(f"{folder}/workspace").collect()))
        if meta["paradigms"]:
            self.scores = keep(read_scores(self.spark, f"{folder}/scores", self.need().name, 0).where(F.col("paradigm").isin(meta["paradigms"])), "scores")
        self.log = EvidenceLog.load(self.spark, f"{folder}/evidence")
        self.log.trace, self.state, self.known, self.methods = meta["trace"], meta["state"], meta["profile"], meta["methods"]
        self.weights = fusion.Weights(**meta["weights"]) if meta["weights"] else None
        self.gate = fusion.Gate(**meta["gate"]) if meta["gate"] else None
        if self.weights and self.gate and self.scores is not None:
            self.fused = keep(fusion.fuse(self.table(), {n: self.weights.weight(n) for n in self.weights.active()}, self.gate.mode), "fused")

    def method_scores(self, paradigm: str, k: int = 20) -> dict:
        """The ``k`` highest nodes of one paradigm, and statistics of all its scores."""
        own = self.table().where(F.col("paradigm") == paradigm)
        found = explore.top(own, k).orderBy("place").collect()
        if not found:
            raise ValueError(f"no scores of {paradigm!r}")
        return {"paradigm": paradigm, "top": [(r["node_id"], r["score"]) for r in found], "stats": study.landmarkers(own).drop("paradigm").first().asDict()}

    def score_matrix(self) -> DataFrame:
        """node_id and a column of scores for each paradigm."""
        return self.table().groupBy("node_id").pivot("paradigm").agg(F.first("score"))

    def gaps(self) -> dict:
        return study.diagnose_gaps(self.table())

    # --- listings
    def list_components(self, category: str | None = None) -> dict[str, list[str]]:
        """Names of the parts of methods, by category."""
        every = {"encoders": neural.ENCODERS, "objectives": neural.OBJECTIVES, "decoders": neural.DECODERS, "augmentations": neural.AUGMENTATIONS, "fusions": neural.FUSIONS}
        if category is not None and category not in every:
            raise ValueError(f"no category {category!r}")
        return {c: sorted(names) for c, names in every.items() if category in (None, c)}

    def component_info(self, category: str, name: str) -> dict:
        """A part's category and name, and the recipes that use it."""
        if name not in self.list_components(category)[category]:
            raise ValueError(f"no {name!r} among {category}")
        return {"category": category, "name": name, "recipes": sorted(r for r, spec in neural.RECIPES.items() if name in [x for v in spec.values() for x in (v if isinstance(v, (list, tuple)) else [v])])}

    def all_findings(self) -> list[dict]:
        return [asdict(e) | {"id": e.id} for e in self.log.of_kind("finding")]

    def audit_trail(self, most: int = 50) -> list[dict]:
        """The latest steps, oldest first."""
        return sorted(self.log.trace, key=lambda t: t["ts"])[-most:]

    def session_info(self) -> dict:
        return {"state": self.state, "graph": self.graph.name if self.graph else None, "methods": sorted(self.methods), "mode": self.gate.mode if self.gate else None, "overrides": len(self.weights.overrides) if self.weights else 0} | self.log.summary()
