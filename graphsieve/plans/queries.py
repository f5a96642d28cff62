"""The registered queries over the relational tables, and DuckDB SQL that must return the same rows.

Two graphs are derived from the tables: parts that share an order (``part_graph``), and those that share two.
Score tables for the diagnosis and fusion queries come from part columns, so that both engines can make them.
Results are rounded to six places, since sums differ in their last bits.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphsieve import catalog
from graphsieve.functions.stats import histogram, ks_statistic, long_form, min_max, norm, ordinal_rank, percentile_rank
from graphsieve.graph import Derived, Graph, label_propagation
from graphsieve.operators import detectors, evaluate, explore, forest, fusion, neural, replay, sampling, study
from graphsieve.sources.store import ResultStore
from graphsieve.sources.tables import embedding_nodes, keep, part_graph, shared_folder, table, user_graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that checks it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, without a negative zero."""
    return df.select(*((F.round(F.col(c), 6) + 0.0).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes))


def base(least: int) -> str:
    return f"""
WITH own AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
pairs AS (SELECT x.l_partkey AS a, y.l_partkey AS b FROM own x JOIN own y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey GROUP BY 1, 2 HAVING count(*) >= {least}),
edges AS (SELECT a AS src, b AS dst FROM pairs UNION ALL SELECT b, a FROM pairs),
means AS (SELECT l_partkey, avg(l_quantity) AS q, avg(l_extendedprice) AS e, avg(l_discount) AS d, avg(l_tax) AS t FROM lineitem GROUP BY 1),
nodes AS (SELECT p_partkey AS node_id, [p_size::DOUBLE, p_retailprice::DOUBLE, coalesce(q, 0)::DOUBLE, coalesce(e, 0)::DOUBLE, coalesce(d, 0)::DOUBLE, coalesce(t, 0)::DOUBLE] AS f, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT) AS community FROM part LEFT JOIN means ON p_partkey = l_partkey),
deg AS (SELECT node_id, coalesce(c, 0)::BIGINT AS degree FROM nodes LEFT JOIN (SELECT src, count(*) AS c FROM edges GROUP BY 1) ON src = node_id),
feat AS (SELECT node_id, unnest(range(6)) AS dim, unnest(f) AS v FROM nodes),
scores AS (SELECT 'price' AS paradigm, node_id, f[2] AS score FROM nodes UNION ALL SELECT 'quantity', node_id, f[3] FROM nodes UNION ALL SELECT 'revenue', node_id, f[4] FROM nodes UNION ALL SELECT 'size', node_id, f[1] FROM nodes),
ranked AS (SELECT *, (rank() OVER (PARTITION BY paradigm ORDER BY score) + (count(*) OVER (PARTITION BY paradigm, score) - 1) / 2.0) / count(*) OVER (PARTITION BY paradigm) AS r FROM scores)"""


TRI = """,
tri AS (SELECT p.a AS x, p.b AS y, q.b AS z FROM pairs p JOIN pairs q ON q.a = p.b JOIN pairs s ON s.a = p.a AND s.b = q.b),
tv AS (SELECT node_id, count(*) AS c FROM (SELECT x AS node_id FROM tri UNION ALL SELECT y FROM tri UNION ALL SELECT z FROM tri) GROUP BY 1),
t3 AS (SELECT node_id, coalesce(c, 0)::BIGINT AS triangles, degree, CASE WHEN degree < 2 THEN 0.0 ELSE 2.0 * coalesce(c, 0) / (degree * (degree - 1)) END AS clustering FROM deg LEFT JOIN tv USING (node_id))"""
NEAR = """,
nm AS (SELECT src AS node_id, dim, avg(v) AS m FROM edges JOIN feat ON feat.node_id = dst GROUP BY 1, 2),
far AS (SELECT feat.node_id, sqrt(sum((v - m) * (v - m))) AS distance FROM feat JOIN nm USING (node_id, dim) GROUP BY 1)"""
#: Scales ``raw`` (node_id, score) to 0..1.
SCALED = "SELECT node_id, round(CASE WHEN hi - lo < 1e-10 THEN 0.0 ELSE (score - lo) / (hi - lo) END, 6) + 0.0 AS score FROM raw, (SELECT min(score) AS lo, max(score) AS hi FROM raw)"
KNN = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings WHERE embedding IS NOT NULL),
d AS (SELECT a.vec_id AS node_id, b.vec_id AS other, sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM v a, v b),
near AS (SELECT node_id, other, d, row_number() OVER (PARTITION BY node_id ORDER BY d, other) AS place FROM d WHERE node_id <> other)"""
LABELLED = """
WITH rows AS (SELECT n_chars::DOUBLE AS score, doc_id AS node_id, (toxic > 0)::BIGINT AS y FROM documents JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id) WHERE toxic IS NOT NULL)"""


def parts(spark: SparkSession, d: str, least: int = 2) -> Graph:
    """The graph of parts; what is asked of it is derived once."""
    g = part_graph(spark, d, least)
    return Derived(g.nodes, g.edges, g.name)


def part_scores(spark: SparkSession, d: str) -> DataFrame:
    """paradigm, node_id, score from part columns."""
    n = part_graph(spark, d).nodes
    one = lambda name, i: F.struct(F.lit(name).alias("paradigm"), F.col("features")[i].alias("score"))
    return n.select("node_id", F.explode(F.array(one("price", 1), one("quantity", 2), one("revenue", 3), one("size", 0))).alias("s")).select("s.paradigm", "node_id", "s.score")


def doc_rows(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").groupBy(F.col("doc_id").alias("node_id")).agg(F.max("toxic").alias("label"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("node_id"), F.col("n_chars").cast("double").alias("score"))
    return evaluate.labelled(docs, labels)


# --- graph ---------------------------------------------------------------------------------------------------------


@query(base(1) + " SELECT a::BIGINT AS a, b::BIGINT AS b FROM pairs")
def edge_build(spark, d):
    return part_graph(spark, d, 1).undirected


@query(base(1) + " SELECT min(degree)::BIGINT AS min_degree, max(degree)::BIGINT AS max_degree, round(avg(degree), 6) AS mean_degree, round(quantile_cont(degree, 0.5), 6) AS median_degree, round(stddev_pop(degree), 6) AS std_degree, round(quantile_cont(degree, 0.9), 6) AS p90, round(quantile_cont(degree, 0.95), 6) AS p95, round(quantile_cont(degree, 0.99), 6) AS p99 FROM deg")
def degree_stats(spark, d):
    return rounded(explore.degree_stats(parts(spark, d, 1)))


@query(base(1) + ", e AS (SELECT min(degree)::DOUBLE AS mn, max(degree)::DOUBLE AS mx FROM deg) SELECT bin::BIGINT AS bin, round(mn + (mx - mn) / 20 * bin, 6) AS lo, round(mn + (mx - mn) / 20 * (bin + 1), 6) AS hi, count(degree)::BIGINT AS n FROM e CROSS JOIN range(20) t(bin) LEFT JOIN deg ON least(floor((degree - mn) / (mx - mn) * 20), 19) = bin GROUP BY bin, mn, mx")
def degree_histogram(spark, d):
    return rounded(histogram(parts(spark, d, 1).degrees, "degree", 20))


@query(base(2) + TRI + " SELECT node_id, triangles, degree, round(clustering, 6) AS clustering FROM t3")
def triangle_count(spark, d):
    return rounded(parts(spark, d).triangles.select("node_id", "triangles", "degree", "clustering"))


@query(base(2) + TRI + ", raw AS (SELECT node_id, triangles * clustering AS score FROM t3) " + SCALED)
def clique_density(spark, d):
    return rounded(detectors.clique_density(parts(spark, d)))


@query(base(2) + " SELECT node_id FROM nodes WHERE node_id NOT IN (SELECT src FROM edges)")
def isolated_nodes(spark, d):
    g = parts(spark, d)
    return g.nodes.select("node_id").join(g.edges.select(F.col("src").alias("node_id")), "node_id", "left_anti")


@query(base(2) + " SELECT x.src, count(DISTINCT y.dst)::BIGINT AS reached FROM edges x JOIN edges y ON x.dst = y.src WHERE x.src <> y.dst GROUP BY 1")
def two_hop_pairs(spark, d):
    return parts(spark, d).two_hop().groupBy("src").agg(F.count("*").alias("reached"))


@query(base(1) + " SELECT count(*)::BIGINT AS n, (SELECT count(*) FROM edges)::BIGINT AS m, round((SELECT count(*) FROM edges) / count(*), 6) AS avg_degree, round(2.0 * (SELECT count(*) FROM edges) / (count(*) * (count(*) - 1)), 6) AS density FROM nodes")
def density_profile(spark, d):
    g = parts(spark, d, 1)
    m = g.edges.agg(F.count("*").alias("m"))
    both = g.nodes.agg(F.count("*").alias("n")).crossJoin(F.broadcast(m))  # one row each
    return rounded(both.select("n", "m", (F.col("m") / F.col("n")).alias("avg_degree"), (2 * F.col("m") / (F.col("n") * (F.col("n") - 1))).alias("density")))


COMM = ", ce AS (SELECT x.community AS cs, y.community AS cd FROM edges JOIN nodes x ON x.node_id = src JOIN nodes y ON y.node_id = dst)"


@query(base(1) + COMM + " SELECT round(avg((cs = cd)::INT), 6) AS homophily FROM ce")
def community_homophily(spark, d):
    return rounded(explore.homophily(parts(spark, d, 1)))


@query(base(1) + COMM + " SELECT community, sum((cs = cd)::INT)::BIGINT AS inside, count(*)::BIGINT AS touching, round(sum((cs = cd)::INT) / count(*), 6) AS homophily FROM (SELECT cs, cd, unnest(list_distinct([cs, cd])) AS community FROM ce) GROUP BY 1")
def per_community_homophily(spark, d):
    return rounded(explore.community_homophily(parts(spark, d, 1)))


@query(base(1) + " SELECT community, count(*)::BIGINT AS size FROM nodes GROUP BY 1")
def community_sizes(spark, d):
    return explore.community_sizes(parts(spark, d, 1))


@query(base(1) + """, pc AS (SELECT x.community AS ca, y.community AS cb FROM pairs JOIN nodes x ON x.node_id = a JOIN nodes y ON y.node_id = b),
 dc AS (SELECT c, count(*) AS d FROM (SELECT ca AS c FROM pc UNION ALL SELECT cb FROM pc) GROUP BY 1), lc AS (SELECT ca AS c, count(*) AS l FROM pc WHERE ca = cb GROUP BY 1)
 SELECT round(sum(coalesce(l, 0) / m - pow(d / (2.0 * m), 2)), 6) + 0.0 AS modularity FROM dc LEFT JOIN lc USING (c), (SELECT count(*)::DOUBLE AS m FROM pc)""")
def modularity_given_partition(spark, d):
    return rounded(explore.modularity(parts(spark, d, 1)))


@query(base(1) + " SELECT src, dst FROM edges WHERE src IN (SELECT node_id FROM nodes WHERE community = 11) AND dst IN (SELECT node_id FROM nodes WHERE community = 11)")
def induced_subgraph(spark, d):
    g = parts(spark, d, 1)
    return g.induced(g.nodes.where("community = 11"))


@query()
def label_propagation_communities(spark, d):
    g = user_graph(spark, d)
    return label_propagation(g).groupBy("community").agg(F.count("*").alias("size"))


# --- detectors -----------------------------------------------------------------------------------------------------


@query(base(2) + """, un AS (SELECT node_id, list_transform(f, lambda z: z / greatest(sqrt(list_sum(list_transform(f, lambda w: w * w))), 1e-8)) AS u FROM nodes),
 near AS (SELECT src AS node_id, avg(list_dot_product(x.u, y.u)) AS s FROM edges JOIN un x ON x.node_id = src JOIN un y ON y.node_id = dst GROUP BY 1),
 raw AS (SELECT nodes.node_id, coalesce(1 - s, 1.0) AS score FROM nodes LEFT JOIN near USING (node_id)) """ + SCALED)
def local_affinity(spark, d):
    return rounded(detectors.local_affinity(parts(spark, d)))


@query(base(2) + NEAR + ", raw AS (SELECT nodes.node_id, coalesce(distance, (SELECT coalesce(quantile_cont(distance, 0.5), 0.5) FROM far)) AS score FROM nodes LEFT JOIN far USING (node_id)) " + SCALED)
def neighbor_mean_distance(spark, d):
    return rounded(detectors.homophily_violation(parts(spark, d)))


@query(base(2) + """, s AS (SELECT node_id, sqrt(list_sum(list_transform(f, lambda w: w * w))) AS s FROM nodes),
 p1 AS (SELECT s.node_id, coalesce(m, 0) AS p FROM s LEFT JOIN (SELECT src, avg(s) AS m FROM edges JOIN s ON node_id = dst GROUP BY 1) ON src = node_id),
 p2 AS (SELECT src AS node_id, avg(p) AS p FROM edges JOIN p1 ON node_id = dst GROUP BY 1),
 raw AS (SELECT s.node_id, 0.5 * abs(s - p1.p) + 0.5 * abs(s - coalesce(p2.p, 0)) AS score FROM s JOIN p1 USING (node_id) LEFT JOIN p2 USING (node_id)) """ + SCALED)
def spectral_residual(spark, d):
    return rounded(detectors.spectral_residual(parts(spark, d)))


@query(base(2) + """, cen AS (SELECT community, dim, avg(v) AS c, count(*) AS n FROM feat JOIN nodes USING (node_id) GROUP BY 1, 2),
 fr AS (SELECT node_id, community, CASE WHEN max(n) < 2 THEN 0 ELSE sqrt(sum((v - c) * (v - c))) END AS x, max(n) AS n FROM feat JOIN nodes USING (node_id) JOIN cen USING (community, dim) GROUP BY 1, 2),
 raw AS (SELECT node_id, x / CASE WHEN n < 2 THEN 1 ELSE greatest(u, 1e-8) END AS score FROM fr JOIN (SELECT community, avg(x) AS u FROM fr GROUP BY 1) USING (community)) """ + SCALED)
def community_deviation(spark, d):
    return rounded(detectors.community(parts(spark, d)))


@query(base(2) + """, va AS (SELECT dim, count(*) AS n FROM feat GROUP BY 1 HAVING stddev_pop(v) > 1e-12),
 o AS (SELECT node_id, (row_number() OVER (PARTITION BY dim ORDER BY v, node_id) - 1) / greatest(n - 1, 1) AS r FROM feat JOIN va USING (dim)),
 raw AS (SELECT node_id, avg(r) AS score FROM o GROUP BY 1) """ + SCALED)
def attribute_inflation(spark, d):
    return rounded(detectors.attribute_inflation(parts(spark, d)))


@query(KNN + " SELECT node_id, other, place::BIGINT AS place, round(d, 6) AS d FROM near WHERE place <= 10")
def knn_topk(spark, d):
    found = detectors.neighbours(embedding_nodes(spark, d), 10, with_self=False)
    return rounded(found.select("node_id", "other", "place", "d"))


@query(KNN + """, nk AS (SELECT * FROM near WHERE place <= 20), kd AS (SELECT node_id AS other, max(d) AS kd FROM nk GROUP BY 1),
 l AS (SELECT node_id, 1 / (avg(greatest(kd, d)) + 1e-10) AS lrd FROM nk JOIN kd USING (other) GROUP BY 1),
 raw AS (SELECT nk.node_id, avg(o.lrd) / max(s.lrd) AS score FROM nk JOIN l o ON o.node_id = nk.other JOIN l s ON s.node_id = nk.node_id GROUP BY 1) """ + SCALED)
def lof(spark, d):
    nodes = embedding_nodes(spark, d)
    return rounded(detectors.density(Graph(nodes, spark.createDataFrame([], "src long, dst long"))))


@query("""
WITH k AS (SELECT CAST(floor(epoch(ts) / 600) AS BIGINT) AS slot, user_id, event_type FROM events), s AS (SELECT DISTINCT * FROM k),
pairs AS (SELECT DISTINCT x.user_id AS a, y.user_id AS b FROM s x JOIN s y ON x.event_type = y.event_type AND x.slot = y.slot AND x.user_id < y.user_id)
SELECT a, b FROM pairs""")
def user_pairs(spark, d):
    return user_graph(spark, d).undirected


@query("""
WITH k AS (SELECT CAST(floor(epoch(ts) / 600) AS BIGINT) AS slot, user_id, event_type FROM events), s AS (SELECT DISTINCT * FROM k),
pairs AS (SELECT DISTINCT x.user_id AS a, y.user_id AS b FROM s x JOIN s y ON x.event_type = y.event_type AND x.slot = y.slot AND x.user_id < y.user_id),
edges AS (SELECT a AS src, b AS dst FROM pairs UNION ALL SELECT b, a FROM pairs),
u AS (SELECT user_id AS node_id, coalesce(avg(value), 0)::DOUBLE AS m, coalesce(max(value), 0)::DOUBLE AS x FROM events GROUP BY 1),
c AS (SELECT node_id, t.event_type, count(e.event_id)::DOUBLE AS n FROM u CROSS JOIN (SELECT DISTINCT event_type FROM events) t LEFT JOIN events e ON e.user_id = node_id AND e.event_type = t.event_type GROUP BY 1, 2),
nodes AS (SELECT node_id, list_concat(list(n ORDER BY event_type), [any_value(m), any_value(x)]) AS f FROM c JOIN u USING (node_id) GROUP BY 1),
feat AS (SELECT node_id, unnest(range(len(f))) AS dim, unnest(f) AS v FROM nodes)""" + NEAR + """,
d AS (SELECT x.node_id, y.node_id AS other, sqrt(list_sum(list_transform(list_zip(x.f, y.f), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM nodes x, nodes y),
attr AS (SELECT node_id, avg(d) AS attr FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY d, other) AS place FROM d) WHERE place <= least(10, (SELECT count(*) - 1 FROM nodes)) GROUP BY 1),
both_ AS (SELECT node_id, attr, coalesce(distance, avg(CASE WHEN distance IS NULL THEN attr END) OVER ()) AS struct FROM attr LEFT JOIN far USING (node_id)),
raw AS (SELECT node_id, abs(row_number() OVER (ORDER BY attr, node_id) - row_number() OVER (ORDER BY struct, node_id))::DOUBLE AS score FROM both_) """ + SCALED)
def attr_struct_mismatch(spark, d):
    return rounded(detectors.attr_struct_mismatch(user_graph(spark, d)))


@query()
def peripheral_mismatch(spark, d):
    return rounded(detectors.peripheral_mismatch(user_graph(spark, d)))


@query()
def conformity(spark, d):
    return rounded(detectors.conformity(parts(spark, d)))


@query()
def spectral(spark, d):
    return rounded(detectors.spectral(user_graph(spark, d)))


def _neural(name):
    def run(spark, d):
        return rounded(neural.NEURAL[name](user_graph(spark, d)))

    run.__name__ = f"neural_{name}"
    return run


for _name in neural.NEURAL:
    query()(_neural(_name))


@query()
def composed_method(spark, d):
    return rounded(neural.train_method(user_graph(spark, d), neural.RECIPES["gad_nr"]))


@query()
def isolation_conformity(spark, d):
    return rounded(forest.isolation_conformity(parts(spark, d)))


def picked(step: int) -> str:
    """SQL for the number that ``sampling.choice`` gives."""
    return f"('0x' || substr(md5('7:' || sample || ':{step}'), 1, 8))::BIGINT % n"


WALKS = """,
nb AS (SELECT src AS node, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS number, count(*) OVER (PARTITION BY src) AS n FROM edges),
s0 AS (SELECT node_id AS sample, node_id AS node FROM nodes),""" + ",".join(f"""
s{k} AS (SELECT sample, dst AS node FROM (SELECT DISTINCT sample, s.node, {picked(k)} AS number FROM s{k - 1} s JOIN nb USING (node)) JOIN nb USING (node, number))""" for k in (1, 2, 3)) + """,
walked AS (SELECT sample, 0 AS place, node FROM s0 UNION ALL SELECT sample, 1, node FROM s1 UNION ALL SELECT sample, 2, node FROM s2 UNION ALL SELECT sample, 3, node FROM s3)"""


@query(base(2) + WALKS + " SELECT sample, place::BIGINT AS place, node FROM walked")
def sampled_walks(spark, d):
    return rounded(sampling.walks(parts(spark, d), seed=7))


@query(base(2) + WALKS + ", inside AS (SELECT DISTINCT sample, node FROM walked) SELECT x.sample, src, dst FROM inside x JOIN edges ON src = x.node JOIN inside y ON y.sample = x.sample AND y.node = dst")
def sampled_subgraphs(spark, d):
    g = parts(spark, d)
    return rounded(sampling.induced(g, sampling.walks(g, seed=7)).select("sample", "src", "dst"))


@query()
def spectral_gap(spark, d):
    found = explore.spectral_gap(user_graph(spark, d))
    return spark.createDataFrame([(round(found["spectral_gap"], 6), found["size"])], "spectral_gap double, size string")


@query(base(1) + """, m AS (SELECT count(*)::BIGINT AS n, (SELECT count(*) FROM edges)::BIGINT AS m FROM nodes), sd AS (SELECT avg(s) AS s FROM (SELECT stddev_samp(v) AS s FROM feat GROUP BY dim)),
 dup AS (SELECT sum(CASE WHEN k > 1 THEN k ELSE 0 END)::DOUBLE / sum(k) AS r FROM (SELECT count(*) AS k FROM nodes GROUP BY list_transform(f, lambda z: round(z, 6))))
 SELECT n AS num_nodes, m AS num_edges, round(m / (n * (n - 1)), 6) AS density, round((SELECT avg(degree) FROM deg), 2) AS avg_degree, (SELECT max(degree) FROM deg)::BIGINT AS max_degree, round((SELECT stddev_samp(degree) FROM deg), 2) AS degree_std, 6::BIGINT AS feature_dim,
 round((SELECT avg((v = 0)::INT) FROM feat), 4) AS feature_sparsity, round(s, 4) AS feature_std_mean, round(r, 4) AS feature_dup_rate, ((SELECT max(degree) FROM deg) > 10 * (SELECT list_sort(list(degree), 'DESC')[n // 2 + 1] FROM deg))::BIGINT AS is_power_law FROM m, sd, dup""")
def component_profile(spark, d):
    """The profile by which parts of methods are recommended, without its homophily (label propagation)."""
    return rounded(explore.component_profile(parts(spark, d, 1)))


# --- features ------------------------------------------------------------------------------------------------------


@query(base(1) + " SELECT round(avg((v = 0)::INT), 6) AS feature_sparsity FROM feat")
def feature_sparsity(spark, d):
    return rounded(long_form(parts(spark, d, 1).nodes).agg(F.avg(F.when(F.col("value") == 0, 1.0).otherwise(0.0)).alias("feature_sparsity")))


@query("WITH c AS (SELECT lang, n_chars, count(*) AS k FROM documents GROUP BY 1, 2) SELECT round(sum(CASE WHEN k > 1 THEN k ELSE 0 END) / sum(k), 6) AS feature_dup_rate FROM c")
def feature_dup_rate(spark, d):
    codes = F.array(F.hash("lang").cast("double"), F.col("n_chars").cast("double"))
    nodes = table(spark, d, "documents").select(F.col("doc_id").alias("node_id"), codes.alias("features"))
    return rounded(explore.duplicate_rate(Graph(nodes, spark.createDataFrame([], "src long, dst long"))))


@query(base(1) + """, e AS (SELECT dim, min(v) AS mn, max(v) AS mx FROM feat GROUP BY 1 HAVING stddev_pop(v) >= 1e-10),
 b AS (SELECT dim, least(floor((v - mn) / (mx - mn) * 20), 19) AS bin, count(*) AS n FROM feat JOIN e USING (dim) GROUP BY 1, 2)
 SELECT dim::BIGINT AS dim, round(-sum(n / t * log2(n / t)), 6) + 0.0 AS entropy FROM b JOIN (SELECT dim, sum(n) AS t FROM b GROUP BY 1) USING (dim) GROUP BY 1""")
def feature_entropy(spark, d):
    long = long_form(parts(spark, d, 1).nodes)
    varied = long.groupBy("dim").agg(F.stddev_pop("value").alias("sd")).where("sd >= 1e-10").select("dim")
    return rounded(explore.bin_entropy(histogram(long.join(varied, "dim"), "value", 20, ["dim"]), ["dim"]))


@query(base(1) + " SELECT round(avg(s), 6) AS mean_norm, round(stddev_pop(s), 6) AS std_norm FROM (SELECT sqrt(list_sum(list_transform(f, lambda w: w * w))) AS s FROM nodes)")
def l2_norm_stats(spark, d):
    return rounded(parts(spark, d, 1).nodes.agg(F.avg(norm("features")).alias("mean_norm"), F.stddev_pop(norm("features")).alias("std_norm")))


@query("SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) + 0.0 AS cosine FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id WHERE x.label = 3 AND y.label = 3")
def pairwise_cosine(spark, d):
    nodes = embedding_nodes(spark, d)
    return rounded(explore.pairwise_cosine(nodes, nodes.where("label = 3")))


# --- scores --------------------------------------------------------------------------------------------------------


@query(base(1) + " SELECT paradigm, node_id, round(r, 6) AS r FROM ranked")
def percentile_ranks(spark, d):
    s = part_scores(spark, d)
    return rounded(s.select("paradigm", "node_id", percentile_rank("score", ["paradigm"]).alias("r")))


@query(base(1) + " SELECT paradigm, node_id, (row_number() OVER (PARTITION BY paradigm ORDER BY score, node_id) - 1)::BIGINT AS place FROM scores")
def ordinal_ranks(spark, d):
    return rounded(part_scores(spark, d).select("paradigm", "node_id", ordinal_rank("score", ["paradigm"]).alias("place")))


@query(base(1) + " SELECT paradigm, node_id, round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w), 6) + 0.0 AS score FROM scores WINDOW w AS (PARTITION BY paradigm)")
def minmax(spark, d):
    return rounded(min_max(part_scores(spark, d), "score", ["paradigm"]).select("paradigm", "node_id", "score"))


@query(base(1) + " SELECT paradigm, " + ", ".join(f"round(quantile_cont(score, {q / 100}), 6) AS p{q}" for q in (10, 25, 50, 75, 90, 95, 99)) + " FROM scores GROUP BY 1")
def score_percentiles(spark, d):
    return rounded(explore.score_percentiles(part_scores(spark, d)))


@query(base(1) + """, c AS (SELECT paradigm, avg(score) AS mean, stddev_pop(score) AS std, quantile_cont(score, 0.9) AS p90, quantile_cont(score, 0.95) AS p95, quantile_cont(score, 0.99) AS p99 FROM scores GROUP BY 1)
 SELECT paradigm, round(mean, 6) AS mean, round(std, 6) AS std, round(p90, 6) AS p90, round(p95, 6) AS p95, round(p99, 6) AS p99, sum((score > p95)::INT)::BIGINT AS above_p95, sum((score > p99)::INT)::BIGINT AS above_p99 FROM scores JOIN c USING (paradigm) GROUP BY ALL""")
def score_stats(spark, d):
    return rounded(explore.score_stats(part_scores(spark, d)))


@query(base(1) + """, e AS (SELECT paradigm, min(score) AS mn, max(score) AS mx FROM scores GROUP BY 1),
 h AS (SELECT e.paradigm, bin, count(score) AS n FROM e CROSS JOIN range(50) t(bin) LEFT JOIN scores s ON s.paradigm = e.paradigm AND least(floor((score - mn) / (mx - mn) * 50), 49) = bin GROUP BY 1, 2),
 p AS (SELECT paradigm, coalesce(n > lag(n) OVER w AND n > lead(n) OVER w, false) AS peak, bin >= 45 AND n > 2 * floor(avg(n) OVER (PARTITION BY paradigm)) AS spike FROM h WINDOW w AS (PARTITION BY paradigm ORDER BY bin))
 SELECT paradigm, sum(peak::INT)::BIGINT AS modes, max(spike::INT)::BIGINT AS tail_spike, (sum(peak::INT) >= 2)::BIGINT AS bimodal FROM p GROUP BY 1""")
def score_histogram_modes(spark, d):
    return rounded(explore.score_modes(part_scores(spark, d)))


CUT = ", cut AS (SELECT paradigm, quantile_cont(score, 0.95) AS p95, quantile_cont(score, 0.9) AS p90 FROM scores GROUP BY 1)"


@query(base(1) + CUT + " SELECT paradigm, node_id, round(score, 6) AS score FROM scores JOIN cut USING (paradigm) WHERE score > p95")
def tail_nodes(spark, d):
    s = part_scores(spark, d)
    cut = s.groupBy("paradigm").agg(F.percentile("score", 0.95).alias("p95"))
    return rounded(s.join(cut, "paradigm").where("score > p95").select("paradigm", "node_id", "score"))


@query(base(1) + CUT + " SELECT paradigm, count(*)::BIGINT AS n_tail, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(max(p95 - p90), 6) AS gap FROM scores JOIN cut USING (paradigm) WHERE score > p95 GROUP BY 1")
def tail_gap(spark, d):
    return rounded(explore.tail(part_scores(spark, d)).select("paradigm", "n_tail", "mean", "std", "gap"))


@query("""WITH r AS (SELECT lang, n_chars AS v, (source = 'src0')::INT AS f FROM documents), s AS (SELECT lang, v, sum(f) AS a, sum(1 - f) AS b FROM r GROUP BY 1, 2),
 g AS (SELECT lang, abs(sum(a) OVER w / nullif(sum(a) OVER t, 0) - sum(b) OVER w / nullif(sum(b) OVER t, 0)) AS gap FROM s WINDOW w AS (PARTITION BY lang ORDER BY v), t AS (PARTITION BY lang))
 SELECT lang, round(max(gap), 6) AS ks FROM g GROUP BY 1""")
def ks(spark, d):
    rows = table(spark, d, "documents").select("lang", "n_chars", (F.col("source") == "src0").alias("f"))
    return rounded(ks_statistic(rows, "n_chars", "f", ["lang"]).select("lang", "ks"))


@query(base(1) + """, c AS (SELECT paradigm, quantile_cont(score, 0.9) AS p FROM scores GROUP BY 1),
 s AS (SELECT paradigm, count(*) AS n, avg(score) FILTER (score > p) AS mt, avg(score) FILTER (score <= p) AS mb, stddev_pop(score) FILTER (score > p) AS st, stddev_pop(score) FILTER (score <= p) AS sb, count(*) FILTER (score > p) AS nt, count(*) FILTER (score <= p) AS nb FROM scores JOIN c USING (paradigm) GROUP BY 1)
 SELECT paradigm, round(CASE WHEN n >= 20 AND nt >= 2 AND nb >= 2 THEN greatest(0, least(1, 0.4 * least((mt - mb) / greatest(sb, 1e-10) / 5, 1) + 0.4 + 0.2 / (1 + st / greatest(mt, 1e-10)))) ELSE 0 END, 6)::DOUBLE AS tail_separation FROM s""")
def tail_separation(spark, d):
    return rounded(fusion.tail_separation(part_scores(spark, d)))


@query(base(1) + """, m AS (SELECT paradigm, avg(score) AS mu FROM scores GROUP BY 1), c AS (SELECT paradigm, avg(pow(score - mu, 2)) AS m2, avg(pow(score - mu, 3)) AS m3, avg(pow(score - mu, 4)) AS m4 FROM scores JOIN m USING (paradigm) GROUP BY 1)
 SELECT paradigm, round((pow(m3 / pow(m2, 1.5), 2) + 1) / (m4 / (m2 * m2)), 6) AS bimodality FROM c""")
def bimodality(spark, d):
    return rounded(fusion.bimodality(part_scores(spark, d)))


@query(base(2) + " SELECT paradigm, round(corr(score, degree), 6) + 0.0 AS rho, (abs(corr(score, degree)) > 0.7)::BIGINT AS artifact FROM scores JOIN deg USING (node_id) GROUP BY 1")
def pearson_degree(spark, d):
    return rounded(explore.degree_correlation(part_scores(spark, d), parts(spark, d).degrees))


PAIRS = ", sp AS (SELECT x.paradigm AS a, y.paradigm AS b, corr(x.r, y.r) AS rho FROM ranked x JOIN ranked y ON x.node_id = y.node_id AND x.paradigm < y.paradigm GROUP BY 1, 2)"


@query(base(1) + PAIRS + " SELECT a, b, round(rho, 6) + 0.0 AS rho FROM sp")
def spearman_matrix(spark, d):
    return rounded(fusion.spearman_pairs(part_scores(spark, d)))


@query(base(1) + PAIRS + " SELECT paradigm, round(1 / greatest(1 + sum(abs(rho)), 1e-8), 6) AS gamma FROM (SELECT a AS paradigm, rho FROM sp UNION ALL SELECT b, rho FROM sp) GROUP BY 1")
def gamma_weights(spark, d):
    return rounded(fusion.gamma(part_scores(spark, d)))


@query(base(1) + " SELECT node_id, round(quantile_cont(r, 0.5), 6) AS consensus FROM ranked GROUP BY 1")
def consensus_rank(spark, d):
    return rounded(fusion.consensus(part_scores(spark, d)))


UED = """, rest AS (SELECT x.paradigm, x.node_id, max(x.r) AS r, quantile_cont(y.r, 0.5) AS e FROM ranked x JOIN ranked y ON x.node_id = y.node_id AND x.paradigm <> y.paradigm GROUP BY 1, 2),
 sd AS (SELECT rest.*, r > p AS side FROM rest JOIN (SELECT paradigm, quantile_cont(r, 0.9) AS p FROM rest GROUP BY 1) USING (paradigm)),
 rk AS (SELECT paradigm, side, rank() OVER (PARTITION BY paradigm, side ORDER BY r) + (count(*) OVER (PARTITION BY paradigm, side, r) - 1) / 2.0 AS rr, rank() OVER (PARTITION BY paradigm, side ORDER BY e) + (count(*) OVER (PARTITION BY paradigm, side, e) - 1) / 2.0 AS re FROM sd),
 ag AS (SELECT paradigm, side, count(*) AS n, CASE WHEN stddev_pop(rr) < 1e-10 OR stddev_pop(re) < 1e-10 THEN 0 ELSE coalesce(corr(rr, re), 0) END AS rho FROM rk GROUP BY 1, 2),
 ued AS (SELECT paradigm, coalesce(max(0.6 * greatest(0, rho)) FILTER (side AND n > 5), 0) + coalesce(max(0.4 * (1 - abs(rho))) FILTER (NOT side AND n > 20), 0) AS ued FROM ag GROUP BY 1)"""


@query(base(1) + UED + " SELECT paradigm, round(ued, 6) AS ued FROM ued")
def ued_quality(spark, d):
    return rounded(fusion.ued(part_scores(spark, d)))


@query(base(1) + UED + """, con AS (SELECT node_id, quantile_cont(r, 0.5) AS c FROM ranked GROUP BY 1), rc AS (SELECT node_id, rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2.0 AS rc FROM con),
 ro AS (SELECT paradigm, corr(r, rc) AS rho FROM ranked JOIN rc USING (node_id) GROUP BY 1), ov AS (SELECT paradigm, avg((score > p)::INT) AS over FROM scores JOIN (SELECT paradigm, quantile_cont(score, 0.9) AS p FROM scores GROUP BY 1) USING (paradigm) GROUP BY 1)
 SELECT paradigm, round(rho, 6) + 0.0 AS rho, round(exp(-3 * greatest(0, over - 0.1)), 6) AS sparsity, (CASE WHEN rho < -0.05 OR (rho < 0.05 AND ued < 0.2) THEN 0 ELSE 1 END)::BIGINT AS delta FROM ro JOIN ov USING (paradigm) JOIN ued USING (paradigm)""")
def select_prune(spark, d):
    return rounded(fusion.prune(part_scores(spark, d)))


#: Average rank of a column within groups, from 1.
AVERAGE = "rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0"


def agreement(scores: str, tag: str) -> str:
    """CTEs that end in ``agree_{tag}``: the rank correlation of mean score and median percentile rank."""
    return f""",
r_{tag} AS (SELECT *, ({AVERAGE.format(by="paradigm", x="score")}) / count(*) OVER (PARTITION BY paradigm) AS r FROM {scores}),
m_{tag} AS (SELECT node_id, 1 AS one, avg(score) AS m, quantile_cont(r, 0.5) AS c FROM r_{tag} GROUP BY 1),
k_{tag} AS (SELECT {AVERAGE.format(by="one", x="m")} AS a, {AVERAGE.format(by="one", x="c")} AS b FROM m_{tag}),
agree_{tag} AS (SELECT corr(a, b) AS v FROM k_{tag})"""


@query(base(2) + f""",
pairs_d AS (SELECT paradigm, node_id, score, degree::DOUBLE AS degree FROM scores JOIN deg USING (node_id)),
rk AS (SELECT paradigm, {AVERAGE.format(by="paradigm", x="score")} AS rs, {AVERAGE.format(by="paradigm", x="degree")} AS rd FROM pairs_d),
dr AS (SELECT paradigm, corr(rs, rd) AS rho FROM rk GROUP BY 1),
fit AS (SELECT paradigm, regr_slope(score, degree) AS slope, regr_intercept(score, degree) AS b FROM pairs_d GROUP BY 1),
rest AS (SELECT paradigm, node_id, score - slope * degree - b AS score FROM pairs_d JOIN fit USING (paradigm))""" + agreement("scores", "raw") + agreement("rest", "rest") + """
SELECT 'consistency' AS measure, round(abs(sum(CASE WHEN abs(rho) > 0.1 THEN sign(rho) ELSE 0 END)) / count(*), 6) + 0.0 AS value FROM dr
UNION ALL SELECT 'degree_rho:' || paradigm, round(rho, 6) + 0.0 FROM dr
UNION ALL SELECT 'raw', round(v, 6) + 0.0 FROM agree_raw
UNION ALL SELECT 'residual', round(v, 6) + 0.0 FROM agree_rest""")
def mechanism_test(spark, d):
    found = fusion.mechanism_test(part_scores(spark, d), parts(spark, d).degrees)
    rows = [(k, float(found[k])) for k in ("consistency", "raw", "residual")] + [(f"degree_rho:{p}", float(v)) for p, v in found["degree_rho"].items()]
    return rounded(spark.createDataFrame(rows, "measure string, value double"))


#: r: the ordinal rank as a share from 0 to 1.
SHARE = ", shares AS (SELECT *, (row_number() OVER (PARTITION BY paradigm ORDER BY score, node_id) - 1)::DOUBLE / greatest(count(*) OVER (PARTITION BY paradigm) - 1, 1) AS r FROM scores)"


@query(base(1) + f""",
tail AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paradigm ORDER BY r DESC, node_id DESC) AS place, count(*) OVER (PARTITION BY paradigm) AS n FROM ranked) WHERE place <= n - floor(n * 9 / 10)),
tp AS (SELECT t.paradigm AS a, o.paradigm AS b, t.paradigm || o.paradigm AS ab, t.r AS ra, o.r AS rb FROM tail t JOIN ranked o ON t.node_id = o.node_id AND t.paradigm < o.paradigm),
tr AS (SELECT a, b, {AVERAGE.format(by="ab", x="ra")} AS ra, {AVERAGE.format(by="ab", x="rb")} AS rb FROM tp)
SELECT a, b, round(coalesce(corr(ra, rb), 0), 6) + 0.0 AS rho FROM tr GROUP BY 1, 2""")
def tail_agreement(spark, d):
    return rounded(study.tail_agreement(part_scores(spark, d)))


@query(base(1) + ", x AS (SELECT a.paradigm AS p, b.paradigm AS q, corr(a.r, b.r) AS rho FROM ranked a JOIN ranked b ON a.node_id = b.node_id AND a.paradigm < b.paradigm GROUP BY 1, 2) SELECT round(avg(abs(rho)), 6) AS reliability FROM x")
def consensus_reliability(spark, d):
    return rounded(study.consensus_reliability(part_scores(spark, d)))


@query(base(1) + ", c AS (SELECT paradigm, quantile_cont(score, 0.9) AS p90 FROM scores GROUP BY 1) SELECT paradigm, round((avg(score) FILTER (score > p90) - avg(score) FILTER (score <= p90)) / (stddev_pop(score) FILTER (score <= p90) + 1e-9), 6) AS separation FROM scores JOIN c USING (paradigm) GROUP BY 1")
def probe_tail_separation(spark, d):
    return rounded(study.probe_tail_separation(part_scores(spark, d)))


@query(base(1) + " SELECT paradigm, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.9), 6) AS p90, round(quantile_cont(score, 0.95), 6) AS p95, round(quantile_cont(score, 0.99), 6) AS p99 FROM scores GROUP BY 1")
def landmarkers(spark, d):
    return rounded(study.landmarkers(part_scores(spark, d)))


@query(base(1) + SHARE + ", t AS (SELECT node_id, sum(r) AS total, count(*) AS k FROM shares GROUP BY 1), o AS (SELECT paradigm, node_id, r, round((total - r) / (k - 1), 12) AS others FROM shares JOIN t USING (node_id)), q AS (SELECT paradigm, r, row_number() OVER (PARTITION BY paradigm ORDER BY others, node_id) AS ro FROM o) SELECT paradigm, round(corr(r, ro), 6) + 0.0 AS rho FROM q GROUP BY 1")
def agreement_with_others(spark, d):
    return rounded(study.agreement_with_others(part_scores(spark, d)))


@query(base(1) + SHARE + " SELECT node_id, round(sum(r * CASE paradigm WHEN 'revenue' THEN 1.0 WHEN 'price' THEN 0.5 ELSE 0.25 END) / 1.75, 6) AS fused FROM shares WHERE paradigm IN ('revenue', 'price', 'size') GROUP BY 1")
def fuse_order_decay(spark, d):
    return rounded(study.by_rule("order_decay", part_scores(spark, d), ["revenue", "price", "size"], None))


@query(base(1) + SHARE + " SELECT node_id, round(r, 6) + 0.0 AS fused FROM shares WHERE paradigm = 'quantity'")
def fuse_lead_only(spark, d):
    return rounded(study.by_rule("lead_only", part_scores(spark, d), ["quantity", "size"], None))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events) WHERE k = 1")
def first_decision(spark, d):
    return study.first_of(table(spark, d, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


@query("""WITH a AS (SELECT 'd' || (user_id % 10) AS dataset, list_sort(list_distinct(list(event_type))) AS selected, user_id FROM events GROUP BY 1, 3),
 o AS (SELECT DISTINCT dataset, array_to_string(selected, ',') AS selection FROM a WHERE len(selected) = 1)
 SELECT a.dataset, array_to_string(selected, ',') AS selection, user_id, CASE WHEN o.selection IS NULL THEN 'gate' ELSE 'single' END AS mode, o.selection AS view FROM a LEFT JOIN o ON a.dataset = o.dataset AND array_to_string(selected, ',') = o.selection""")
def adjudicated_decisions(spark, d):
    sets = table(spark, d, "events").groupBy(F.concat(F.lit("d"), (F.col("user_id") % 10).cast("string")).alias("dataset"), "user_id").agg(F.array_sort(F.collect_set("event_type")).alias("selected"))
    answers = sets.where(F.size("selected") == 1).select("dataset", F.concat_ws(",", "selected").alias("selection"), F.lit("single").alias("mode"), F.concat_ws(",", "selected").alias("view")).distinct()
    return study.with_adjudications(sets, answers).select("dataset", "selection", "user_id", "mode", "view")


WIDE = ", w AS (SELECT node_id, max(r) FILTER (paradigm = 'price') AS p, max(r) FILTER (paradigm = 'quantity') AS q, max(r) FILTER (paradigm = 'revenue') AS v, max(r) FILTER (paradigm = 'size') AS s FROM ranked GROUP BY 1)"
SHARES = {"price": 0.4, "quantity": 0.3, "revenue": 0.2, "size": 0.1}


@query(base(1) + WIDE + " SELECT node_id, round(0.4 * p + 0.3 * q + 0.2 * v + 0.1 * s, 6) AS fused FROM w")
def fuse_weighted(spark, d):
    return rounded(fusion.fuse(part_scores(spark, d), SHARES, "fuse"))


@query(base(1) + WIDE + " SELECT node_id, round(greatest(p, q), 6) AS fused FROM w")
def fuse_pairmax(spark, d):
    return rounded(fusion.fuse(part_scores(spark, d), {"price": 1.0, "quantity": 1.0}, "pairmax"))


@query(base(1) + WIDE + " SELECT node_id, round(list_sort([p, q, v])[2], 6) AS fused FROM w")
def fuse_hybrid_median(spark, d):
    return rounded(fusion.fuse(part_scores(spark, d), SHARES, "hybrid"))


@query(base(1) + WIDE + " SELECT node_id, round(p, 6) AS fused FROM w")
def fuse_select(spark, d):
    return rounded(fusion.fuse(part_scores(spark, d), SHARES, "select"))


_groups = fusion.aom_groups([*SHARES])
_short = {"price": "p", "quantity": "q", "revenue": "v", "size": "s"}


@query(base(1) + WIDE + " SELECT node_id, round((" + " + ".join(f"greatest({', '.join(_short[p] for p in g)})" for g in _groups) + f") / {len(_groups)}, 9) AS fused FROM w")
def fuse_aom(spark, d):
    # ranks over so many nodes and groups end in a 5 at the seventh place: rounded further down
    return fusion.fuse(part_scores(spark, d), SHARES, "aom").select("node_id", F.round("fused", 9).alias("fused"))


@query(base(1) + " SELECT node_id, round(sum((score - lo) / (hi - lo + 1e-10) * 0.25), 6) AS fused FROM scores JOIN (SELECT paradigm, min(score) AS lo, max(score) AS hi FROM scores GROUP BY 1) USING (paradigm) GROUP BY 1")
def score_level_fusion(spark, d):
    return rounded(fusion.score_level_fusion(part_scores(spark, d)))


@query(base(1) + CUT + " SELECT node_id, count(*)::BIGINT AS flags, string_agg(paradigm, ',' ORDER BY paradigm) AS flaggers FROM scores JOIN cut USING (paradigm) WHERE score > p95 GROUP BY 1 HAVING count(*) >= 2 ORDER BY flags DESC, node_id LIMIT 50")
def convergent_nodes(spark, d):
    return rounded(explore.convergent(part_scores(spark, d), 2, 50))


@query(base(1) + ", pc AS (SELECT paradigm, node_id, score, 100.0 * (rank() OVER (PARTITION BY paradigm ORDER BY score) - 1) / count(*) OVER (PARTITION BY paradigm) AS percentile FROM scores) SELECT node_id, paradigm, round(score, 6) AS score, round(percentile, 6) AS percentile, (percentile > 90)::BIGINT AS flagged FROM pc WHERE node_id IN (1, 2, 3, 5, 8)")
def node_card(spark, d):
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 8)], "node_id long")
    return rounded(explore.node_view(part_scores(spark, d), ids))


@query(base(1) + """, rows AS (SELECT * FROM scores UNION ALL SELECT 'feature_norm', node_id, sqrt(list_sum(list_transform(f, lambda w: w * w))) FROM nodes),
 g AS (SELECT node_id, CASE community WHEN 11 THEN 'a' ELSE 'b' END AS grp FROM nodes WHERE community IN (11, 22))
 SELECT paradigm, round(avg(score) FILTER (grp = 'a'), 6) AS mean_a, round(avg(score) FILTER (grp = 'b'), 6) AS mean_b, round(avg(score) FILTER (grp = 'a') - avg(score) FILTER (grp = 'b'), 6) + 0.0 AS difference FROM rows JOIN g USING (node_id) GROUP BY 1""")
def compare_groups(spark, d):
    g = parts(spark, d, 1)
    groups = g.nodes.where("community IN (11, 22)").select("node_id", F.when(F.col("community") == 11, "a").otherwise("b").alias("grp"))
    return rounded(explore.compare_groups(part_scores(spark, d), g.nodes, groups))


COSINE = "list_dot_product({a}, {b}) / (greatest(sqrt(list_dot_product({a}, {a})), 1e-8) * greatest(sqrt(list_dot_product({b}, {b})), 1e-8))"


@query(base(1) + f""", ids AS (SELECT node_id, f FROM nodes WHERE community = 11), c AS (SELECT count(*)::BIGINT AS k, (SELECT count(*) FROM pairs WHERE a IN (SELECT node_id FROM ids) AND b IN (SELECT node_id FROM ids))::BIGINT AS e FROM ids)
 SELECT k AS nodes, e AS edges, round(e / (k * (k - 1) / 2), 6) AS density, round((SELECT avg({COSINE.format(a="x.f", b="y.f")}) FROM ids x JOIN ids y ON x.node_id < y.node_id), 6) AS mean_cosine, round((SELECT avg(degree) FROM deg JOIN ids USING (node_id)), 6) AS avg_degree, 1::BIGINT AS communities FROM c""")
def subgraph_stats(spark, d):
    g = parts(spark, d, 1)
    found = explore.subgraph_stats(g, g.nodes.where("community = 11"))
    row = (found["nodes"], found["edges"], found["density"], found["mean_cosine"], found["avg_degree"], len(found["communities"]))
    return rounded(spark.createDataFrame([row], "nodes long, edges long, density double, mean_cosine double, avg_degree double, communities long"))


@query(base(1) + f""", self_ AS (SELECT node_id, f, community FROM nodes WHERE node_id = 5), near AS (SELECT n.node_id, n.f, n.community FROM edges JOIN nodes n ON n.node_id = dst WHERE src = 5),
 per AS (SELECT paradigm, avg(score) AS m, stddev_pop(score) AS s FROM scores JOIN near USING (node_id) GROUP BY 1)
 SELECT paradigm, round(m, 6) AS mean, round(s, 6) AS std, (SELECT count(*) FROM near)::BIGINT AS neighbours, round((SELECT avg({COSINE.format(a="near.f", b="self_.f")}) FROM near, self_), 6) AS cosine, round((SELECT min({COSINE.format(a="near.f", b="self_.f")}) FROM near, self_), 6) AS lowest, (SELECT count(*) FROM near JOIN self_ USING (community))::BIGINT AS same_community FROM per""")
def neighbourhood_probe(spark, d):
    found = explore.neighbourhood(parts(spark, d, 1), part_scores(spark, d), 5)
    rows = [(p, v["mean"], v["std"], found["neighbours"], found["cosine"]["mean"], found["cosine"]["min"], found["same_community"]) for p, v in found.get("scores", {}).items()]
    return rounded(spark.createDataFrame(rows, "paradigm string, mean double, std double, neighbours long, cosine double, lowest double, same_community long"))


@query(base(1) + """ SELECT nodes.node_id, round(sqrt(list_dot_product(f, f)), 6) AS norm, round(len(list_filter(f, lambda x: x = 0)) / 6.0, 6) AS sparsity, degree, community, degree AS neighbours, """ + ", ".join(f"round((SELECT score FROM scores s WHERE s.node_id = nodes.node_id AND paradigm = '{p}'), 6) AS {p}" for p in ("price", "quantity", "revenue", "size")) + " FROM nodes JOIN deg USING (node_id) WHERE nodes.node_id % 50 = 3")
def case_file(spark, d):
    g = parts(spark, d, 1)
    return rounded(explore.case_file(g, part_scores(spark, d), g.nodes.where("node_id % 50 = 3").select("node_id")))


@query(base(1) + ", t AS (SELECT paradigm, community, row_number() OVER (PARTITION BY paradigm ORDER BY score DESC, node_id) AS k FROM scores JOIN nodes USING (node_id)), c AS (SELECT paradigm, community, count(*) AS n FROM t WHERE k <= 50 GROUP BY 1, 2) SELECT paradigm, round(max(n) / sum(n), 6) AS fraction, (max(n) / sum(n) > 0.6)::BIGINT AS artifact FROM c GROUP BY 1")
def community_bias(spark, d):
    return rounded(explore.community_bias(part_scores(spark, d), parts(spark, d, 1).communities))


@query(base(1) + " SELECT paradigm, node_id, round(score, 6) AS score, k::BIGINT AS place FROM (SELECT *, row_number() OVER (PARTITION BY paradigm ORDER BY score DESC, node_id) AS k FROM scores) WHERE k <= 20")
def top_nodes(spark, d):
    return rounded(explore.top(part_scores(spark, d), 20).select("paradigm", "node_id", "score", "place"))


# --- decisions ------------------------------------------------------------------------------------------------------


def correlation(a: str, b: str) -> str:
    """0 where a side is flat."""
    return f"(CASE WHEN stddev_pop({a}) < 1e-10 OR stddev_pop({b}) < 1e-10 THEN 0.0 ELSE coalesce(corr({a}, {b}), 0.0) END)"


def names(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_index_groups = {k: fusion.aom_groups([*range(k)]) for k in range(3, 8)}
_spread = "CASE k " + " ".join(f"WHEN {k} THEN ({' + '.join('greatest(' + ', '.join(f'rs[{i + 1}]' for i in g) + ')' for g in groups)}) / {len(groups)}" for k, groups in _index_groups.items()) + " END"
#: From scores, log (decision, paradigm), deg and nodes (community), and avg_degree: ``weights``, ``gates`` and ``fused``. Every decision is weighed, gated and fused for itself.
REPLAY = f""",
rs0 AS (SELECT s.*, coalesce(degree, 0)::DOUBLE AS degree, size FROM scores s JOIN deg USING (node_id) JOIN (SELECT node_id, count(*) OVER (PARTITION BY community) AS size FROM nodes) USING (node_id)),
fit AS (SELECT paradigm, coalesce(regr_slope(score, degree), 0) AS slope, coalesce(regr_intercept(score, degree), 0) AS base FROM rs0 GROUP BY 1),
rs1 AS (SELECT rs0.*, round(score - slope * degree - base, 9) AS rest FROM rs0 JOIN fit USING (paradigm)),
rs2 AS (SELECT paradigm, node_id, score, rest, ({AVERAGE.format(by="paradigm", x="score")}) / count(*) OVER (PARTITION BY paradigm) AS r, ({AVERAGE.format(by="paradigm", x="rest")}) / count(*) OVER (PARTITION BY paradigm) AS r_rest, {AVERAGE.format(by="paradigm", x="degree")} AS rd, {AVERAGE.format(by="paradigm", x="size")} AS rc FROM rs1),
cuts AS (SELECT paradigm, quantile_cont(score, 0.9) AS p90, quantile_cont(r, 0.9) AS r90, {correlation("r", "rd")} AS rho_d, {correlation("r", "rc")} AS rho_c, CASE WHEN stddev_pop(score) < 1e-10 THEN 0.0 ELSE 1.0 END AS own FROM rs2 GROUP BY 1),
each_ AS (SELECT paradigm, any_value(rho_d) AS rho_d, any_value(rho_c) AS rho_c, any_value(own) AS own, exp(-3 * greatest(0, avg((score > p90)::INT) - 0.1)) AS sparsity,
  CASE WHEN count(*) >= 20 AND count(*) FILTER (score > p90) >= 2 AND count(*) FILTER (score <= p90) >= 2 THEN greatest(0, least(1, 0.4 * least((avg(score) FILTER (score > p90) - avg(score) FILTER (score <= p90)) / greatest(stddev_pop(score) FILTER (score <= p90), 1e-10) / 5, 1) + 0.4 + 0.2 / (1 + stddev_pop(score) FILTER (score > p90) / greatest(avg(score) FILTER (score > p90), 1e-10)))) ELSE 0 END AS tail
  FROM rs2 JOIN cuts USING (paradigm) GROUP BY 1),
two AS (SELECT x.paradigm AS a, y.paradigm AS b, {correlation("x.r", "y.r")} AS rho FROM rs2 x JOIN rs2 y ON x.node_id = y.node_id AND x.paradigm <> y.paradigm GROUP BY 1, 2),
cells AS (SELECT decision, paradigm, node_id, r, score, rest, r_rest, r > r90 AS side FROM log JOIN rs2 USING (paradigm) JOIN cuts USING (paradigm)),
mids AS (SELECT decision, node_id, round(quantile_cont(r, 0.5), 9) AS c, round(avg(score), 9) AS m, round(quantile_cont(r_rest, 0.5), 9) AS c_rest, round(avg(rest), 9) AS m_rest FROM cells GROUP BY 1, 2),
others AS (SELECT x.decision, x.paradigm, x.node_id, any_value(x.r) AS r, any_value(x.side) AS side, round(quantile_cont(y.r, 0.5), 9) AS e FROM cells x LEFT JOIN cells y ON x.decision = y.decision AND x.node_id = y.node_id AND x.paradigm <> y.paradigm GROUP BY 1, 2, 3),
sides AS (SELECT decision, paradigm, side, count(*) AS n, count(e) AS others, {correlation("r", "re")} AS rho FROM (SELECT *, {AVERAGE.format(by="decision, paradigm, side", x="e")} AS re FROM others) GROUP BY 1, 2, 3),
ued AS (SELECT decision, paradigm, CASE WHEN max(others) = 0 THEN 0.5 ELSE coalesce(max(0.6 * greatest(0, rho)) FILTER (side AND n > 5), 0) + coalesce(max(0.4 * (1 - abs(rho))) FILTER (NOT side AND n > 20), 0) END AS ued FROM sides GROUP BY 1, 2),
prunes AS (SELECT decision, paradigm, {correlation("r", "rc")} AS rho FROM (SELECT decision, paradigm, r, {AVERAGE.format(by="decision, paradigm", x="c")} AS rc FROM cells JOIN mids USING (decision, node_id)) GROUP BY 1, 2),
agrees AS (SELECT decision, {correlation("m", "c")} AS raw, {correlation("m_rest", "c_rest")} AS residual FROM (SELECT decision, {", ".join(f"{AVERAGE.format(by='decision', x=x)} AS {x}" for x in ("c", "m", "c_rest", "m_rest"))} FROM mids) GROUP BY 1),
ks AS (SELECT decision, count(*) AS k, abs(sum(CASE WHEN abs(rho_d) > 0.1 THEN sign(rho_d) ELSE 0 END)) / count(*) AS consistency FROM log JOIN each_ USING (paradigm) GROUP BY 1),
flags AS (SELECT decision, k, (consistency >= 0.6 AND (raw - residual) / greatest(abs(raw), 1e-8) > 0.25)::INT AS flagged FROM agrees JOIN ks USING (decision)),
near AS (SELECT x.decision, x.paradigm, sum(abs(rho)) AS near FROM log x JOIN log y ON x.decision = y.decision JOIN two ON a = x.paradigm AND b = y.paradigm GROUP BY 1, 2),
w0 AS (SELECT decision, paradigm, k, ued, tail, rho_d, flagged, coalesce(1 / greatest(own + near, 1e-8), 1.0) AS gamma,
  greatest(0, least(1, ued * sparsity * CASE flagged WHEN 1 THEN 1 - abs(rho_d) ELSE 1 END * (1 - abs(rho_c)))) AS b0,
  CASE WHEN k < 3 OR starts_with(paradigm, 'trained:') THEN 1.0 WHEN rho < -0.05 OR (rho < 0.05 AND ued < 0.2) THEN 0.0 ELSE 1.0 END AS delta
  FROM log JOIN each_ USING (paradigm) JOIN ued USING (decision, paradigm) JOIN prunes USING (decision, paradigm) JOIN flags USING (decision) LEFT JOIN near USING (decision, paradigm)),
w1 AS (SELECT *, CASE WHEN starts_with(paradigm, 'trained:') THEN greatest(b0, 0.3 * tail) ELSE b0 END AS beta FROM w0),
g0 AS (SELECT decision, any_value(k) AS k, list(paradigm ORDER BY paradigm) AS names, list(paradigm ORDER BY ued DESC, paradigm) AS best, max(ued) AS top, list(ued ORDER BY ued DESC, paradigm)[2] AS second, list(tail ORDER BY ued DESC, paradigm)[1] AS top_tail, max(tail) AS tailed,
  quantile_cont(ued, 0.5) AS middle, max(tail) FILTER (starts_with(paradigm, 'trained:')) AS trained, coalesce(max(tail) FILTER (NOT starts_with(paradigm, 'trained:')), 0) AS fast,
  list(paradigm) FILTER (abs(rho_d) < 0.6 AND tail >= 0.3) AS fit FROM w1 GROUP BY 1),
g1 AS (SELECT g0.*, list_filter({names(fusion.TRUSTED)}, lambda t: list_contains(names, t)) AS listed,
  list_filter(CASE WHEN avg_degree >= 8 THEN {names(fusion.COMPANIONS[True])} ELSE {names(fusion.COMPANIONS[False])} END, lambda t: list_contains(coalesce(fit, []), t))[1] AS friend,
  1 - coalesce((SELECT sum(abs(rho)) / 2 FROM two JOIN log x ON x.paradigm = a JOIN log y ON y.paradigm = b AND y.decision = x.decision WHERE x.decision = g0.decision), 0) / greatest(k * (k - 1) / 2, 1) AS d, top / greatest(middle, 0.01) AS q FROM g0, avg_degree),
g2 AS (SELECT *, list_contains(listed, 'clique_density') AS dense, CASE WHEN list_contains(listed, 'clique_density') AND friend IS NOT NULL THEN list_append(listed, friend) ELSE listed END AS picked FROM g1),
g3 AS (SELECT *, k > 1 AND len(listed) > 0 AND NOT (dense AND friend IS NULL) AS trusted FROM g2),
gates AS (SELECT decision, k, d, q, trusted, CASE WHEN k <= 1 THEN 'select' WHEN trusted THEN CASE WHEN len(picked) = 1 THEN 'select' WHEN len(picked) = 2 AND dense THEN 'pairmax' ELSE 'aom' END
  WHEN top >= 2 * second AND top_tail >= tailed THEN 'select' WHEN trained > 1.5 * fast THEN 'fuse' WHEN q > 2.5 THEN 'select' WHEN d > 0.4 AND q < 2 THEN 'aom' WHEN d < 0.3 THEN 'select' ELSE 'hybrid' END AS mode,
  CASE WHEN k <= 1 THEN names WHEN trusted THEN picked WHEN top >= 2 * second AND top_tail >= tailed THEN best[:1] ELSE names END AS stay FROM g3),
weights AS (SELECT *, abs(beta * gamma * final) AS weight FROM (SELECT w1.decision, w1.paradigm, beta, gamma, delta, mode, CASE WHEN trusted THEN list_contains(stay, w1.paradigm)::DOUBLE WHEN NOT list_contains(stay, w1.paradigm) THEN 0.0 ELSE delta END AS final FROM w1 JOIN gates USING (decision))),
active AS (SELECT decision, any_value(mode) AS mode, count(*) FILTER (final <> 0) AS k, coalesce(list(paradigm ORDER BY weight DESC, paradigm) FILTER (final <> 0), []) AS heavy, coalesce(list(paradigm ORDER BY paradigm) FILTER (final <> 0), []) AS act, coalesce(list(weight ORDER BY paradigm) FILTER (final <> 0), []) AS ws FROM weights GROUP BY 1),
held AS (SELECT decision, node_id, map(list(paradigm), list(r)) AS h FROM cells GROUP BY 1, 2),
ranks_ AS (SELECT decision, node_id, mode, k, heavy, ws, list_transform(act, lambda p: coalesce(h[p], 0.0)) AS rs, list_transform(heavy[:3], lambda p: coalesce(h[p], 0.0)) AS hs FROM held JOIN active USING (decision)),
fused AS (SELECT decision, node_id, CASE WHEN k = 0 THEN 0.0 WHEN mode = 'select' THEN hs[1] WHEN mode = 'pairmax' THEN list_max(rs) WHEN mode = 'hybrid' THEN list_aggregate(hs, 'quantile_cont', 0.5) WHEN mode = 'aom' THEN CASE WHEN k <= 2 THEN list_aggregate(rs, 'quantile_cont', 0.5) ELSE {_spread} END
  ELSE CASE WHEN list_sum(ws) >= 1e-8 THEN list_sum(list_transform(list_zip(rs, ws), lambda z: z[1] * z[2])) / list_sum(ws) ELSE 0.0 END END AS fused FROM ranks_)"""
#: Names under which part columns stand as scores, so that a log meets every rule of the gate.
STAND_INS = ["local_affinity", "contrastive", "clique_density", "conformity", "trained:discount", "spectral"]
STAND_IN_SCORES = base(2).replace("\nscores AS", "\nunused AS").replace("\nranked AS", "\nunranked AS").replace("FROM scores)", "FROM unused)") + f""",
scores AS (SELECT {names(STAND_INS)}[dim + 1] AS paradigm, node_id, round(CASE dim WHEN 4 THEN pow(v, 8) ELSE v END, 9) AS score FROM feat),
avg_degree AS (SELECT (SELECT count(*) FROM edges)::DOUBLE / (SELECT count(*) FROM nodes) AS avg_degree)"""
#: A selection of one to six for each of forty groups of users.
USER_LOG = f""",
log AS (SELECT DISTINCT user_id % 40 AS decision, {names(STAND_INS)}[event_id % 6 + 1] AS paradigm FROM events WHERE event_id % 5 = user_id % 7)"""
#: All selections of one to four, numbered by their bits.
MASK_LOG = f""",
log AS (SELECT mask AS decision, {names(STAND_INS)}[bit + 1] AS paradigm FROM range(1, {1 << len(STAND_INS)}) m(mask), range({len(STAND_INS)}) b(bit) WHERE bit_count(mask) <= 4 AND (mask >> bit) & 1 = 1)"""


def stand_in_scores(g: Graph) -> DataFrame:
    long = long_form(g.nodes)
    value = F.when(F.col("dim") == 4, F.pow("value", F.lit(8))).otherwise(F.col("value"))
    return long.select(F.get(F.array(*map(F.lit, STAND_INS)), F.col("dim")).alias("paradigm"), "node_id", F.round(value, 9).alias("score"))


def user_log(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").where("event_id % 5 = user_id % 7")
    return events.select((F.col("user_id") % 40).alias("decision"), F.get(F.array(*map(F.lit, STAND_INS)), (F.col("event_id") % 6).cast("int")).alias("paradigm")).distinct()


def replayed(spark: SparkSession, d: str) -> replay.Replay:
    g = parts(spark, d)
    return replay.replay(stand_in_scores(g), user_log(spark, d), g.degrees, g.communities, g.m / max(1, g.n))


@query(STAND_IN_SCORES + USER_LOG + REPLAY + " SELECT decision, node_id, round(fused, 9) + 0.0 AS fused FROM fused")
def replay_log(spark, d):
    """Every decision of a log at once: its selection's fused ranks."""
    # means of ranks end in a 5 at the seventh place: rounded further down
    return replayed(spark, d).fused.select("decision", "node_id", F.round("fused", 9).alias("fused"))


@query(STAND_IN_SCORES + USER_LOG + REPLAY + " SELECT decision, paradigm, mode, round(beta, 6) + 0.0 AS beta, round(gamma, 6) AS gamma, delta, final, round(weight, 6) + 0.0 AS weight FROM weights")
def replay_weights(spark, d):
    """The weights of every decision and the mode that its gate chose."""
    found = replayed(spark, d)
    return rounded(found.weights.join(found.gates.select("decision", "mode"), "decision").select("decision", "paradigm", "mode", "beta", "gamma", "delta", "final", "weight"))


@query(STAND_IN_SCORES + MASK_LOG + REPLAY + f""",
marked AS (SELECT decision, fused, (f[1] >= 45)::INT AS y FROM fused JOIN nodes USING (node_id)),
placed AS (SELECT *, {AVERAGE.format(by="decision", x="fused")} AS place FROM (SELECT decision, y, round(fused, 9) AS fused FROM marked))
SELECT decision AS mask, round((sum(place) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auroc FROM placed GROUP BY 1""")
def subset_search(spark, d):
    """Every selection of one to four paradigms, replayed and measured against labels (large parts)."""
    g = parts(spark, d)
    scores, labels = stand_in_scores(g), g.nodes.select("node_id", (F.col("features")[0] >= 45).cast("int").alias("label"))
    found = study.subset_search(scores, labels, g.degrees, g.communities, g.m / max(1, g.n), STAND_INS)
    return rounded(found.select("mask", "auroc"))


@query(STAND_IN_SCORES + USER_LOG + REPLAY + " SELECT decision, round(avg(fused), 8) AS mean, round(stddev_pop(fused), 8) AS std, " + ", ".join(f"round(quantile_cont(round(fused, 9), 0.{q}), 8) AS p{q}" for q in (90, 95, 99)) + " FROM fused GROUP BY 1")
def replay_summary(spark, d):
    """What a session says of its fused ranks, for every decision of a log."""
    found = replayed(spark, d)
    fused = found.once.withColumn("fused", F.round("fused", 9))
    return found.given(fused.groupBy("decision").agg(F.round(F.avg("fused"), 8).alias("mean"), F.round(F.stddev_pop("fused"), 8).alias("std"), *(F.round(F.percentile("fused", q / 100), 8).alias(f"p{q}") for q in (90, 95, 99))))


RULED = f""",
spots AS (SELECT decision, paradigm, row_number() OVER (PARTITION BY decision ORDER BY paradigm) - 1 AS place FROM log),
shares AS (SELECT paradigm, node_id, (row_number() OVER (PARTITION BY paradigm ORDER BY score, node_id) - 1)::DOUBLE / greatest(count(*) OVER (PARTITION BY paradigm) - 1, 1) AS r FROM scores),
theirs AS (SELECT spots.*, ued, count(*) OVER (PARTITION BY decision) AS k FROM spots JOIN w1 USING (decision, paradigm) JOIN gates USING (decision) WHERE mode = 'aom'),
agree AS (SELECT x.decision, x.paradigm, greatest(quantile_cont(rho, 0.5), 0) AS near FROM theirs x JOIN theirs y ON x.decision = y.decision JOIN two ON a = x.paradigm AND b = y.paradigm GROUP BY 1, 2),
rules AS (SELECT 'order_decay' AS rule, decision, paradigm, pow(0.5, place) AS w FROM theirs UNION ALL SELECT 'lead_only', decision, paradigm, 1.0 FROM theirs WHERE place = 0
 UNION ALL SELECT 'ued_top1', decision, paradigm, 1.0 FROM theirs QUALIFY row_number() OVER (PARTITION BY decision ORDER BY ued DESC, paradigm) = 1
 UNION ALL SELECT 'agreement_weight', decision, paradigm, CASE WHEN k = 1 THEN 1.0 ELSE coalesce(near, 0) END FROM theirs LEFT JOIN agree USING (decision, paradigm)),
totals AS (SELECT rule, decision, sum(w) AS total FROM rules GROUP BY 1, 2 HAVING sum(w) > 0),
ruled AS (SELECT rule, decision, node_id, sum(r * w / total) AS fused FROM rules JOIN totals USING (rule, decision) JOIN shares USING (paradigm) GROUP BY 1, 2, 3),
every AS (SELECT rule, decision, node_id, fused, true AS ruled FROM ruled UNION ALL SELECT rule, decision, node_id, fused, false FROM (SELECT * FROM fused, (SELECT unnest(['order_decay', 'lead_only', 'ued_top1', 'agreement_weight']) AS rule)) ANTI JOIN totals USING (rule, decision))"""


@query(STAND_IN_SCORES + USER_LOG + REPLAY + RULED + " SELECT rule, decision, node_id, round(fused, 8) + 0.0 AS fused, ruled, row_number() OVER (PARTITION BY rule, decision ORDER BY round(fused, 8) DESC, node_id) AS place FROM every QUALIFY place <= 20")
def replay_rules(spark, d):
    """The twenty highest nodes of every decision of a log under each candidate rule that weighs ranks."""
    g = parts(spark, d)
    scores, log = keep(stand_in_scores(g), "scores"), user_log(spark, d)
    log = keep(log.withColumn("place", F.row_number().over(Window.partitionBy("decision").orderBy("paradigm")) - 1), "log")
    # decisions that select the same in the same order have the same highest nodes
    same = replay.alike(log, ["paradigm", "place"])
    log = keep(log.join(same.where("decision = least"), "decision", "left_semi"), "log-once")
    found, rows = replay.replay(scores, log, g.degrees, g.communities, g.m / max(1, g.n)), None
    for rule in ("order_decay", "lead_only", "ued_top1", "agreement_weight"):
        got = study.by_rules(rule, scores, log, g.degrees, g.communities, g.m / max(1, g.n), found=found).select(F.lit(rule).alias("rule"), "decision", "node_id", F.round("fused", 8).alias("fused"), "ruled")
        rows = got if rows is None else rows.unionByName(got)
    place = F.row_number().over(Window.partitionBy("rule", "decision").orderBy(F.desc("fused"), "node_id"))
    return replay.given(rows.withColumn("place", place.cast("long")).where(F.col("place") <= 20), same)


def scaled_as(paradigm: str, raw: str) -> str:
    return f"SELECT '{paradigm}' AS paradigm, node_id, round(CASE WHEN hi - lo < 1e-10 THEN 0.0 ELSE (score - lo) / (hi - lo) END, 9) AS score FROM {raw}, (SELECT min(score) AS lo, max(score) AS hi FROM {raw})"


FLAGSHIP = ["local_affinity", "homophily_violation", "attribute_inflation", "community"]


@query(base(2).replace("\nscores AS", "\nunused AS").replace("\nranked AS", "\nunranked AS").replace("FROM scores)", "FROM unused)") + NEAR + """,
un AS (SELECT node_id, list_transform(f, lambda z: z / greatest(sqrt(list_sum(list_transform(f, lambda w: w * w))), 1e-8)) AS u FROM nodes),
nb AS (SELECT src AS node_id, avg(list_dot_product(x.u, y.u)) AS s FROM edges JOIN un x ON x.node_id = src JOIN un y ON y.node_id = dst GROUP BY 1),
raw1 AS (SELECT nodes.node_id, coalesce(1 - s, 1.0) AS score FROM nodes LEFT JOIN nb USING (node_id)),
raw2 AS (SELECT nodes.node_id, coalesce(distance, (SELECT coalesce(quantile_cont(distance, 0.5), 0.5) FROM far)) AS score FROM nodes LEFT JOIN far USING (node_id)),
va AS (SELECT dim, count(*) AS n FROM feat GROUP BY 1 HAVING stddev_pop(v) > 1e-12),
o AS (SELECT node_id, (row_number() OVER (PARTITION BY dim ORDER BY v, node_id) - 1) / greatest(n - 1, 1) AS r FROM feat JOIN va USING (dim)),
raw3 AS (SELECT node_id, avg(r) AS score FROM o GROUP BY 1),
cen AS (SELECT community, dim, avg(v) AS c, count(*) AS n FROM feat JOIN nodes USING (node_id) GROUP BY 1, 2),
fr AS (SELECT node_id, community, CASE WHEN max(n) < 2 THEN 0 ELSE sqrt(sum((v - c) * (v - c))) END AS x, max(n) AS n FROM feat JOIN nodes USING (node_id) JOIN cen USING (community, dim) GROUP BY 1, 2),
raw4 AS (SELECT node_id, x / CASE WHEN n < 2 THEN 1 ELSE greatest(u, 1e-8) END AS score FROM fr JOIN (SELECT community, avg(x) AS u FROM fr GROUP BY 1) USING (community)),
scores AS (""" + " UNION ALL ".join(scaled_as(p, f"raw{k}") for k, p in enumerate(FLAGSHIP, 1)) + """),
avg_degree AS (SELECT (SELECT count(*) FROM edges)::DOUBLE / (SELECT count(*) FROM nodes) AS avg_degree),
log AS (SELECT DISTINCT 0 AS decision, paradigm FROM scores)""" + REPLAY + " SELECT node_id, round(fused, 6) + 0.0 AS fused FROM fused ORDER BY fused.fused DESC, node_id LIMIT 100")
def fuse_gate(spark, d):
    """The flagship: detectors on the co-purchase graph, weights, gate, fusion, and the highest nodes. A detector's failure fails the query."""
    g = parts(spark, d)
    scores, failed = detectors.run_all(g, FLAGSHIP)
    if failed:
        raise RuntimeError(f"detectors failed: {failed}")
    # last bits of sums should not part what is equal
    fused, _, _ = fusion.compose(scores.withColumn("score", F.round("score", 9)), g)
    return rounded(fused.orderBy(F.desc("fused"), "node_id").limit(100))


# --- evaluation ----------------------------------------------------------------------------------------------------


@query(LABELLED + ", k AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM rows) SELECT round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auroc FROM k")
def auroc(spark, d):
    return rounded(evaluate.auroc(doc_rows(spark, d), []))


@query(LABELLED + ", s AS (SELECT score, sum(y) AS tp, count(*) AS k FROM rows GROUP BY 1), g AS (SELECT tp, sum(tp) OVER w / sum(k) OVER w AS pr FROM s WINDOW w AS (ORDER BY score DESC)) SELECT round(sum(tp * pr) / sum(tp), 6) AS ap FROM g")
def average_precision(spark, d):
    return rounded(evaluate.average_precision(doc_rows(spark, d), []))


@query(LABELLED + ", t AS (SELECT y, row_number() OVER (ORDER BY score DESC, node_id) AS k FROM rows) SELECT sum(y) FILTER (k <= 50)::BIGINT AS hits, round(sum(y) FILTER (k <= 50) / greatest(sum(y), 1), 6) AS recall, round(sum(y) FILTER (k <= 50) / 50.0, 6) AS precision FROM t")
def recall_at_k(spark, d):
    return rounded(evaluate.recall_at(doc_rows(spark, d), [], 50))


@query("WITH a AS (SELECT lang, source, n_chars % 5 AS run, avg(n_chars) AS m FROM documents GROUP BY 1, 2, 3) SELECT lang, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std, count(m)::BIGINT AS runs FROM a GROUP BY 1")
def seed_mean_std(spark, d):
    runs = table(spark, d, "documents").groupBy("lang", "source", (F.col("n_chars") % 5).alias("run")).agg(F.avg("n_chars").alias("m"))
    return rounded(evaluate.seed_summary(runs, "m", ["lang"]))


@query("WITH a AS (SELECT lang AS dataset, source AS method, avg(n_chars) AS v FROM documents GROUP BY 1, 2) SELECT dataset, method, round(rank() OVER (PARTITION BY dataset ORDER BY v DESC) + (count(*) OVER (PARTITION BY dataset, v) - 1) / 2.0, 6) AS rank FROM a")
def friedman_ranks(spark, d):
    rows = table(spark, d, "documents").groupBy(F.col("lang").alias("dataset"), F.col("source").alias("method")).agg(F.avg("n_chars").alias("value"))
    return rounded(evaluate.method_ranks(rows))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def latest_decision(spark, d):
    return evaluate.latest(table(spark, d, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


@query("""WITH s AS (SELECT user_id % 10 AS dataset, user_id, list_distinct(list(event_type)) AS sel FROM events WHERE value > 50 GROUP BY 1, 2),
 v AS (SELECT dataset, paradigm, count(*) AS votes FROM (SELECT dataset, unnest(sel) AS paradigm FROM s) GROUP BY 1, 2), n AS (SELECT dataset, count(*) AS n FROM s GROUP BY 1),
 r AS (SELECT v.*, n, row_number() OVER (PARTITION BY dataset ORDER BY votes DESC, paradigm) AS k, max((votes >= 0.5 * n)::INT) OVER (PARTITION BY dataset) AS passed FROM v JOIN n USING (dataset))
 SELECT dataset, paradigm, votes::BIGINT AS votes FROM r WHERE votes >= 0.5 * n OR (passed = 0 AND k = 1)""")
def majority_vote(spark, d):
    chosen = table(spark, d, "events").where("value > 50").groupBy((F.col("user_id") % 10).alias("dataset"), "user_id").agg(F.collect_set("event_type").alias("selected"))
    return evaluate.majority_vote(chosen)


#: Decisions as an experiment's log would have them, from events.
DECISIONS = """
WITH raw AS (SELECT 'd' || (user_id % 5) AS dataset, CASE event_id % 2 WHEN 0 THEN 'plain' ELSE 'rich' END AS arm, 'm' || (event_id % 3) AS model, user_id % 7 AS repeat, event_type, value FROM events),
decisions AS (SELECT dataset, arm, model, repeat, list_sort(list_distinct(list(event_type))) AS selected, avg(value) AS auroc, min(value) AS auprc, max(value) AS latency_s, (count(*) % 4)::INT AS spare FROM raw GROUP BY 1, 2, 3, 4)"""


def decision_rows(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "events").select(F.concat(F.lit("d"), (F.col("user_id") % 5).cast("string")).alias("dataset"), F.when(F.col("event_id") % 2 == 0, "plain").otherwise("rich").alias("arm"), F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")).alias("model"), (F.col("user_id") % 7).alias("repeat"), "event_type", "value")
    rows = raw.groupBy("dataset", "arm", "model", "repeat").agg(F.array_sort(F.collect_set("event_type")).alias("selected"), F.avg("value").alias("auroc"), F.min("value").alias("auprc"), F.max("value").alias("latency_s"), (F.count("*") % 4).alias("spare"))
    return rows.withColumn("valid_json", F.col("spare") > 0)


@query(DECISIONS + " SELECT dataset, round(quantile_cont(m, 0.5), 6) AS auroc FROM (SELECT dataset, model, avg(auroc) AS m FROM decisions GROUP BY 1, 2) GROUP BY 1")
def median_of_models(spark, d):
    return rounded(evaluate.median_of_models(decision_rows(spark, d)))


@query(DECISIONS + " SELECT arm, model, dataset, round(avg((spare > 0)::INT), 6) AS validity, count(DISTINCT array_to_string(selected, ',')) = 1 AS stable, round(avg(auroc), 6) AS auroc, round(avg(auprc), 6) AS auprc, round(list_sort(list(latency_s))[count(latency_s) // 2 + 1], 6) AS latency FROM decisions GROUP BY 1, 2, 3")
def decision_report(spark, d):
    return rounded(evaluate.decision_report(decision_rows(spark, d)))


@query(DECISIONS + " SELECT dataset, arm, " + ", ".join(f"round(avg(auroc) FILTER (model = 'm{k}'), 6) AS m{k}" for k in range(3)) + " FROM decisions GROUP BY 1, 2")
def arm_pivot(spark, d):
    return rounded(evaluate.arm_pivot(decision_rows(spark, d), ["m0", "m1", "m2"]))


@query(DECISIONS + """, one AS (SELECT dataset, repeat, arm, auroc, selected FROM decisions WHERE model = 'm0'),
 both_ AS (SELECT coalesce(a.dataset, b.dataset) AS dataset, a.auroc AS x, b.auroc AS y, a.selected AS p, b.selected AS q FROM (SELECT * FROM one WHERE arm = 'plain') a FULL JOIN (SELECT * FROM one WHERE arm = 'rich') b ON a.dataset = b.dataset AND a.repeat = b.repeat)
 SELECT dataset, round(avg(x), 6) AS mean_a, round(avg(y), 6) AS mean_b, round(avg(y) - avg(x), 6) + 0.0 AS delta, sum(CASE WHEN p <> q THEN 1 ELSE 0 END)::BIGINT AS changed, (avg(y) < avg(x))::BIGINT AS worse FROM both_ GROUP BY 1""")
def paired_arms(spark, d):
    return rounded(evaluate.paired_arms(decision_rows(spark, d).where("model = 'm0'"), "plain", "rich"))


@query("""WITH p AS (SELECT event_type AS paradigm, CASE event_id % 3 WHEN 0 THEN 5 WHEN 1 THEN 20 ELSE 50 END AS budget, value / 150 - 0.1 AS rho FROM events WHERE value > 60 OR event_type = 'view'),
 g AS (SELECT paradigm, budget, quantile_cont(rho, 0.5) AS median, min(rho) AS least FROM p GROUP BY 1, 2 HAVING quantile_cont(rho, 0.5) >= 0.5 AND min(rho) >= 0)
 SELECT paradigm, budget::BIGINT AS budget, round(median, 6) AS median, round(least, 6) AS least FROM g QUALIFY row_number() OVER (PARTITION BY paradigm ORDER BY (budget <> 20)::INT, budget) = 1""")
def probe_admission(spark, d):
    budget = F.when(F.col("event_id") % 3 == 0, 5).when(F.col("event_id") % 3 == 1, 20).otherwise(50)
    rows = table(spark, d, "events").where("value > 60 or event_type = 'view'").select(F.col("event_type").alias("paradigm"), budget.alias("budget"), (F.col("value") / 150 - 0.1).alias("rho"))
    return rounded(evaluate.probe_admission(rows))


#: Five methods on four data sets, so that the degrees of freedom are even and both tails are finite sums.
METHODS = "WITH a AS (SELECT lang AS dataset, 'm' || (doc_id % 5) AS method, avg(n_chars) AS v FROM documents GROUP BY 1, 2), r AS (SELECT dataset, method, rank() OVER (PARTITION BY dataset ORDER BY v DESC) + (count(*) OVER (PARTITION BY dataset, v) - 1) / 2.0 AS rank FROM a)"


@query(METHODS + """, m AS (SELECT method, avg(rank) AS r FROM r GROUP BY 1), c AS (SELECT 12.0 * 4 / 30 * (sum(r * r) - 5 * 36 / 4.0) AS chi2 FROM m), f AS (SELECT chi2, 3 * chi2 / (16 - chi2) AS f FROM c), t AS (SELECT *, 12 / (12 + 4 * f) AS x FROM f)
 SELECT 4::BIGINT AS n, 5::BIGINT AS k, round(chi2, 6) AS chi2, round(exp(-chi2 / 2) * (1 + chi2 / 2), 6) AS p, round(f, 6) AS f, round(pow(x, 6) * (1 + 6 * (1 - x)), 6) AS p_f, round(2.728 * sqrt(30 / 24.0), 6) AS cd_nemenyi, round(2.498 * sqrt(30 / 24.0), 6) AS cd_bonferroni_dunn FROM t""")
def friedman_test(spark, d):
    rows = table(spark, d, "documents").groupBy(F.col("lang").alias("dataset"), F.concat(F.lit("m"), (F.col("doc_id") % 5).cast("string")).alias("method")).agg(F.avg("n_chars").alias("value"))
    found = evaluate.friedman(evaluate.method_ranks(rows))
    names = ["n", "k", "chi2", "p", "f", "p_f", "cd_nemenyi", "cd_bonferroni_dunn"]
    return rounded(spark.createDataFrame([tuple(found[c] for c in names)], "n long, k long, " + ", ".join(f"{c} double" for c in names[2:])))


@query(base(1) + """, c AS (SELECT paradigm, quantile_cont(score, 0.9) AS p FROM scores GROUP BY 1),
 s AS (SELECT paradigm, count(*) AS n, avg(score) FILTER (score > p) AS mt, avg(score) FILTER (score <= p) AS mb, stddev_pop(score) FILTER (score > p) AS st, stddev_pop(score) FILTER (score <= p) AS sb, count(*) FILTER (score > p) AS nt, count(*) FILTER (score <= p) AS nb FROM scores JOIN c USING (paradigm) GROUP BY 1),
 t AS (SELECT paradigm, CASE WHEN n >= 20 AND nt >= 2 AND nb >= 2 THEN greatest(0, least(1, 0.4 * least((mt - mb) / greatest(sb, 1e-10) / 5, 1) + 0.4 + 0.2 / (1 + st / greatest(mt, 1e-10)))) ELSE 0 END AS v FROM s)
 SELECT paradigm, row_number() OVER (ORDER BY v DESC, paradigm)::BIGINT AS place, round(v, 6)::DOUBLE AS tail_separation FROM t QUALIFY place <= 3""")
def tail_policy(spark, d):
    return rounded(study.policy(part_scores(spark, d), "tail_separation", 3).select("paradigm", "place", "tail_separation"))


@query(base(1) + " SELECT node_id, " + ", ".join(f"round(max(score) FILTER (paradigm = '{p}'), 6) AS {p}" for p in SHARES) + " FROM scores GROUP BY 1")
def score_matrix(spark, d):
    return rounded(explore.score_matrix(part_scores(spark, d), [*SHARES]))


@query(base(1) + """, pc AS (SELECT paradigm, node_id, score, 100.0 * (rank() OVER (PARTITION BY paradigm ORDER BY score) - 1) / count(*) OVER (PARTITION BY paradigm) AS percentile FROM scores)
 SELECT node_id, sum((percentile > 90)::INT)::BIGINT AS convergence, """ + ", ".join(f"round(max(score) FILTER (paradigm = '{p}'), 6) AS {p}_score, round(max(percentile) FILTER (paradigm = '{p}'), 6) AS {p}_percentile" for p in SHARES) + " FROM pc WHERE node_id % 40 = 7 GROUP BY 1 ORDER BY convergence DESC, node_id LIMIT 50")
def cross_paradigm_view(spark, d):
    s = part_scores(spark, d)
    return rounded(explore.cross_view(s, s.where("node_id % 40 = 7").select("node_id"), [*SHARES]))


@query("""WITH t AS (SELECT 'count_by' AS tool, unnest(['{"by": "lang"}', '{"by": "source"}']) AS params), own AS (SELECT * FROM t UNION ALL SELECT 'longest', '{"k": 5}')
 SELECT tool, params, CASE WHEN tool = 'longest' THEN 5 WHEN params LIKE '%lang%' THEN (SELECT count(DISTINCT lang) FROM documents) ELSE (SELECT count(DISTINCT source) FROM documents) END::BIGINT AS n_rows, 1::BIGINT AS made, CASE WHEN params LIKE '%source%' THEN 0 ELSE 2 END::BIGINT AS read FROM own""")
def tool_provenance(spark, d):
    """Tools over the documents, called again and again, and what the log of calls then says of their results."""
    store = ResultStore(spark, f"{shared_folder(spark)}/tools-{uuid.uuid4().hex}")
    docs = table(spark, d, "documents")
    store.register("count_by", lambda by: docs.groupBy(by).agg(F.count("*").alias("n")), lambda by: [f"{d}/documents.parquet"])
    store.register("longest", lambda k: docs.orderBy(F.desc("n_chars"), "doc_id").limit(k).select("doc_id", "n_chars"))
    for name, params, times in (("count_by", {"by": "lang"}, 3), ("count_by", {"by": "source"}, 1), ("longest", {"k": 5}, 3)):
        for _ in range(times):
            if error := store.execute(name, **params).error:
                raise RuntimeError(error)
    return store.provenance().select("tool", "params", "n_rows", "made", "read")


_conditions = ", ".join(f"('{p.name}', {repr(k) if k else 'NULL'}, {repr(op) if op else 'NULL'}, {t}::DOUBLE)" for p in catalog.PARADIGMS.values() for k, (op, t) in (p.needs or {None: (None, 0.0)}).items())


@query(base(1) + f""", c(paradigm, property, op, threshold) AS (VALUES {_conditions}),
 pr AS (SELECT 'num_nodes' AS property, count(*)::DOUBLE AS value FROM nodes UNION ALL SELECT 'feature_dim', 6 UNION ALL SELECT 'avg_degree', (SELECT count(*) FROM edges)::DOUBLE / (SELECT count(*) FROM nodes) UNION ALL SELECT 'feature_sparsity', (SELECT avg((v = 0)::INT) FROM feat))
 SELECT paradigm, min(coalesce(CASE op WHEN '>=' THEN value >= threshold WHEN '<=' THEN value <= threshold WHEN '>' THEN value > threshold WHEN '<' THEN value < threshold END, true)::INT)::BIGINT AS applies FROM c LEFT JOIN pr USING (property) GROUP BY 1""")
def applicability(spark, d):
    g = parts(spark, d, 1)
    n, m = F.count("*").cast("double"), g.edges.agg(F.count("*").alias("m"))
    zero = F.avg(F.size(F.filter("features", lambda x: x == 0)) / F.greatest(F.size("features"), F.lit(1)))
    one = g.nodes.agg(n.alias("num_nodes"), zero.alias("feature_sparsity"), F.first(F.size("features")).cast("double").alias("feature_dim")).crossJoin(F.broadcast(m))  # one row each
    one = one.withColumn("avg_degree", F.col("m") / F.col("num_nodes"))
    names = ["num_nodes", "feature_dim", "avg_degree", "feature_sparsity"]
    profile = one.select(F.explode(F.create_map(*[x for c in names for x in (F.lit(c), F.col(c))])).alias("property", "value"))
    return rounded(catalog.applicable_frame(catalog.catalog_frame(spark), profile))


