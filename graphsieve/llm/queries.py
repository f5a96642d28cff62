"""The registered queries of this subpackage, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphsieve.llm import ann, bpe, collocations, decontamination, divergence, gif, html_cut, jaccard_join, lm, packing, quality, token_store, toxicity
from graphsieve.llm.common import fold, table, work_path, written


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    scored = toxicity.score(docs.select("doc_id", "text"), net)
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))


def op3_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = written(gif.store(table(spark, sf_dir, "documents")), "gif")
    back = gif.load(stored)
    data = F.col("data")
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length(data).cast("long").alias("payload_bytes"),
        F.sha2(data, 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(data, -32)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", F.concat(F.lit("frames="), F.col("n_frames")), F.concat(F.lit("cs="), F.col("total_cs")), F.concat(F.lit("grey="), F.concat_ws(",", F.col("grey").cast("array<string>")))).alias("feature"),
        "n_frames",
        "total_cs",
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "token-store")
    token_store.save(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_store.read(spark, path)


def op6_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_html_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_cut.extract(table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=0)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op10_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), fold("doc_id", 5) == 1)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    found = found.withColumn("n_hit", decontamination.n_hit())
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_gif_media": op3_gif_media,
    "op4_quality": op4_quality,
    "op5_token_store": op5_token_store,
    "op6_permutation_index": op6_permutation_index,
    "op7_html_cut": op7_html_cut,
    "op8_packing": op8_packing,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_ppm": op10_ppm,
    "op11_collocations": op11_collocations,
    "op12_decontamination": op12_decontamination,
    "op13_divergence": op13_divergence,
}
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
COLLOCATIONS = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
runs AS (SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN generate_series(1, len(w) - k + 1)]) AS phrase FROM words, (VALUES (1), (2), (3), (4)) v(k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM runs GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT lang, k, phrase, a, w, unnest(generate_series(1, k - 1)) AS cut FROM c),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.k, cuts.a, l.a AS l, r.a AS r, cut, 2000000 * cuts.a::HUGEINT // (l.a + r.a) AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = array_to_string(cuts.w[1:cut], ' ')
  JOIN f r ON r.lang = cuts.lang AND r.phrase = array_to_string(cuts.w[cut + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_ AS (SELECT lang, a, array_to_string(w[b:b + m - 1], ' ') AS phrase FROM (SELECT *, unnest(generate_series(1, k - m + 1)) AS b FROM (SELECT *, unnest(generate_series(2, k - 1)) AS m FROM c))),
around AS (SELECT lang, phrase, max(a) AS a FROM inner_ GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN around USING (lang, phrase) WHERE around.a IS NULL OR 100 * around.a::HUGEINT < 80 * best.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n.n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
DECONTAMINATION = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS n FROM i WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, unnest([array_to_string(w[s:s + n - 1], ' ') FOR s IN generate_series(1, len(w) - n + 1)]) AS words FROM sized),
sizes AS (SELECT DISTINCT n FROM windows),
starts AS (SELECT row, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, sizes),
found AS (SELECT row, s, n, item_id FROM (SELECT row, s, n, array_to_string(w[s:s + n - 1], ' ') AS words FROM starts) JOIN windows USING (n, words)),
hits AS (SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT row, unnest(generate_series(s, s + n - 1)) AS place FROM found) GROUP BY row),
items AS (SELECT row, count(item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT row, item_id::VARCHAR AS item_id FROM found) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (row) LEFT JOIN items USING (row)
"""
DIVERGENCE = rf"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({LOWER}, '[a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
t AS (SELECT row, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT row) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
sizes AS (SELECT lang, source, sum(n) AS size FROM counts GROUP BY ALL),
all_ AS (SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 2) // (coalesce(s.size, 0) + 2 * v.v) AS p
  FROM groups g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN sizes s USING (lang, source) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + 1000000000 * (n + 2) // ((SELECT sum(n) FROM all_ x WHERE x.lang = all_.lang) + 2 * v) AS q FROM all_ JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
valued AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank FROM valued QUALIFY part = 'pair' OR rank <= 10
"""
#: The others learn, or need a tokenizer, a format or a cut: tests hold them against libraries, brute force or their contracts.
ORACLE_SQL: dict[str, str] = {"op11_collocations": COLLOCATIONS, "op12_decontamination": DECONTAMINATION, "op13_divergence": DIVERGENCE}
