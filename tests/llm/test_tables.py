"""Operators 11 to 13: the registered queries beside their SQL on tables made to be awkward, and what their parameters change."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from graphsieve.llm import collocations, decontamination, divergence, queries
from tests.compare import cell, rows_of

NAMES = ["op11_collocations", "op12_decontamination", "op13_divergence"]


def folder_of(path, docs, items):
    """Tables with columns that clash with those that the operators make."""
    extra = {c: pa.array(["x"] * len(docs), pa.string()) for c in ("h", "n", "words", "items", "term", "docs", "phrase", "slice", "total", "a", "b", "block", "value", "rank")}
    ids, texts, langs, sources = zip(*docs, strict=True) if docs else ((), (), (), ())
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(langs, pa.string()), "source": pa.array(sources, pa.string()), **extra}), f"{path}/documents.parquet")
    item_ids, item_texts = zip(*items, strict=True) if items else ((), ())
    pq.write_table(pa.table({"item_id": pa.array(item_ids, pa.int64()), "text": pa.array(item_texts, pa.string()), "words": pa.array([1] * len(items), pa.int64()), "n": pa.array([1] * len(items), pa.int64())}), f"{path}/benchmark.parquet")
    return str(path)


def awkward():
    rng = np.random.default_rng(5)
    vocabulary = ["the", "Of", "a", "Maß", "maß", "日本", "x1", "don't", "e-mail", "ÉTÉ", "été", "q"] + [f"w{k}" for k in range(12)]
    breaks = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "-"]
    text = lambda n: "".join(str(rng.choice(vocabulary)) + str(rng.choice(breaks)) for _ in range(n))
    items = [(k, text(n)) for k, n in enumerate([25, 10, 11, 1, 2, 3, 9, 40, 0])] + [(20, None), (21, ""), (22, "..."), (23, "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1"), (24, "The of a"), (3, text(12)), (None, text(12)), (30, "unseen")]
    items += [(31, items[0][1]), (0, items[0][1])]
    docs = [(k, text(int(rng.integers(0, 120))), str(rng.choice(["en", "de"])), f"s{min(int(rng.integers(0, 8)), 3)}") for k in range(300)]
    for k in range(40):
        i = int(rng.integers(0, len(items)))
        docs.append((500 + k, f"{text(3)}{items[i][1] or ''} {text(2)}{items[(i + 1) % 8][1]}", "en", "s1"))
    docs += [(900, None, None, None), (901, "", "en", None), (902, "...", None, "s1"), (903, "w1 " * 400, "en", "s1"), (None, items[0][1], "en", "s9"), (None, items[0][1], "en", "s9"), (904, items[7][1] * 300, "fr", "s1"), (905, "solo " * 20, "xx", "only")]
    docs += docs[:20] + [(910, "new york city is far " * 3, "en", "s2")] * 15 + [(911, "word " * 3, "", "")] * 12
    return docs, items


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    return folder_of(tmp_path_factory.mktemp("awkward"), *awkward())


def theirs(folder, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    cur = con.execute(queries.ORACLE_SQL[name])
    return rows_of([c[0] for c in cur.description], cur.fetchall())


def mine(df):
    return rows_of(df.columns, df.collect())


@pytest.mark.parametrize("name", NAMES)
def test_awkward_tables(spark, tables, name):
    assert (got := mine(queries.QUERIES[name](spark, tables))) == theirs(tables, name) and sum(got.values()) > 20


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("docs, items", [([], []), ([], [(1, "a b c")]), ([(1, None, None, None)], []), ([(1, "a b c", "en", "s"), (2, "", "en", "t")], [(1, None)]), ([(7, "one", "en", "s")] * 2, [(1, "one"), (2, "ONE")])])
def test_small_tables(spark, tmp_path, name, docs, items):
    folder = folder_of(tmp_path, docs, items)
    assert mine(queries.QUERIES[name](spark, folder)) == theirs(folder, name)


def test_spans_and_blocks_of_windows(spark, tables):
    docs, items = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "benchmark"))
    one = decontamination.contaminated(docs, items).withColumn("n_hit", decontamination.n_hit())
    many = decontamination.contaminated(docs, items, block=20).withColumn("n_hit", decontamination.n_hit())
    whole = ["doc_id", "n_words", "items", "n_hit"]
    row = lambda df: sorted(str(r) for r in df.select(*whole).collect())
    assert row(one) == row(many)
    spans = {r["doc_id"]: r["spans"] for r in one.collect()}
    assert [tuple(s) for s in spans[903]] == [(0, 400)] and spans[900] == [] and spans[905] == []
    narrow = decontamination.contaminated(docs.where("doc_id = 910").limit(1), spark.createDataFrame([("k", "york city")], "item_id string, text string"), width=2).first()
    assert [tuple(s) for s in narrow.spans] == [(1, 3), (6, 8), (11, 13)] and list(narrow["items"]) == ["k"] and narrow.n_words == 15


def test_full_buckets_and_small_buffers_change_nothing(spark, tables, monkeypatch):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    want = [mine(collocations.mine(docs, least=5, top=50)), mine(divergence.audit(docs, least_docs=2))]
    monkeypatch.setattr(collocations, "LEAST_BITS", 1 << 16)
    monkeypatch.setattr(collocations, "MOST_BITS", 1 << 16)
    monkeypatch.setattr(collocations, "HELD", 50)
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "PAIRS", 7)
    assert [mine(collocations.mine(docs, least=5, top=50)), mine(divergence.audit(docs, least_docs=2))] == want


def test_every_bucket_frequent(spark, tables, monkeypatch):
    """With bitmaps that let all through, only counting and the last filter decide."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    want = mine(collocations.mine(docs, least=5))
    monkeypatch.setattr(collocations.Bitmap, "has", lambda self, hashes: np.ones(len(hashes), bool))
    assert mine(collocations.mine(docs, least=5)) == want


def test_long_texts(spark):
    text = "Alpha beta gamma. delta " * 150_000
    docs = spark.createDataFrame([(1, text, "en", "s"), (2, "alpha beta", "en", "t")], "doc_id long, text string, lang string, source string")
    top = collocations.mine(docs, top=1).first()
    assert (top.phrase, top.a, top.n) == ("delta alpha beta gamma", 149_999, 600_002)
    found = {r.doc_id: r for r in decontamination.contaminated(docs, spark.createDataFrame([(5, "gamma delta alpha beta gamma")], "item_id long, text string")).collect()}
    assert found[1].n_words == 600_000 and [tuple(s) for s in found[1].spans] == [(2, 599_999)] and found[2].spans == []
    rows = {(r["source"], r["item"]): r["value"] for r in divergence.audit(docs, least_docs=1).where("part = 'pair'").collect()}
    p = [1 + 1_000_000_000 * (n + 2) // (600_000 + 8) for n in (150_000,) * 4]
    q = [1 + 1_000_000_000 * (n + 2) // (2 + 8) for n in (1, 1, 0, 0)]
    assert rows["s", "t"] == rows["t", "s"] == sum((x - y) ** 2 // (x + y) for x, y in zip(p, q, strict=True))


def test_cell_is_exact_for_integers():
    assert cell(2**62 + 1) == 2**62 + 1
