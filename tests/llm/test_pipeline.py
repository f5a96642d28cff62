"""The pipeline's stages on planted junk, toxic words and copies, and each registered query on the smallest tables."""

import base64
import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers

import corpus_pipeline
from graphsieve.llm import packing, queries
from graphsieve.llm.common import table, written
from tests.llm.test_jaccard_join import all_pairs

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    told = {r.doc_id: r for r in table(spark, FOLDER, "labels").collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, FOLDER), f"test-{name}")
        if name != "packing":
            assert out.columns == docs.columns
        before, after = {r.doc_id for r in docs.select("doc_id").collect()}, {r.doc_id for r in out.select("doc_id").distinct().collect()}
        assert after <= before and after
        kept[name], docs = after, out
    assert all(told[i].quality == 1 for i in kept["quality"] if i in told)
    clean = [i for i in told if told[i].quality == 1]
    assert sum(i in kept["quality"] for i in clean) >= 0.97 * len(clean)
    assert kept["packing"] == kept["near_duplicates"]


def test_run_is_its_stages(spark):
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.columns == packing.NAMES
    bins = defaultdict(int)
    for r in got.collect():
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= 1024


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


def part(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.fixture(scope="module")
def docs(spark):
    """doc_id to text."""
    return {r.doc_id: r.text or "" for r in table(spark, FOLDER, "documents").collect()}


@pytest.fixture(scope="module")
def tokenizer():
    return tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def rows_of(spark, name):
    return queries.QUERIES[name](spark, FOLDER).collect()


def test_op1_columns(spark, docs):
    rows = rows_of(spark, "op1_toxicity")
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (part(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    told = {r.doc_id: r.toxic for r in table(spark, FOLDER, "labels").collect() if r.toxic is not None}
    right = [r.predicted == told[r.doc_id] for r in rows if r.held_out and r.doc_id in told]
    assert np.mean(right) > 0.8


def test_op2_is_tiktoken(spark, docs):
    ranks = {base64.b64decode(x): int(n) for x, n in (line.split() for line in open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") if line.strip())}
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = rows_of(spark, "op2_byte_bpe")
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        ids = library.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_op3_payload_columns(spark, docs):
    rows, by_text = rows_of(spark, "op3_gif_media"), defaultdict(set)
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        data = docs[r.doc_id].encode()
        payload = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        assert r.media_bytes > 0 and len(r.media_sha256) == 64
        by_text[docs[r.doc_id]].add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(x) == 1 for x in by_text.values())


def test_op4_columns(spark, docs):
    rows = rows_of(spark, "op4_quality")
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 and r.keep == (r.score >= 0.5) for r in rows)


def test_op5_is_the_tokenizers_library(spark, docs, tokenizer):
    rows, at = sorted(rows_of(spark, "op5_token_store"), key=lambda r: r.doc_id), 0
    assert [r.doc_id for r in rows] == sorted(docs)
    for r in rows:
        ids = [*tokenizer.encode(docs[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)


def test_op6_against_brute_force(spark):
    vectors = {r.vec_id: np.array(r.embedding, float) for r in table(spark, FOLDER, "embeddings").where("embedding is not null").collect()}
    ids = np.array(sorted(vectors))
    x = np.stack([vectors[i] for i in ids.tolist()])
    got, found, wanted = defaultdict(list), 0, 0
    for r in sorted(rows_of(spark, "op6_permutation_index"), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == {i for i in ids.tolist() if i % 50 == 0}
    for q, rows in got.items():
        v = vectors[q]
        score = x @ v / (np.linalg.norm(x, axis=1) * np.linalg.norm(v))
        want = [(-s, i) for s, i in zip(score.tolist(), ids.tolist(), strict=True) if i != q]
        best = {i for _, i in sorted(want)[:5]}
        found, wanted = found + sum(i in best for i, _ in rows), wanted + len(best)
        exact = dict(zip(ids.tolist(), score.tolist(), strict=True))
        assert all(abs(exact[i] - s) < 1e-12 for i, s in rows) and [s for _, s in rows] == sorted((s for _, s in rows), reverse=True)
    assert found >= 0.9 * wanted


def test_op7_columns(spark):
    rows = rows_of(spark, "op7_html_cut")
    pages = {r.page_id: r for r in table(spark, FOLDER, "pages").collect()}
    assert sorted(r.page_id for r in rows) == sorted(pages)
    assert all(r.url == pages[r.page_id].url and r.n_chars == len(r.text) for r in rows)
    assert np.mean([len(r.text) > 0 for r in rows]) > 0.95


def test_op8_is_the_tokenizers_library(spark, docs, tokenizer):
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows_of(spark, "op8_packing"):
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(docs)
    for i, own in pieces.items():
        ids, at = [*tokenizer.encode(docs[i], add_special_tokens=False).ids, 0], 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), crc(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024


def test_op9_against_all_pairs(spark, docs):
    rows = sorted(docs.items())
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in rows_of(spark, "op9_jaccard_join")) == all_pairs(rows)


def test_op10_base_columns(spark, docs):
    words = {i: re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode())) for i, t in docs.items()}
    trained = [i for i in docs if part(i, 5) != 1]
    counts = Counter(w for i in trained for w in words[i])
    total, kinds, ends = sum(counts.values()) + len(trained), len(counts) + 1, len(trained)
    rows = rows_of(spark, "op10_ppm")
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        c = [*(counts[w] for w in words[r.doc_id]), ends]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (part(r.doc_id, 5) == 1, len(c), sum(x > 0 for x in c), total)
        assert np.isclose(r.base_score, sum(math.log10((x + 0.5) / (total + 0.5 * (kinds + 1))) for x in c), rtol=1e-9) and r.score <= 0


ODD = [(5, "a good text of enough words to be kept by all the stages of this pipeline here"), (5, "another good text with the same id that has to stay beside the first of them"), (None, "a text without any id that is good and stays as well in the end of it"), (None, None), (9, ""), (9, "a good text of enough words to be kept by all the stages of this pipeline here")]


def test_stages_on_odd_rows_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, h long, node string"
    folder = str(tmp_path)
    spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for rows, want in ((ODD, {t for _, t in ODD if t}), ([], set())):
        docs = spark.createDataFrame([(i, t, "en", None, 3, 7, "clash") for i, t in rows], schema)
        for name, stage in corpus_pipeline.STAGES[:3]:
            docs = written(stage(spark, docs, folder), f"odd-{name}")
            assert docs.columns == [x.split()[0] for x in schema.split(", ")]
        kept = [(r.doc_id, r.text) for r in docs.collect()]
        assert {t for _, t in kept if t} == want and len(kept) == len(want) + bool(rows)
        assert corpus_pipeline.STAGES[3][1](spark, docs, folder).select("doc_id").distinct().count() == len({i for i, _ in kept})
