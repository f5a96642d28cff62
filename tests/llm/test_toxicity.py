"""The network's gradients, its scores of all windows, and held-out accuracy on planted words."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphsieve.llm import toxicity as tx
from graphsieve.llm.common import fold

SCHEMA = "doc_id long, text string, score string, toxic int, lang string"
LABELS = "doc_id long, quality int, toxic int"


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(list("aeinorstl"), rng.integers(2, 9))) for _ in range(int(rng.integers(5, 150)))]
        bad = i % 4 == 0
        if bad:
            for _ in range(int(rng.integers(2, 6))):
                words[int(rng.integers(0, len(words)))] = str(rng.choice(["zquckish", "vomp", "gruxx"])) + str(rng.choice(["", "ing", "ers", ","]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_gradients():
    net = tx.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["query"] *= 3
    lexicon = tx.Lexicon()
    rows = np.array([[lexicon.row(w) for w in ("a", "bad", "word")] + [0], [lexicon.row("so"), lexicon.row("bad"), 0, 0]])
    label, weight, arrays = np.array([1.0, 0.0]), np.array([0.7, 0.3]), lexicon.arrays()

    def loss():
        z = net.logits(rows, *net.gates(net.inputs(arrays).astype(np.float64))).astype(np.float64)
        return float((weight * (np.logaddexp(0, z) - label * z)).sum())

    got, _ = net.gradients(rows, label, weight, arrays)
    for name in ("bias", "out", "query", "attend", "attend_bias", "hidden", "forward", "backward", "forward_bias", "backward_bias"):
        flat, slope = net.p[name].reshape(-1), got[name].reshape(-1)
        for i in np.argsort(-np.abs(slope))[:2]:
            old, step = flat[i], 3e-3
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            assert np.isclose((up - down) / (2 * step), slope[i], rtol=0.05, atol=2e-4), name


def test_windows_cover_texts_and_overlap():
    for n in (0, 1, 31, 32, 33, 56, 57, 1000):
        begins = tx.spans(n)
        assert begins[0] == 0 and begins[-1] + tx.WINDOW >= n and all(b - a < tx.WINDOW for a, b in zip(begins, begins[1:], strict=False))
        assert len(begins) == 1 or begins[-2] + tx.WINDOW < n


def test_whole_windows_score_alike():
    net = tx.Network(3)
    rng = np.random.default_rng(0)
    rows, f, b = rng.integers(1, 50, (9, tx.WINDOW)), rng.standard_normal((50, 24)).astype(np.float32), rng.standard_normal((50, 24)).astype(np.float32)
    assert np.allclose(net.whole_logits(rows, f, b), net.logits(rows, f, b), atol=1e-4)


def test_held_out_accuracy(spark):
    rows, labels = corpus(5, 1000)
    docs = spark.createDataFrame([(i, t, "clash", 0, "xx") for i, t in rows] + [(5000, None, "c", 0, "x"), (5001, "", "c", 0, "x"), (None, rows[0][1], "c", 0, "x"), (0, rows[0][1], "c", 0, "x")], SCHEMA)
    told = spark.createDataFrame([*labels, (0, 1, 1), (7, None, None), (None, 1, 1)], LABELS)
    net = tx.fit(docs, told, fold("doc_id", 3) != 1)
    got = tx.score(docs.select("doc_id", "text", "lang").repartition(3), net, name="found").withColumn("held_out", fold("doc_id", 3) == 1).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.found <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1000]
    right = [(r.found >= tx.THRESHOLD) == (r.doc_id % 4 == 0) for r in held]
    assert np.mean(right) > 0.95
    assert len({round(r.found, 5) for r in got if r.text == rows[0][1]}) == 1
    assert all(r.found < tx.THRESHOLD for r in got if not r.text)
    kept = tx.clean_only(docs, net)
    assert kept.columns == docs.columns and 0 < kept.count() < len(rows)
    with pytest.raises(ValueError):
        tx.score(docs, net)


@pytest.mark.parametrize("kinds", [[], [0, 0], [1, 1]])
def test_one_class_or_none(spark, kinds):
    docs = spark.createDataFrame([(i, "some text", "c", 0, "x") for i in range(2)], SCHEMA).select("doc_id", "text")
    net = tx.fit(docs, spark.createDataFrame([(i, 1, k) for i, k in enumerate(kinds)], LABELS), F.lit(True))
    assert all((r.score >= 0.7) == (kinds == [1, 1]) for r in tx.score(docs, net).collect())
    assert tx.score(docs.limit(0), net).collect() == []


def test_sample_is_drawn_among_the_documents(spark):
    rows, labels = corpus(6, 200)
    copies = [(1000 + i, rows[0][1]) for i in range(50)]
    docs = spark.createDataFrame([r for r in rows if r[0] % 2 == 0] + copies, "doc_id long, text string")
    told = spark.createDataFrame([*labels, *((i, 1, 1) for i, _ in copies)], LABELS)
    got = tx.sample(docs, told, F.lit(True), documents=20).collect()
    assert len({r.text for r in got}) == len(got) and sum(r.text == rows[0][1] for r in got) <= 1
    assert 0 < sum(r.is_toxic for r in got) <= 20 and 0 < sum(not r.is_toxic for r in got) <= 60
    there = {t for i, t in rows if i % 2 == 0}
    assert all(r.text in there for r in got)
    every = tx.sample(docs, told, F.lit(True), documents=1000).collect()
    assert len(every) == 100


def test_grams_of_long_words_in_pieces(monkeypatch):
    words = ["ab", "x" * 50, "".join(chr(97 + i * i % 26) for i in range(200)), "é"]

    def buckets():
        out = [[] for _ in words]
        for gram, owner in tx.grams(words):
            for g, o in zip(gram.tolist(), owner.tolist(), strict=True):
                out[o].append(g)
        return [sorted(x) for x in out]

    whole = buckets()
    assert [len(x) for x in whole] == [sum(max(0, len(w) + 2 - n + 1) for n in (3, 4, 5)) for w in words]
    monkeypatch.setattr(tx, "CHUNK", 16)
    assert buckets() == whole


def test_scores_are_the_highest_of_all_windows_by_brute_force():
    rows, labels = corpus(8, 60)
    net = tx.train([t for _, t in rows], np.array([bool(k) for _, _, k in labels]), passes=2)
    scorer = tx.Scorer(net)
    texts = [t for _, t in rows] + ["", "one " * 500, "w" * 300_000]
    got = scorer.scores(texts)
    for text, value in zip(texts, got, strict=True):
        words, best = text.lower().split(), -np.inf
        for at in tx.spans(len(words)):
            lexicon = tx.Lexicon()
            rows_ = np.zeros((1, tx.WINDOW), np.int64)
            some = words[at : at + tx.WINDOW]
            rows_[0, : len(some)] = [lexicon.row(w) for w in some]
            best = max(best, float(net.logits(rows_, *net.gates(net.inputs(lexicon.arrays())))[0]))
        want = 1 / (1 + np.exp(-(best + net.shift + np.log(tx.THRESHOLD / (1 - tx.THRESHOLD)))))
        assert np.isclose(value, want, atol=1e-4)
