"""The label model on planted accuracies, and the classifier on planted junk."""

import numpy as np

from graphsieve.llm import quality

SCHEMA = "doc_id long, text string, score string, q_keep int, keep string"


def sentence(rng, n):
    words = ["".join(rng.choice(list("aeinorstl"), rng.integers(2, 9))) for _ in range(n)]
    return " ".join(w.capitalize() if i % 11 == 0 else w + "." * (i % 11 == 10) for i, w in enumerate(words))


def junk(rng, n, kind):
    words = sentence(rng, n).split()
    return {0: " ".join(w.upper() + "!!" for w in words), 1: " | ".join(words), 2: " ".join(w + "$#%"[i % 3] * 3 for i, w in enumerate(words)), 3: " ".join(w for w in words[: max(2, n // 12)] for _ in range(12))}[kind]


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    return [(i, junk(rng, int(rng.integers(30, 200)), i // 6 % 4) if i % 6 == 0 else sentence(rng, int(rng.integers(3, 300)))) for i in range(n)]


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(2)
    truth = rng.random(60_000) < 0.2
    right = np.linspace(0.7, 0.95, len(quality.LABELLERS))
    votes = np.where(rng.random((len(truth), len(right))) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.3] = quality.NONE
    packed = votes @ 3 ** np.arange(len(right))
    patterns, counts = np.unique(packed, return_counts=True)
    model = quality.LabelModel(patterns, counts)
    assert abs(model.prior[1] - 0.2) < 0.02
    assert np.allclose([*model.accuracy().values()], right, atol=0.03)
    assert ((model.posterior(packed) > 0.5) == truth).mean() > 0.97


def test_classifier(spark):
    rows = corpus(1, 1200)
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in [*rows, (5001, None), (5002, ""), (5003, "one"), (None, rows[1][1]), (rows[1][0], rows[1][1])]], SCHEMA)
    got = quality.score(docs.repartition(3)).collect()
    assert len(got) == len(rows) + 5
    by = {r.doc_id: r for r in got}
    wrong = [i for i, _ in rows if by[i].keep == (i % 6 == 0)]
    assert len(wrong) <= 3, wrong
    assert all(by[i].keep for i in (5001, 5002, 5003, None)) and all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in got)
    kept = quality.good_only(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.keep for r in got)
    assert quality.score(docs.limit(0)).collect() == []


def test_new_documents_with_the_scorer_alone():
    train, fresh = corpus(3, 900), corpus(4, 300)
    seen = [quality.look(t, quality.Words()) for _, t in train]
    patterns, counts = np.unique([s[0] for s in seen], return_counts=True)
    good = 1 - quality.LabelModel(patterns, counts).posterior(np.array([s[0] for s in seen]))
    weights, bias = quality.fit_linear([s[1:] for s in seen], good)
    kept = [weights[at] @ w + bias > 0 for _, at, w in (quality.look(t, quality.Words()) for _, t in fresh)]
    assert np.mean([k == (i % 6 != 0) for k, (i, _) in zip(kept, fresh, strict=True)]) > 0.98


def test_scores_by_brute_force_and_copies_weigh_once(spark):
    """Votes counted, expectation-maximisation and the linear scorer, all in one place, against the query's columns."""
    rows = corpus(9, 400)
    copies = [(9000 + i, rows[0][1]) for i in range(300)]
    docs = spark.createDataFrame([*rows, *copies], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.score(docs.repartition(4), sample=10_000).collect()}
    seen = {i: quality.look(t, quality.Words()) for i, t in rows + copies}
    patterns, counts = np.unique([s[0] for s in seen.values()], return_counts=True)
    model = quality.LabelModel(patterns, counts)
    bad = {i: model.posterior(np.array([s[0]]))[0] for i, s in seen.items()}
    texts = {t: i for i, t in rows}
    weights, bias = quality.fit_linear([seen[i][1:] for i in texts.values()], np.array([1 - bad[i] for i in texts.values()]))
    for i, (_, at, w) in seen.items():
        assert np.isclose(got[i].score, 1 / (1 + np.exp(-np.clip(weights[at] @ w + bias, -30, 30))), atol=1e-6)
        assert np.isclose(got[i].posterior, 1 - bad[i], atol=1e-9) and got[i].keep == (got[i].score >= quality.KEEP)


def test_copies_leave_the_sample_as_large(spark, monkeypatch):
    """The share drawn goes by distinct texts: copies don't shrink it."""
    seen = []
    monkeypatch.setattr(quality, "fit_linear", lambda rows, *a, f=quality.fit_linear, **k: seen.append(len(rows)) or f(rows, *a, **k))
    rows = [(i, f"This is the sentence number {i} of a text that is quite plain and long enough, as it goes on.") for i in range(400)] + [(1000 + i, "copy of the same words again") for i in range(4000)]
    quality.score(spark.createDataFrame(rows, "doc_id long, text string"), sample=200).count()
    assert 130 < seen[0] < 270
