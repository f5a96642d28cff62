"""The Jaccard join against all pairs."""

import numpy as np
import pytest

from graphsieve.llm import jaccard_join as jj

SCHEMA = "doc_id long, text string, node string, n int, tree string"


def all_pairs(rows, similarity=0.8):
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := (t or "").lower().split()) else frozenset() for _, t in rows]
    n = len(rows)
    root, links = list(range(n)), [0] * n

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            same = sets[a] == sets[b]
            if same or (sets[a] and sets[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])):
                links[a] += 1
                links[b] += 1
                root[top(a)] = top(b)
    classes = {}
    for k in range(n):
        classes.setdefault(top(k), []).append(rows[k][0])
    return sorted((i, min(classes[top(k)]), links[k]) for k, (i, _) in enumerate(rows))


def corpus():
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(3000)]
    make = lambda n: list(rng.choice(words, n))
    rows = [(i, " ".join(make(int(rng.integers(1, 80))))) for i in range(60)]
    base = make(120)
    for i in range(60, 140):  # a chain of edits of one text
        base = base.copy()
        base[int(rng.integers(0, len(base)))] = "edit" + str(i)
        if i % 9 == 0:
            base = base[3:] + make(3)
        rows.append((i, " ".join(base)))
    return [*rows, (140, ""), (141, None), (142, "  "), (143, rows[3][1].upper()), (144, rows[3][1]), (145, rows[3][1]), (146, "a"), (147, "a b c"), (148, "long " * 9000)]


@pytest.mark.parametrize("block", [256, 7])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(jj, "BLOCK", block)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "n", 1, "t") for i, t in rows], SCHEMA).repartition(5)
    got = jj.join(docs).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == all_pairs(rows)
    by = {r.doc_id: r for r in got}
    assert by[144].n_copies == 4 and by[144].n_texts == 0 and by[141].n_copies == 3


def test_one_of_each(spark):
    rows = [*corpus(), (None, "a null id of its own here"), (None, "a null id of its own here"), (7, "same id, other text than before"), (3, corpus()[3][1])]
    docs = spark.createDataFrame([(i, t, "n", 1, "t") for i, t in rows], SCHEMA)
    kept = jj.one_of_each(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    whole = {i for i, c, _ in all_pairs(corpus()) if i == c}
    assert {i for i, _ in got if i is not None} == whole | {7} and len(got) == len(whole | {7}) + 1 + (7 in whole)
    assert (None, "a null id of its own here") in got and (7, "same id, other text than before") in got
    assert jj.join(docs.limit(0)).collect() == [] and jj.one_of_each(docs.limit(0)).collect() == []


def test_one_of_each_keeps_every_class_where_ids_repeat(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(5, a), (5, b), (3, a), (None, c), (None, d), (None, d), (5, b)]
    docs = spark.createDataFrame([(i, t, f"n{k}", k, "t") for k, (i, t) in enumerate(rows)], SCHEMA)
    kept = jj.one_of_each(docs).collect()
    assert sorted((r.text, r.doc_id) for r in kept if r.doc_id) == [(a, 3), (b, 5)]
    assert sorted(r.text for r in kept if r.doc_id is None) == [c, d]
    assert all((r.node, r.n) == (f"n{r.n}", r.n) and rows[r.n] == (r.doc_id, r.text) for r in kept)


@pytest.mark.parametrize("similarity", [0.6, 0.8, 0.9])
def test_recall_at_several_similarities(spark, similarity):
    """Pairs of texts at known distances, by brute force."""
    rng = np.random.default_rng(23)
    rows = []
    for i in range(150):
        words = [f"w{rng.integers(1 << 30)}" for _ in range(100)]
        other = words.copy()
        for at in rng.choice(100, int(rng.integers(0, 5)), replace=False):
            other[at] = f"e{rng.integers(1 << 30)}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    docs = spark.createDataFrame([(i, t, "n", 1, "t") for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jj.join(docs, similarity=similarity).collect()}
    want = {i: (c, n) for i, c, n in all_pairs(rows, similarity)}
    linked = [i for i, (_, n) in want.items() if n]
    assert all(got[i][1] <= want[i][1] for i in want)
    assert len(linked) > 50 and sum(got[i] == want[i] for i in linked) >= 0.99 * len(linked)


def test_rounds_end_early_where_candidates_are_all_alike(spark, monkeypatch):
    depths = []
    true_round = jj.round_of
    monkeypatch.setattr(jj, "round_of", lambda trie, depth: depths.append(depth) or true_round(trie, depth))
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join([*words, f"end{i}"])) for i in range(20)]
    docs = spark.createDataFrame([(i, t, "n", 1, "t") for i, t in rows], SCHEMA)
    assert {r.n_links for r in jj.join(docs).collect()} == {19}
    assert depths == [jj.MAX_DEPTH]
    depths.clear()
    assert jj.join(spark.createDataFrame([(i, t, "n", 1, "t") for i, t in corpus()], SCHEMA)).count() == len(corpus())
    assert depths == list(range(jj.MAX_DEPTH, jj.prefix_depth() - 1, -1))


def test_depth_is_shortened_for_recall():
    assert jj.recall_at(jj.prefix_depth()) >= jj.RECALL > jj.recall_at(jj.prefix_depth() + 1)
    assert jj.prefix_depth(0.5) > jj.prefix_depth(0.999)


def test_components_of_a_long_path(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1000), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in jj.components(edges).collect()}
    assert all(got[i] == 0 for i in range(n + 1)) and got[1001] == got[1000] == 1000 and len(got) == n + 3
