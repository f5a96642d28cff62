"""PPM scores against a dictionary-of-contexts version that walks one symbol at a time."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphsieve.llm import lm
from graphsieve.llm.common import fold

SCHEMA = "doc_id long, text string, word string, c int, block int"


def symbols(words):
    return [lm.START] * lm.ORDER + [x for w in words for x in (*w, lm.WORD_END)] + [lm.TEXT_END]


def cell(order, came, total, kinds):
    return int(lm.cells(order, np.array([int(came)]), np.array([total]), np.array([kinds]))[0])


def situations(seen, before, symbol):
    """(order, came, T, D, times of the symbol) down to the context that has it."""
    excluded, came = set(), False
    for k in range(min(len(before), lm.ORDER), -1, -1):
        held = {s: c for s, c in seen.get(tuple(before[len(before) - k :]), {}).items() if c}
        if not held:
            continue
        open_ = {s: c for s, c in held.items() if s not in excluded}
        yield k, came, sum(open_.values()), len(open_), open_.get(symbol, 0)
        if symbol in open_:
            return
        excluded, came = set(held), True


def brute(trained):
    """A function from words to log10, trained on lists of words."""
    seen, escapes, visits = defaultdict(Counter), Counter(), Counter()
    places = [(row, i) for row in map(symbols, trained) for i in range(lm.ORDER, len(row))]

    def add(row, i, n):
        for k in range(lm.ORDER + 1):
            seen[tuple(row[i - k : i])][row[i]] += n

    for row, i in places:
        add(row, i, 1)
    for row, i in places:
        add(row, i, -1)
        for k, came, total, kinds, times in situations(seen, row[:i], row[i]):
            if total:
                visits[cell(k, came, total, kinds)] += 1
                escapes[cell(k, came, total, kinds)] += times == 0
        add(row, i, 1)

    def symbol_log10(before, symbol):
        out, times = 0.0, 0
        for k, came, total, kinds, times in situations(seen, before, symbol):
            if total:
                at = cell(k, came, total, kinds)
                e = (escapes[at] + 2 * kinds / (total + kinds)) / (visits[at] + 2)
                out += math.log10((1 - e) * times / total if times else e)
        return out if times else out - math.log10(max(1, lm.ALPHABET - len(seen.get((), ()))))

    def text_log10(words):
        row = symbols(words)
        return sum(symbol_log10(row[:i], row[i]) for i in range(lm.ORDER, len(row)))

    return text_log10


ROWS = [(i, t) for i, t in enumerate(["the cat sat on the mat", "The hat\tand the  bat", "", None, "éa éb ÉA", "zzz yyy xxx", "the the the", "a", "banana bandana cabana " * 60, "x" * 900, "the\x0bcat\x1csat", "hat and cat"] * 2)]


@pytest.mark.parametrize("step, block, part", [(1 << 20, 6 << 20, 1 << 18), (50, 900, 40)])
def test_scores(spark, monkeypatch, step, block, part):
    monkeypatch.setattr(lm, "STEP", step)
    monkeypatch.setattr(lm, "BLOCK", block)
    monkeypatch.setattr(lm, "PART", part)
    held = fold("doc_id", 5) == 1
    docs = spark.createDataFrame([(i, t, "w", 1, 2) for i, t in ROWS] + [(3, None, "w", 1, 2), (None, "null id", "w", 1, 2)], SCHEMA)
    got = lm.score(docs.repartition(3), held).collect()
    rows = [*ROWS, (3, None), (None, "null id")]
    is_held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    trained = [lm.words_of(t or "") for i, t in rows if not is_held(i)]
    counts, ends = Counter(w for words in trained for w in words), len(trained)
    total, kinds = sum(counts.values()) + ends, len(counts) + 1
    text_log10 = brute(trained)
    want = []
    for i, t in rows:
        words = lm.words_of(t or "")
        base = sum(math.log10((c + 0.5) / (total + 0.5 * (kinds + 1))) for c in [*(counts[w] for w in words), ends])
        want.append((i if i is not None else -1, is_held(i), len(words) + 1, sum(counts[w] > 0 for w in words) + 1, total, base, text_log10(words)))
    got = sorted(((r.doc_id if r.doc_id is not None else -1, *r[1:]) for r in got))
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:5] == b[:5] and np.isclose(a[5], b[5], rtol=1e-9) and np.isclose(a[6], b[6], rtol=1e-5, atol=1e-4)


def test_probabilities_add_up():
    flat = lm.symbols_of([lm.words_of("abc abd b"), lm.words_of("b abc"), []])
    code, n = lm.tally(lm.situations(flat)[1])
    low = lm.nodes_of(code, n, range(lm.LOW + 1))
    plain = code & ((1 << lm.BUCKET_SHIFT) - 1)
    trie = lm.part_of_trie(low, plain, n)
    for before in (b"", b"a", b"ab", b"zq", b"abc ab"):
        row = [lm.START] * lm.ORDER + [*before]
        code = np.array([lm.situations(np.array([*row, s], np.uint8))[1][-1] for s in range(256) if s not in (9, 11, 12, 13)])
        # the start and three more white-space bytes are no symbols, so these are all of them
        assert np.isclose((10 ** trie.coded(code)).sum(), 1)


def test_columns_come_back():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        a, b = np.sort(rng.integers(0, 1 << 60, n)), rng.integers(0, 9, n)
        (x, y), text = lm.unsqueeze(lm.squeeze(a, b, text=b"one\ntwo"))
        assert (x == a).all() and (y == b).all() and text == b"one\ntwo"


def test_order_of_words_and_copies_tell(spark):
    """A held-out text that training has too scores far above one of the same words in another order."""
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(300)]
    docs = [(i, " ".join(rng.choice(words, 120))) for i in range(60)]
    twin, mixed = docs[0][1], " ".join(sorted(docs[0][1].split()))
    frame = spark.createDataFrame([*docs, (1001, twin), (1002, mixed)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.score(frame, F.col("doc_id") > 1000).collect()}
    assert got[1001] > got[1002] + 20


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_no_text(spark, rows):
    docs = spark.createDataFrame([(i, t, "w", 1, 2) for i, t in rows], SCHEMA)
    for held in (F.lit(False), F.lit(True)):
        got = lm.score(docs, held).collect()
        assert len(got) == len(rows)
        assert all(r.n_tokens == 1 and math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
