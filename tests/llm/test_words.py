"""Words as arrays against regular expressions."""

import re
import string

import numpy as np
import pyarrow as pa

from graphsieve.llm import words as w

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
PIECES = w.Lexis.of(gap=" \t", breaks=".,;:!?\n\x0b\x0c\r")
TERMS = w.Lexis.of(word=string.ascii_letters)


def texts():
    rng = np.random.default_rng(0)
    return [None, "", " ", *("".join(rng.choice(list("aAbB é.,; \n\t9-ß漢\xa0"), rng.integers(0, 30))) for _ in range(400)), "x" * 9000 + " yy " + "x" * 9000, ".,.", None]


def test_terms_and_hashes():
    for column in (pa.array(texts()), pa.array(texts()).slice(7, 200), pa.array([], pa.string()), pa.array([None, ""], pa.string())):
        found = w.words_of(column, TERMS)
        want = [(i, t) for i, s in enumerate(column.to_pylist()) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (s or "").translate(LOWER))]
        assert [*zip(found.text.tolist(), found.strings().to_pylist(), strict=True)] == want
        known: dict = {}
        for (_, t), h in zip(want, found.hashes().tolist(), strict=True):
            assert known.setdefault(t, h) == h
        assert len({*known.values()}) == len(known)
        assert np.diff(found.first()).tolist() == [sum(i == k for i, _ in want) for k in range(len(column))]


def test_pieces_and_phrases():
    want = []
    for i, s in enumerate(texts()):
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (s or "").translate(LOWER)):
            own = re.findall(r"[^\x20\x09]+", piece)
            want += [(i, t, k < len(own) - 1) for k, t in enumerate(own)]
    found = w.words_of(pa.array(texts()), PIECES)
    assert [*zip(found.text.tolist(), found.strings().to_pylist(), found.joined.tolist(), strict=True)] == want
    at = np.flatnonzero(found.joined)
    assert found.phrases(at, 2).to_pylist() == [f"{want[i][1]} {want[i + 1][1]}" for i in at]
    assert found.phrases(np.zeros(0, np.int64), 3).to_pylist() == []
    assert len(w.grams(found.hashes(), 2)) == len(want) - 1 and not len(w.grams(found.hashes()[:1], 2))


def test_chunks_of_hashes(monkeypatch):
    column = pa.array(texts())
    whole = w.words_of(column, TERMS).hashes()
    w.powers.cache_clear()
    monkeypatch.setattr(w, "CHUNK", w.LONG)
    assert (w.words_of(column, TERMS).hashes() == whole).all()
    w.powers.cache_clear()
