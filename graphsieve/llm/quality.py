"""Quality classifier: a weak-label model over heuristic labellers, and a hashed linear scorer trained on it.

Eight overlapping labellers look at a text and vote bad (1), good (0) or not at all (2). How a document is
voted on is one of 3**8 patterns at most, so the patterns' counts over all documents are all that
expectation-maximisation needs: it estimates, for good and bad documents, how often each labeller votes
how, and from that each pattern's posterior. The posteriors label a bounded sample, on which a logistic
regression over hashed word shapes is trained; it scores every document and decides.

Null and empty texts get no vote and have no features; as nothing speaks against them they are kept
(score EMPTY_SCORE). Repeated rows are scored alike. Only the text is looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphsieve.llm.common import slices

#: Distinct texts on which the linear scorer is trained, about, drawn by a hash of the text: copies weigh once.
SAMPLE = 20_000
#: Hashed features; the linear model has a weight for each.
BUCKETS = 1 << 12
LABELLERS = ["shouting", "exclaiming", "symbols", "bare_symbols", "marked_words", "stuttering", "vocabulary", "one_word"]
BAD, GOOD, NONE = 1, 0, 2
EMPTY_SCORE = 1.0
#: Documents with a score below this are rejected.
KEEP = 0.5


def shape(word: str) -> str:
    """The word with letters as a or A, digits as 0, runs shortened to two, and punctuation as it is."""
    out = []
    for c in word:
        k = ("A" if c.isupper() else "a") if c.isalpha() else "0" if c.isdigit() else c
        if out[-2:] != [k, k]:
            out.append(k)
    return "".join(out)


class Words(dict):
    """Word to its feature times eight, and marks: bits for no letter or digit, three equal marks at the end, and ``!!`` there.

    A task has its own; long words are not kept, and only so many of the others.
    """

    def __missing__(self, word: str) -> int:
        bare = not any(c.isalnum() for c in word)
        tail = word[-3:]
        marked = len(word) > 3 and tail[0] == tail[1] == tail[2] and not tail[0].isalnum()
        found = zlib.crc32(shape(word).encode()) % (BUCKETS - 1) << 3 | bare | marked << 1 | word.endswith("!!") << 2
        if len(word) <= 64:
            if len(self) > 150_000:
                self.clear()
            self[word] = found
        return found


def vote(value: float, good: float, bad: float) -> int:
    """Bad from ``bad`` on, good up to ``good``, else none."""
    return BAD if value >= bad else GOOD if value <= good else NONE


def look(text: str, known: Words) -> tuple[int, np.ndarray, np.ndarray]:
    """The votes as a number to base three, and the features with their weights."""
    words = text.split()
    n = len(words)
    if not n:
        return 3 ** len(LABELLERS) - 1, np.zeros(0, np.int32), np.zeros(0, np.float32)
    seen = Counter(map(known.__getitem__, words))
    features: Counter = Counter()
    for k, c in seen.items():
        features[k >> 3] += c
    share = lambda bit: sum(c for k, c in seen.items() if k >> bit & 1) / n
    letters = text.encode()
    upper = len(letters) - len(letters.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lower = len(letters) - len(letters.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    symbols = len(letters) - len(letters.translate(None, b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))
    again = sum(map(eq, words, words[1:])) / n
    counts = Counter(words)
    long = n >= 30
    votes = [
        vote(upper / (upper + lower), 0.1, 0.4) if upper + lower >= 20 else NONE,
        vote(share(2), 0.0, 0.05),
        vote(symbols / len(text), 0.05, 0.09) if long else NONE,
        vote(share(0), 0.02, 0.1),
        vote(share(1), 0.0, 0.1),
        vote(again, 0.02, 0.1),
        vote(-len(counts) / n, -0.5, -0.3) if long else NONE,
        vote(max(counts.values()) / n, 0.12, 0.2) if long else NONE,
    ]
    at = np.fromiter(features.keys(), np.int32, len(features))
    weight = np.sqrt(np.fromiter(features.values(), np.float32, len(features)) / n)
    if again:
        at, weight = np.append(at, np.int32(BUCKETS - 1)), np.append(weight, np.float32(np.sqrt(again)))
    return int(sum(v * 3**i for i, v in enumerate(votes))), at, weight


def unpack(pattern: np.ndarray) -> np.ndarray:
    """The votes of patterns, a column for each labeller."""
    return pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


class LabelModel:
    """Two classes, good and bad; labellers vote independently within a class.

    ``rates[k, i, v]``: how often labeller ``i`` votes ``v`` on documents of class ``k`` (1: bad).
    """

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, smooth: float = 0.5):
        votes, n = unpack(patterns), counts.astype(float)
        # to begin with, each bad vote halves the trust
        bad = np.clip(1 - 0.5 ** (votes == BAD).sum(1), 0.02, 0.98)
        for _ in range(rounds):
            self.prior = np.clip(np.array([(n * (1 - bad)).sum(), (n * bad).sum()]) / max(n.sum(), 1), 1e-6, 1 - 1e-6)
            self.rates = np.zeros((2, len(LABELLERS), 3))
            for k, p in enumerate((1 - bad, bad)):
                for v in range(3):
                    self.rates[k, :, v] = ((n * p)[:, None] * (votes == v)).sum(0)
            self.rates = (self.rates + smooth) / (self.rates.sum(2, keepdims=True) + 3 * smooth)
            new = self.posterior(patterns)
            if len(bad) and np.abs(new - bad).max() < 1e-9:
                break
            bad = new

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """The probability of bad. A labeller that doesn't vote says nothing."""
        votes = unpack(patterns)
        told = np.zeros((len(patterns), 2))
        for k in range(2):
            spoken = self.rates[k, :, :2] / self.rates[k, :, :2].sum(1, keepdims=True)
            for i in range(len(LABELLERS)):
                told[:, k] += np.where(votes[:, i] < NONE, np.log(spoken[i][np.minimum(votes[:, i], 1)]), 0)
        told += np.log(self.prior)
        return 1 / (1 + np.exp(np.clip(told[:, 0] - told[:, 1], -500, 500)))

    def accuracy(self) -> dict[str, float]:
        """How often each labeller is right when it votes."""
        spoken = self.rates[:, :, :2] * self.prior[:, None, None]
        right = spoken[0, :, GOOD] + spoken[1, :, BAD]
        return dict(zip(LABELLERS, (right / spoken.sum((0, 2))).tolist(), strict=True))


def fit_linear(rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, epochs: int = 60, rate: float = 0.5, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression towards soft labels by full-batch Adagrad, both classes weighing the same."""
    weights, bias, grown, grown_bias = np.zeros(BUCKETS), 0.0, np.full(BUCKETS, 1e-6), 1e-6
    if not rows:
        return weights, 4.0
    at, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]).astype(float)
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    mass = np.where(good >= 0.5, 0.5 / max(1, (good >= 0.5).sum()), 0.5 / max(1, (good < 0.5).sum()))
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights[at] * value, len(rows)) + bias, -30, 30)))
        error = (p - good) * mass
        slope = np.bincount(at, error[row] * value, BUCKETS) + decay * weights
        grown += slope**2
        weights -= rate * slope / np.sqrt(grown)
        grown_bias += error.sum() ** 2
        bias -= rate * error.sum() / np.sqrt(grown_bias)
    return weights, float(bias)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, keep_columns: bool = False) -> DataFrame:
    """doc_id, score (0 to 1, higher: better), posterior (of good, by the labellers alone), keep: a row for each row.

    With ``keep_columns`` all columns of ``docs`` instead of the id, and ``score``, ``posterior``, ``keep`` under names with a leading ``q_`` (more, where such a column exists).
    """
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in slices(batches):
            patterns = [look(t or "", known)[0] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(patterns, pa.int32())], ["pattern"])

    patterns = source.select("text").mapInArrow(votes, "pattern int").groupBy("pattern").count().toArrow()  # 3**8 rows at most
    keys, counts = patterns.column("pattern").to_numpy().astype(np.int64), patterns.column("count").to_numpy()
    model = LabelModel(keys, counts)
    bad = dict(zip(keys.tolist(), model.posterior(keys).tolist(), strict=True))

    total = source.agg(F.approx_count_distinct(F.xxhash64("text"))).first()[0]
    scale = 1 << 30
    # about ``sample`` distinct texts, as a hash deals them, however many copies each has
    drawn = source.select("text").where(F.pmod(F.xxhash64("text"), F.lit(scale)) < int(min(1, sample / max(1, total)) * scale)).distinct()

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in slices(batches):
            seen = [look(t or "", known) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([s[0] for s in seen], pa.int32()), pa.array([s[1] for s in seen], pa.list_(pa.int32())), pa.array([s[2] for s in seen], pa.list_(pa.float32()))], ["pattern", "at", "weight"])

    got = drawn.mapInArrow(features, "pattern int, at array<int>, weight array<float>").toArrow()
    rows = [(np.array(a, np.int32), np.array(w, np.float32)) for a, w in zip(got.column("at").to_pylist(), got.column("weight").to_pylist(), strict=True)]
    weights, bias = fit_linear(rows, np.array([1 - bad[p] for p in got.column("pattern").to_pylist()]))

    def judge(text: str | None, known: Words) -> tuple[float, float, bool]:
        pattern, at, weight = look(text or "", known)
        if not len(at):
            return EMPTY_SCORE, 1 - bad[pattern], True
        value = float(1 / (1 + np.exp(-np.clip(weights[at] @ weight + bias, -30, 30))))
        return value, 1 - bad[pattern], value >= KEEP

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in slices(batches, text_col if keep_columns else "text"):
            texts = batch.column(batch.schema.get_field_index(text_col if keep_columns else "text")).to_pylist()
            score, posterior, kept = zip(*(judge(t, known) for t in texts), strict=True)
            own = [pa.array(score, pa.float64()), pa.array(posterior, pa.float64()), pa.array(kept, pa.bool_())]
            held = [batch.columns, batch.schema.names] if keep_columns else [[batch.column("doc_id")], ["doc_id"]]
            yield pa.RecordBatch.from_arrays([*held[0], *own], [*held[1], *names])

    lead = "q_"
    while any(f"{lead}{c}" in docs.columns for c in ("score", "posterior", "keep")):
        lead += "q_"
    names = [f"{lead}{c}" for c in ("score", "posterior", "keep")] if keep_columns else ["score", "posterior", "keep"]
    chosen = docs if keep_columns else source
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in (docs.schema if keep_columns else source.select("doc_id").schema)]
    return chosen.mapInArrow(apply, ", ".join([*kinds, f"{names[0]} double", f"{names[1]} double", f"{names[2]} boolean"]))


def good_only(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that the scorer keeps, with their columns."""
    scored = score(docs, id_col, text_col, keep_columns=True, **options)
    return scored.where(F.col(scored.columns[-1])).select(*(F.col(f"`{c}`") for c in docs.columns))
