"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as a hashed word vector beside the mean of its hashed character n-gram vectors (3 to 5
characters, with marks at its ends), so inflected or unseen forms still have an input. A gated recurrent
unit reads a window of WINDOW words in each direction; attention weighs its states; a linear unit scores the
window. A window begins every STRIDE words, so neighbours overlap by WINDOW - STRIDE; all of a text's windows are
scored, and the highest one is the text's. A word of any length is read CHUNK characters at a time.

Only texts are inputs. Training is on a bounded sample of labelled documents: at most DOCUMENTS distinct toxic texts
and three times as many others, drawn by a hash of the text among the documents at hand, so that copies weigh once;
all windows of their whole texts count. A label tells only that some window of a toxic document
is toxic. So the vectors' first component starts as the log odds of the word or n-gram among toxic and other
documents of the sample; of a toxic document those windows count that stand out, first by these odds, then by
the network itself, and of the others all windows. A fifth of the sample is not learnt from; the
logit is shifted so that 0.7 lies between its two classes. Training runs in one task, as its sample is bounded.

Null and empty texts have one window without words, which gets what the network says of no words.
Documents that no label mentions are scored like the others; labels that contradict each other, on an id or on
copies of a text, count as toxic. Without labels of both kinds every text gets the same score.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphsieve.llm.common import slices, texts

WINDOW, STRIDE = 32, 24
HIDDEN, ATTENTION, WORD_DIM, CHAR_DIM = 8, 8, 4, 8
WORD_BUCKETS, CHAR_BUCKETS = 1 << 18, 1 << 16
#: The bound of the training sample: so many distinct toxic texts and three times as many others.
DOCUMENTS = 1200
#: How often a word's own vector is left out in training, so that its characters must do.
LEFT_OUT = 0.3
THRESHOLD = 0.7
#: What a task keeps of the words it has seen: their number, and their characters.
KEPT_WORDS, KEPT_CHARS = 150_000, 4 << 20
#: Characters whose n-grams are worked out at once.
CHUNK = 1 << 16
EDGES = "\"'.,;:!?()[]{}<>|*#$%&-_/\\«»„“”’…"


def clean(word: str) -> str:
    return word.strip(EDGES) or word


def chunks(words: list[str]) -> Iterator[tuple[np.ndarray, list[str], np.ndarray]]:
    """The marked words in runs of about CHUNK characters: word numbers, strings, and how many n-grams of each length begin in a string.

    A longer word is cut; its pieces overlap by the four characters that n-grams reach beyond a piece.
    """
    number, held, starts, size = [], [], [], 0
    for i, word in enumerate(words):
        marked = f"^{word}$"
        for at in range(0, len(marked), CHUNK):
            piece = marked[at : at + CHUNK + 4]
            number.append(i)
            held.append(piece)
            starts.append(min(CHUNK, len(marked) - at))
            size += len(piece)
            if size >= CHUNK:
                yield np.array(number), held, np.array(starts)
                number, held, starts, size = [], [], [], 0
    if held:
        yield np.array(number), held, np.array(starts)


def grams(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the words' character n-grams, chunk by chunk, and the word of each, ascending."""
    for number, held, starts in chunks(words):
        lengths = np.array([len(x) for x in held])
        codes = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.repeat(np.cumsum(lengths) - lengths, lengths)
        place = np.arange(len(codes)) - first
        inside, left = place < np.repeat(starts, lengths), np.repeat(lengths, lengths) - place
        word = np.repeat(number, lengths)
        found, owner = [], []
        for n in (3, 4, 5):
            at = np.flatnonzero(inside & (left >= n))
            hashed = np.full(len(at), n, np.uint32)
            for i in range(n):
                hashed = (hashed ^ codes[at + i]) * np.uint32(0x85EBCA6B)
                hashed ^= hashed >> np.uint32(15)
            found.append((hashed % np.uint32(CHAR_BUCKETS)).astype(np.int32))
            owner.append(word[at])
        owner = np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        yield np.concatenate(found)[order], owner[order]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def spans(n: int) -> list[int]:
    """Where windows begin in a text of ``n`` words: every STRIDE words, until one reaches the end."""
    return [*range(0, max(1, n - WINDOW + STRIDE), STRIDE)]


@dataclass
class Lexicon:
    """Distinct words and how they are spelt without marks at the edges; row 0 stands for no word."""

    words: dict[str, int] = field(default_factory=dict)
    plain: list[str] = field(default_factory=lambda: ["-"])

    def row(self, word: str) -> int:
        at = self.words.get(word)
        if at is None:
            at = self.words[word] = len(self.plain)
            self.plain.append(clean(word))
        return at

    def buckets(self, start: int = 0) -> np.ndarray:
        """The words' own buckets, from word ``start`` on."""
        return np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORD_BUCKETS for w in self.plain[start:]])

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word buckets, gram buckets end to end, and the word of each."""
        found = [*grams(self.plain)]
        return self.buckets(), np.concatenate([g for g, _ in found]), np.concatenate([o for _, o in found]).astype(np.int32)


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        h2, dim = 2 * HIDDEN, WORD_DIM + CHAR_DIM
        #: Hidden-to-gate weights keep the directions apart.
        self.apart = np.zeros((h2, 3, h2), np.float32)
        self.apart[:HIDDEN, :, :HIDDEN] = self.apart[HIDDEN:, :, HIDDEN:] = 1
        self.p = {
            "word": draw(WORD_BUCKETS, WORD_DIM, scale=0.02),
            "gram": draw(CHAR_BUCKETS, CHAR_DIM, scale=0.05),
            "forward": draw(dim, 3 * HIDDEN, scale=0.3),
            "backward": draw(dim, 3 * HIDDEN, scale=0.3),
            "forward_bias": np.zeros(3 * HIDDEN, np.float32),
            "backward_bias": np.zeros(3 * HIDDEN, np.float32),
            "hidden": draw(h2, 3 * h2, scale=0.3) * self.apart.reshape(h2, -1),
            "attend": draw(h2, ATTENTION, scale=0.3),
            "attend_bias": np.zeros(ATTENTION, np.float32),
            "query": draw(ATTENTION, scale=0.5),
            "out": draw(h2, scale=0.3),
            "bias": np.zeros(1, np.float32),
        }
        self.shift = 0.0

    def inputs(self, lexicon_arrays: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """The input vector of each word."""
        bucket, gram, owner = lexicon_arrays
        return self.joined(bucket, [(gram[at : at + (1 << 20)], owner[at : at + (1 << 20)]) for at in range(0, len(gram), 1 << 20)])

    def joined(self, bucket: np.ndarray, spelt: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Own vectors of words beside the means of their n-grams', which come in parts (gram buckets and, ascending, the word of each)."""
        sums, times = np.zeros((len(bucket), CHAR_DIM)), np.zeros(len(bucket))
        for gram, owner in spelt:
            if len(owner):
                low, high = owner[0], owner[-1] + 1
                at, n = owner - low, high - low
                times[low:high] += np.bincount(at, minlength=n)
                for d in range(CHAR_DIM):
                    sums[low:high, d] += np.bincount(at, self.p["gram"][gram, d], n)
        return np.concatenate([self.p["word"][bucket], sums / np.maximum(times, 1)[:, None]], 1).astype(np.float32)

    def gates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each word gives to the forward and the backward gates."""
        return x @ self.p["forward"] + self.p["forward_bias"], x @ self.p["backward"] + self.p["backward_bias"]

    def logits(self, rows: np.ndarray, forward: np.ndarray, backward: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Scores of windows, given as rows of words (0: none) of the gate tables."""
        b, t = rows.shape
        h = np.zeros((b, 2 * HIDDEN), np.float32)
        mask = (rows > 0).astype(np.float32)
        states = np.zeros((t, b, 2 * HIDDEN), np.float32)
        steps = []
        for i in range(t):
            j = t - 1 - i
            g = np.concatenate([forward[rows[:, i]].reshape(b, 3, HIDDEN), backward[rows[:, j]].reshape(b, 3, HIDDEN)], 2)
            u = (h @ self.p["hidden"]).reshape(b, 3, 2 * HIDDEN)
            z, r = sigmoid(g[:, 0] + u[:, 0]), sigmoid(g[:, 1] + u[:, 1])
            n = np.tanh(g[:, 2] + r * u[:, 2])
            m = np.repeat(np.stack([mask[:, i], mask[:, j]], 1), HIDDEN, 1)
            new = h + m * (1 - z) * (n - h)
            if keep is not None:
                steps.append((h, z, r, n, u[:, 2], m))
            h = new
            states[i, :, :HIDDEN] = h[:, :HIDDEN]
            states[j, :, HIDDEN:] = h[:, HIDDEN:]
        u = np.tanh(states @ self.p["attend"] + self.p["attend_bias"])
        s = u @ self.p["query"] - 1e4 * (1 - mask.T)
        a = np.exp(s - s.max(0))
        a /= a.sum(0)
        pooled = (a[:, :, None] * states).sum(0)
        if keep is not None:
            keep |= {"steps": steps, "states": states, "u": u, "a": a, "pooled": pooled, "mask": mask}
        return pooled @ self.p["out"] + self.p["bias"][0]

    def whole_logits(self, rows: np.ndarray, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        """``logits`` for windows without gaps, in place where that saves time."""
        b, t = rows.shape
        h, g = np.zeros((b, 2 * HIDDEN), np.float32), np.empty((b, 3, 2 * HIDDEN), np.float32)
        states = np.empty((t, b, 2 * HIDDEN), np.float32)
        hidden, width = self.p["hidden"], 4 * HIDDEN
        with np.errstate(over="ignore"):
            for i in range(t):
                j = t - 1 - i
                g[:, :, :HIDDEN] = forward[rows[:, i]].reshape(b, 3, HIDDEN)
                g[:, :, HIDDEN:] = backward[rows[:, j]].reshape(b, 3, HIDDEN)
                flat = g.reshape(b, -1)
                u = h @ hidden
                both = u[:, :width] + flat[:, :width]
                np.negative(both, out=both)
                np.exp(both, out=both)
                both += 1
                np.reciprocal(both, out=both)
                n = u[:, width:]
                n *= both[:, 2 * HIDDEN :]
                n += flat[:, width:]
                np.tanh(n, out=n)
                # h moves towards n by 1 - z
                n -= h
                n *= 1 - both[:, : 2 * HIDDEN]
                h = h + n
                states[i, :, :HIDDEN] = h[:, :HIDDEN]
                states[j, :, HIDDEN:] = h[:, HIDDEN:]
        u = np.tanh(states.reshape(t * b, -1) @ self.p["attend"] + self.p["attend_bias"])
        s = (u @ self.p["query"]).reshape(t, b)
        a = np.exp(s - s.max(0))
        a /= a.sum(0)
        return np.einsum("tb,tbh->bh", a, states) @ self.p["out"] + self.p["bias"][0]

    def gradients(self, rows: np.ndarray, label: np.ndarray, weight: np.ndarray, lexicon_arrays, left: np.ndarray | None = None) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the weighted logistic loss: by parameter, and by the words' inputs.

        ``lexicon_arrays`` are those of the words in ``rows``; the own vectors of the words in ``left`` are left out.
        """
        p, k = self.p, {}
        x = self.inputs(lexicon_arrays)
        if left is not None:
            x[left, :WORD_DIM] = 0
        logit = self.logits(rows, *self.gates(x), keep=k)
        b, t = rows.shape
        out = {}
        d = ((sigmoid(logit) - label) * weight).astype(np.float32)
        out["bias"], out["out"] = d.sum(keepdims=True), k["pooled"].T @ d
        d_pooled = d[:, None] * p["out"]
        d_a = (k["states"] * d_pooled).sum(2)
        d_states = k["a"][:, :, None] * d_pooled
        d_s = k["a"] * (d_a - (k["a"] * d_a).sum(0))
        out["query"] = (d_s[:, :, None] * k["u"]).sum((0, 1))
        d_u = d_s[:, :, None] * p["query"] * (1 - k["u"] ** 2)
        out["attend"], out["attend_bias"] = np.tensordot(k["states"], d_u, ([0, 1], [0, 1])), d_u.sum((0, 1))
        d_states += d_u @ p["attend"].T
        d_hidden = np.zeros_like(p["hidden"])
        d_forward, d_backward = np.zeros((t, b, 3 * HIDDEN), np.float32), np.zeros((t, b, 3 * HIDDEN), np.float32)
        carry = np.zeros((b, 2 * HIDDEN), np.float32)
        for i in range(t - 1, -1, -1):
            j = t - 1 - i
            h, z, r, n, u2, m = k["steps"][i]
            carry[:, :HIDDEN] += d_states[i, :, :HIDDEN]
            carry[:, HIDDEN:] += d_states[j, :, HIDDEN:]
            d_new = m * carry
            d_n = d_new * (1 - z) * (1 - n**2)
            d_z = d_new * (h - n) * z * (1 - z)
            d_r = d_n * u2 * r * (1 - r)
            d_g = np.stack([d_z, d_r, d_n], 1)
            d_h = np.concatenate([d_z, d_r, d_n * r], 1)
            d_hidden += h.T @ d_h
            carry = carry - d_new * (1 - z) + d_h @ p["hidden"].T
            d_forward[i] = d_g[:, :, :HIDDEN].reshape(b, -1)
            d_backward[j] = d_g[:, :, HIDDEN:].reshape(b, -1)
        out["hidden"] = d_hidden * self.apart.reshape(2 * HIDDEN, -1)
        words = rows.T.ravel()
        df, db = d_forward.reshape(t * b, -1), d_backward.reshape(t * b, -1)
        out["forward"], out["backward"] = x[words].T @ df, x[words].T @ db
        out["forward_bias"], out["backward_bias"] = df.sum(0), db.sum(0)
        d_x = np.zeros_like(x)
        np.add.at(d_x, words, df @ p["forward"].T + db @ p["backward"].T)
        d_x[0] = 0
        if left is not None:
            d_x[left, :WORD_DIM] = 0
        return out, d_x


def add_up(at: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, and the sum of the values for each."""
    rows, where = np.unique(at, return_inverse=True)
    return rows, np.stack([np.bincount(where, value[:, d], len(rows)) for d in range(value.shape[1])], 1).astype(np.float32)


def log_odds(seen: Iterable[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, present: np.ndarray, n: int) -> np.ndarray:
    """For each bucket the smoothed log odds of its documents among the toxic and the other ones, a third of them.

    ``seen``: buckets and the document of each, in parts that no document spans.
    """
    yes, no = np.zeros(n), np.zeros(n)
    for bucket, document in seen:
        pairs = np.unique(document.astype(np.int64) * n + bucket)
        kind, of = toxic[pairs // n], pairs % n
        yes += np.bincount(of[kind], minlength=n)
        no += np.bincount(of[~kind], minlength=n)
    out = np.log((yes + 0.5) / (toxic[present].sum() + 1)) - np.log((no + 0.5) / ((~toxic[present]).sum() + 1))
    # what only one document has says little
    return np.where(yes + no > 1, np.clip(out / 3, -2, 2), 0).astype(np.float32)


def windows_of(texts: Iterable[str], lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts as rows of the lexicon's words, and the text of each."""
    rows, of = [np.zeros((0, WINDOW), np.int32)], [np.zeros(0, np.int64)]
    for i, text in enumerate(texts):
        at = [lexicon.row(w) for w in text.lower().split()]
        flat = np.zeros(spans(len(at))[-1] + WINDOW, np.int32)
        flat[: len(at)] = at
        rows.append(np.lib.stride_tricks.sliding_window_view(flat, WINDOW)[::STRIDE].copy())
        of.append(np.full(len(rows[-1]), i))
    return np.concatenate(rows), np.concatenate(of)


def train(texts: Iterable[str], toxic: np.ndarray, passes: int = 4, rate: float = 0.01, seed: int = 7) -> Network:
    """A network from whole texts and their labels."""
    net, rng = Network(seed), np.random.default_rng(seed)
    if toxic.all() or not toxic.any():
        net.p["out"][:] = 0
        net.p["bias"][:] = 4 if len(toxic) and toxic.all() else -4
        return net
    lexicon = Lexicon()
    rows, doc = windows_of(texts, lexicon)
    lexicon.words.clear()
    bucket, gram, owner = lexicon.arrays()
    lexicon.plain.clear()
    counts = np.bincount(owner, minlength=len(bucket))
    first = np.cumsum(counts) - counts
    label = toxic[doc].astype(np.float32)
    # every fifth document of each class only tells where to cut
    aside = np.zeros(len(toxic), bool)
    for kind in (True, False):
        own = np.flatnonzero(toxic == kind)
        if len(own) >= 10:
            aside[own[::5]] = True
    learnt = np.flatnonzero(~aside[doc])

    def gram_rows(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of words, and the word of each."""
        n = counts[words]
        return np.repeat(first[words] - np.cumsum(n) + n, n) + np.arange(n.sum()), np.repeat(np.arange(len(words)), n)

    def seen(spelling: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Buckets of the learnt documents' words, or of their n-grams, some windows at a time."""
        for some in np.split(learnt, np.flatnonzero(np.diff(doc[learnt] // 16)) + 1):
            pairs = np.unique(np.repeat(doc[some], WINDOW) * np.int64(len(bucket)) + rows[some].ravel())
            word, of = pairs % len(bucket), pairs // len(bucket)
            if spelling:
                spelt, whose = gram_rows(word)
                yield gram[spelt], of[whose]
            else:
                yield bucket[word], of

    present = np.unique(doc[learnt])
    odds = {"word": log_odds(seen(False), toxic, present, WORD_BUCKETS), "gram": log_odds(seen(True), toxic, present, CHAR_BUCKETS)}
    for name, value in odds.items():
        net.p[name][:, 0] += value
    batch = int(np.clip(len(learnt) // 80, 16, 256))
    dense = [k for k in net.p if k not in ("word", "gram")]
    mean, square, step = {k: np.zeros_like(net.p[k]) for k in dense}, {k: np.zeros_like(net.p[k]) for k in dense}, 0
    grown = {k: np.full(len(net.p[k]), 1e-3, np.float32) for k in ("word", "gram")}

    def all_logits() -> np.ndarray:
        tables = net.gates(net.inputs((bucket, gram, owner)))
        return np.concatenate([net.logits(rows[at : at + 2048], *tables) for at in range(0, len(rows), 2048)])

    for turn in range(passes):
        # at first the odds of the best word tell which windows stand out
        z = all_logits() if turn else (odds["word"][bucket] * (np.arange(len(bucket)) > 0))[rows].max(1)
        top = np.full(len(toxic), -np.inf)
        np.maximum.at(top, doc, z)
        stands_out = z >= (np.minimum(top[doc], 2.0) if turn else top[doc] - 0.2)
        chosen = learnt[((label == 0) | stands_out)[learnt]]
        share = np.clip(label[chosen].mean(), 0.02, 0.98)
        weight = np.where(label > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        rng.shuffle(chosen)
        for at in range(0, len(chosen), batch):
            some = chosen[at : at + batch]
            present, local = np.unique(np.append(rows[some].ravel(), 0), return_inverse=True)
            spelt, whose = gram_rows(present)
            left = np.flatnonzero(rng.random(len(present)) < LEFT_OUT)
            g, d_x = net.gradients(local[:-1].reshape(len(some), WINDOW), label[some], weight[some] / len(some), (bucket[present], gram[spelt], whose), left)
            step += 1
            for name, value in g.items():
                mean[name] = 0.9 * mean[name] + 0.1 * value
                square[name] = 0.99 * square[name] + 0.01 * value * value
                net.p[name] = net.p[name] - rate * (mean[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.99**step)) + 1e-8)
            for name, (where, slope) in {"word": add_up(bucket[present], d_x[:, :WORD_DIM]), "gram": add_up(gram[spelt], (d_x[:, WORD_DIM:] / counts[present][:, None])[whose])}.items():
                grown[name][where] += (slope**2).sum(1)
                net.p[name][where] -= rate * slope / np.sqrt(grown[name][where])[:, None]
    top = np.full(len(toxic), -np.inf)
    np.maximum.at(top, doc, all_logits())
    judged = aside if aside.any() and toxic[aside].any() else ~aside
    net.shift = float(-cut(top[judged], toxic[judged]))
    return net


def cut(top: np.ndarray, toxic: np.ndarray) -> float:
    """The logit between the classes: in the gap with the best F1, nearer to its lower side."""
    order = np.argsort(-top)
    hits = np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + toxic.sum())
    best = int(np.flatnonzero(f1 == f1.max())[-1])
    below = top[order[best + 1]] if best + 1 < len(order) else top[order[best]] - 2
    return float(below + (top[order[best]] - below) * 0.3)


class Scorer:
    """Scores whole texts; keeps the gate inputs of the words it has seen."""

    def __init__(self, net: Network):
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.lexicon = Lexicon()
        f, b = self.net.gates(np.zeros((1, WORD_DIM + CHAR_DIM), np.float32))
        self.forward, self.backward, self.known, self.chars = f, b, 1, 0

    def learn(self) -> None:
        """Gate inputs for the words that are new."""
        n = len(self.lexicon.plain)
        if n > self.known:
            words = self.lexicon.plain[self.known :]
            self.chars += sum(map(len, words))
            f, b = self.net.gates(self.net.joined(self.lexicon.buckets(self.known), grams(words)))
            if n > len(self.forward):
                grow = n + n // 4 - len(self.forward)
                self.forward = np.concatenate([self.forward, np.zeros((grow, 3 * HIDDEN), np.float32)])
                self.backward = np.concatenate([self.backward, np.zeros((grow, 3 * HIDDEN), np.float32)])
            self.forward[self.known : n], self.backward[self.known : n] = f, b
            self.lexicon.plain[self.known :] = [""] * (n - self.known)
            self.known = n

    def scores(self, batch: list[str]) -> np.ndarray:
        if len(self.lexicon.words) > KEPT_WORDS or self.chars > KEPT_CHARS:
            self.clear()
        known, row = self.lexicon.words, self.lexicon.row
        parts, owner = [], []
        for i, text in enumerate(batch):
            words = text.lower().split()
            at = [known[w] if w in known else row(w) for w in words]
            begins = spans(len(at))
            flat = np.zeros(begins[-1] + WINDOW, np.int32)
            flat[: len(at)] = at
            parts.append(np.lib.stride_tricks.sliding_window_view(flat, WINDOW)[::STRIDE])
            owner += [i] * len(begins)
        self.learn()
        rows = np.concatenate(parts)
        top, owner = np.full(len(batch), -np.inf), np.array(owner)
        full = rows[:, -1] > 0
        for whole, score in ((True, self.net.whole_logits), (False, self.net.logits)):
            some, of = rows[full == whole], owner[full == whole]
            for at in range(0, len(some), 1024):
                np.maximum.at(top, of[at : at + 1024], score(some[at : at + 1024], self.forward, self.backward))
        return sigmoid(top + self.net.shift + np.log(THRESHOLD / (1 - THRESHOLD)))


def sample(docs: DataFrame, labels: DataFrame, learn: Column, documents: int = DOCUMENTS) -> DataFrame:
    """text, is_toxic, h: at most ``documents`` distinct toxic texts and three times as many others, of those labelled among ``docs`` (doc_id, text)."""
    told = labels.where(learn & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).alias("is_toxic"))
    # only ids and hashes of texts move until the sample is drawn
    hashed = docs.withColumn("h", F.xxhash64("text"))
    kinds = hashed.select("doc_id", "h").join(told, "doc_id").groupBy("h").agg(F.max("is_toxic").alias("is_toxic"))
    drawn = [kinds.where(F.col("is_toxic") == kind).orderBy("h").limit(documents * (1 if kind else 3)) for kind in (True, False)]
    chosen = drawn[0].union(drawn[1])  # at most four times ``documents`` rows of a hash and a mark
    return hashed.join(F.broadcast(chosen), "h").groupBy("h").agg(F.first("text").alias("text"), F.first("is_toxic").alias("is_toxic"))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, **options) -> Network:
    """A network from the labelled rows that ``learn`` (a Column over doc_id) allows. ``docs`` has doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, SAMPLE)
        toxic = np.array(table.column("is_toxic").to_pylist(), bool)
        net = train((x.as_py() for x in table.column("text")), toxic)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], ["net"])

    rows = sample(texts(docs), labels.select("doc_id", "toxic"), learn, **options).repartition(1).sortWithinPartitions("h")
    got = rows.select("text", "is_toxic").mapInArrow(run, "net binary").first()
    return pickle.loads(got["net"]) if got else train([], np.zeros(0, bool))  # Spark drops what reads no rows


SAMPLE = pa.schema([("text", pa.string()), ("is_toxic", pa.bool_())])


def score(docs: DataFrame, net: Network, text_col: str = "text", name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score in a column ``name``, which ``docs`` must not have. A row for each row; no shuffle."""
    if name in docs.columns:
        raise ValueError(f"docs have a column {name} already")
    shared = docs.sparkSession.sparkContext.broadcast(net)  # some 6 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in slices(batches, text_col, most=2 << 20):
            found = scorer.scores([t or "" for t in batch.column(text_col).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, name])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return docs.mapInArrow(run, ", ".join([*kinds, f"`{name}` double"]))


def clean_only(docs: DataFrame, net: Network, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with their columns."""
    name = "toxicity"
    while name in docs.columns:
        name += "_"
    return score(docs, net, text_col, name).where(F.col(name) < threshold).select(*(F.col(f"`{c}`") for c in docs.columns))
