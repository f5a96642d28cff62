"""Byte-level BPE encoding and decoding by merge ranks.

A segment tree over a word's byte positions holds at each leaf the rank of the pair that begins there,
and at the root the least rank with its leftmost position. A merge changes three leaves (the merged
pair, the one that vanishes, the one before), so it costs three paths of logarithmic length; links to the
previous and next live position make the neighbours known. Words of like length form the rows of one array,
and every step merges in all of them at once. Long words, which are few, use the same tree one at a time.

Each distinct word is encoded once per worker while it stays in a bounded dictionary. Texts are cut
into words by the vocabulary's pattern. Null and empty texts have no ids.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphsieve.llm.common import slices, texts

#: No pair here.
NONE = np.int64(1) << 62
#: Words of more bytes than this are encoded one at a time, in some 60 bytes of memory for each of theirs, and are not kept.
LONG = 256
#: White space other than the plain space and the newline, in the widest reading.
ODD_SPACE = re.compile(r"[^\S \n]")
SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Pieces of plain characters, which the standard library's expressions can take apart as the tokenizer does.
PLAIN = re.compile("[\\n -~À-ÖØ-öø-ÿ]*")
#: The byte-level pattern for those characters alone.
MATCHES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+")


def pieces(text: str) -> list[str]:
    """The text cut before each space that starts a match: all but the first piece lack that space.

    A space between two characters that are not white space always starts a new match of the byte-level pattern.
    """
    if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or ODD_SPACE.search(text):
        return SAFE_SPACE.split(text)
    return text.split(" ")


class Bpe:
    def __init__(self, path: str, pattern: str, most: int = 120_000):
        """``path``: lines of a base64 token and its rank. About ``most`` pieces and twice as many words stay encoded."""
        import regex

        self.ranks = read_ranks(path)
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.pattern, self.most = regex.compile(pattern), most
        self.plain = pattern == BYTE_PATTERN
        self.width = max(self.tokens) + 1
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        found = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    found[a * self.width + b] = rank
        self.keys = np.array(sorted(found), np.int64)
        self.values = np.array([found[k] for k in self.keys.tolist()], np.int64)
        self.words: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair; NONE for those that never merge."""
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def encode_rows(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words of 2 to LONG bytes, all at once."""
        n, most = len(words), max(map(len, words))
        size = 1 << (most - 1).bit_length()
        length = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(size, b"\0") for w in words), np.uint8).reshape(n, size)
        token = self.single[raw]
        place = np.arange(size)
        following = np.tile(place + 1, (n, 1))
        before = np.tile(place - 1, (n, 1))
        live = place < length[:, None]
        tree = np.full((n, 2 * size), NONE)
        ranks = self.pair_ranks(token[:, :-1], token[:, 1:])
        ok = (ranks < NONE) & live[:, 1:]
        tree[:, size:-1] = np.where(ok, ranks * size + place[:-1], NONE)
        level = size
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            root = tree[rows, 1]
            i = root % size
            j = following[rows, i]
            k = following[rows, j]
            token[rows, i] = root // size
            live[rows, j] = False
            following[rows, i] = k
            more = k < length[rows]
            before[rows[more], k[more]] = i[more]
            at = np.where(more, k, 0)
            right = np.where(more, self.pair_ranks(token[rows, i], token[rows, at]), NONE)
            p = before[rows, i]
            has = p >= 0
            p = np.where(has, p, i)
            left = self.pair_ranks(token[rows, p], token[rows, i])
            tree[rows, size + j] = NONE
            tree[rows[has], size + p[has]] = np.where(left[has] < NONE, left[has] * size + p[has], NONE)
            tree[rows, size + i] = np.where(right < NONE, right * size + i, NONE)
            a, b, c = size + i, size + j, size + p
            while a[0] > 1:
                for nodes in (a, b, c):
                    nodes >>= 1
                    tree[rows, nodes] = np.minimum(tree[rows, 2 * nodes], tree[rows, 2 * nodes + 1])
            rows = rows[tree[rows, 1] < NONE]
        ids = token[live]
        return np.split(ids.astype("<u4"), np.cumsum(live.sum(1))[:-1])

    def encode_long(self, word: bytes) -> np.ndarray:
        """The same for one word of any length."""
        n = len(word)
        size = 1 << (n - 1).bit_length()
        token = self.single[np.frombuffer(word, np.uint8)]
        ranks = self.pair_ranks(token[:-1], token[1:])
        none = int(NONE)
        tree = np.full(2 * size, NONE)
        tree[size : size + n - 1] = np.where(ranks < NONE, ranks * size + np.arange(n - 1), NONE)
        level = size
        while level > 1:
            tree[level // 2 : level] = np.minimum(tree[level : 2 * level : 2], tree[level + 1 : 2 * level : 2])
            level //= 2
        tree, token = array("q", tree.tobytes()), array("q", token.tobytes())
        following, before, live = array("q", range(1, n + 1)), array("q", range(-1, n - 1)), bytearray(b"\1" * n)

        def put(at: int, a: int, b: int) -> None:
            rank = self.ranks.get(self.tokens[a] + self.tokens[b]) if b >= 0 else None
            node = size + at
            tree[node] = none if rank is None else rank * size + at
            while node > 1:
                node >>= 1
                x, y = tree[2 * node], tree[2 * node + 1]
                tree[node] = x if x < y else y

        while tree[1] < none:
            rank, i = divmod(tree[1], size)
            j = following[i]
            k = following[j]
            token[i], live[j], following[i] = rank, 0, k
            if k < n:
                before[k] = i
            put(j, 0, -1)
            put(i, rank, token[k] if k < n else -1)
            if before[i] >= 0:
                put(before[i], token[before[i]], rank)
        return np.array([t for t, on in zip(token, live, strict=True) if on], "<u4")

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of distinct words, as little-endian unsigned 32-bit bytes."""
        out: dict[str, bytes] = {}
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            data = word.encode()
            if data in self.ranks:
                out[word] = np.array([self.ranks[data]], "<u4").tobytes()
            elif len(data) > LONG:
                out[word] = self.encode_long(data).tobytes()
            else:
                groups.setdefault(1 << (len(data) - 1).bit_length(), []).append((word, data))
        for size, held in groups.items():
            step = max(1, (1 << 18) // size)
            for at in range(0, len(held), step):
                block = held[at : at + step]
                for (word, _), ids in zip(block, self.encode_rows([d for _, d in block]), strict=True):
                    out[word] = ids.tobytes()
        return out

    def split(self, spaced: str) -> list[str]:
        """The pattern's matches in a piece."""
        return MATCHES.findall(spaced) if self.plain and PLAIN.fullmatch(spaced) else self.pattern.findall(spaced)

    def encode_batch(self, batch: list[str]) -> list[bytes]:
        """Ids of whole texts, as little-endian unsigned 32-bit bytes."""
        if len(self.known) > self.most:
            self.known.clear()
        if len(self.words) > 2 * self.most:
            self.words.clear()
        cut, firsts, fresh = [], [], set()
        for text in batch:
            if not self.plain:
                first, rest = text, []
            else:
                first, *rest = pieces(text) if text else [""]
            firsts.append(self.split(first))
            cut.append(rest)
            fresh.update(rest)
        fresh -= self.known.keys()
        parts = {p: self.split(" " + p) for p in fresh}
        missing = {w for ws in parts.values() for w in ws}
        missing.update(w for ws in firsts for w in ws)
        missing -= self.words.keys()
        self.words.update(self.encode_words(missing))
        word = self.words.__getitem__
        for p, ws in parts.items():
            self.known[p] = b"".join(map(word, ws))
        out = [b"".join(map(word, first)) + b"".join(map(self.known.__getitem__, rest)) for first, rest in zip(firsts, cut, strict=True)]
        for kept in (self.known, self.words):  # what is long goes again
            for x in [x for x in (parts if kept is self.known else missing) if len(x) > LONG]:
                del kept[x]
        return out

    def decode(self, ids: bytes) -> bytes:
        return to_bytes(self.tokens, ids)


def to_bytes(tokens: dict[int, bytes], ids: bytes) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks, from lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


#: The pattern for which a single space between other characters always begins a match.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_shared: dict[tuple, Bpe] = {}


def bpe_of(path: str, pattern: str) -> Bpe:
    """One encoder for each Python worker."""
    if (path, pattern) not in _shared:
        _shared[path, pattern] = Bpe(path, pattern)
    return _shared[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str = BYTE_PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``ids``, the text's ids as little-endian unsigned 32-bit bytes. A row for each row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(path, pattern)
        for batch in slices(batches, most=2 << 20):
            ids = bpe.encode_batch(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of ``encode`` with ``data``, the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {v: k for k, v in read_ranks(path).items()}
        for batch in slices(batches, "ids", most=8 << 20):
            data = [to_bytes(tokens, x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(data, pa.binary())], ["doc_id", "ids", "data"])

    return encoded.mapInArrow(run, "doc_id long, ids binary, data binary")


