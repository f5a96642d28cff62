"""Words of batches of texts as arrays: where they lie, their hashes, their bytes.

A Lexis says which bytes make words, which separate them and which also end a piece of text. Bytes above
127 belong to words in all of them, so words found in UTF-8 bytes are those found among code points. Only A-Z is lower-cased.
A batch takes about eight times its bytes, hashes are made in chunks of CHUNK bytes, and no Python object is made for a word.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK = 1 << 20
#: Longer words are hashed one by one.
LONG = 4096
MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = 0x2545F4914F6CDD1D
WORD, GAP, BREAK = 0, 1, 2


@dataclass(frozen=True)
class Lexis:
    kinds: bytes  # WORD, GAP or BREAK for each byte

    @staticmethod
    def of(word: str = "", gap: str = "", breaks: str = "") -> Lexis:
        """Either the ASCII bytes that make words are listed, or (where ``word`` is empty) those that separate them; ``breaks`` end pieces."""
        kinds = bytearray([GAP if word else WORD] * 128 + [WORD] * 128)
        for chars, kind in ((word, WORD), (gap, GAP), (breaks, BREAK)):
            for c in chars:
                kinds[ord(c)] = kind
        return Lexis(bytes(kinds))


LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


@dataclass
class Words:
    """The words of some texts, end to end."""

    flat: np.ndarray  # the texts' bytes, A-Z lower-cased, and a byte after each text
    word: np.ndarray  # whether each of these belongs to a word
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray  # which text each is in
    joined: np.ndarray  # whether the next word is in the same piece of the same text
    n_texts: int

    def __len__(self) -> int:
        return len(self.start)

    def first(self) -> np.ndarray:
        """For each text the index of its first word, and at last the number of words."""
        return np.searchsorted(self.text, np.arange(self.n_texts + 1))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        out = np.empty(len(self), np.uint64)
        size = self.end - self.start
        for i in np.flatnonzero(size > LONG).tolist():
            out[i] = xxhash.xxh3_64_intdigest(self.flat[self.start[i] : self.end[i]].tobytes())
        short = np.flatnonzero(size <= LONG) if (size > LONG).any() else slice(None)
        s, e, got, at = self.start[short], self.end[short], [], 0
        power, inverse = powers(CHUNK)
        while at < len(s):
            stop = int(np.searchsorted(e, s[at] + CHUNK, "right"))
            low = s[at]
            part = np.zeros(e[stop - 1] - low + 1, np.uint64)
            np.cumsum((self.flat[low : e[stop - 1]].astype(np.uint64) + np.uint64(1)) * power[: len(part) - 1], out=part[1:])
            got.append((part[e[at:stop] - low] - part[s[at:stop] - low]) * inverse[s[at:stop] - low])
            at = stop
        if got:
            out[short] = np.concatenate(got)
        return mixed(out)

    def norm(self) -> tuple[np.ndarray, np.ndarray]:
        """The words' bytes with a space after each, and where each word begins (and the end)."""
        spaced, keep = self.flat.copy(), self.word.copy()
        spaced[self.end], keep[self.end] = 32, True  # after a word stands a byte that belongs to none
        return spaced[keep], np.concatenate([[0], np.cumsum(self.end - self.start + 1)])

    def strings(self) -> pa.LargeStringArray:
        """The words as strings."""
        return large_strings(np.concatenate([[0], np.cumsum(self.end - self.start)]), self.flat[self.word])

    def phrases(self, at: np.ndarray, n: int) -> pa.LargeStringArray:
        """``n`` words from each of these places on, joined by a space."""
        norm, begin = self.norm()
        length = begin[at + n] - begin[at] - 1
        parts = [np.zeros(0, np.uint8)]
        for low in range(0, len(at), 1 << 16):
            size = length[low : low + (1 << 16)]
            first = np.cumsum(size) - size
            parts.append(norm[np.repeat(begin[at[low : low + (1 << 16)]] - first, size) + np.arange(size.sum())])
        return large_strings(np.concatenate([[0], np.cumsum(length)]), np.concatenate(parts))


def large_strings(offsets: np.ndarray, data: np.ndarray) -> pa.LargeStringArray:
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


@lru_cache(1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        steps = np.full(n + 1, base, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of each number spread over all 64."""
    x = (x ^ (x >> np.uint64(32))) * MIX
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words that begin at each place, as far as ``n`` words follow."""
    size = max(0, len(hashes) - n + 1)
    out = np.full(size, n, np.uint64)
    for k in range(n):
        out = out * np.uint64(BASE) + hashes[k : k + size]
    return mixed(out)


def words_of(column: pa.Array, lexis: Lexis) -> Words:
    """The words of a column of strings; nulls have none."""
    column = pc.fill_null(column, "")
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    low, high = (int(offsets[0]), int(offsets[-1])) if len(column) else (0, 0)
    raw = np.frombuffer(column.buffers()[2], np.uint8)[low:high] if high > low else np.zeros(0, np.uint8)
    # after each text a byte that ends its last piece
    offsets = offsets - low + np.arange(len(offsets))
    raw = np.insert(raw, offsets[1:] - np.arange(1, len(offsets)), 0) if len(column) else raw
    kind = np.frombuffer(lexis.kinds, np.uint8)[raw]
    kind[offsets[1:] - 1] = BREAK
    word = kind == WORD
    edge = np.diff(word, prepend=False)
    places = np.flatnonzero(edge)
    start, end = places[::2].copy(), places[1::2].copy()
    joined = np.zeros(len(start), bool)
    if len(start) > 1:
        broken = np.flatnonzero(kind == BREAK)
        joined[:-1] = np.searchsorted(broken, start[1:]) == np.searchsorted(broken, end[:-1])
    return Words(LOWER[raw], word, start, end, np.searchsorted(offsets, start, "right") - 1, joined, len(column))
