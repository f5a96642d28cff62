"""Packing: harmonic bins of token pieces, filled by each worker on its own.

A document's ids are cut into pieces. Whole sequences come off first. Of what remains, the largest
reciprocal part of the capacity (``capacity // k`` for a whole ``k``) comes off, twice at most; the rest
is one more piece. A piece no longer than ``capacity // k``, but longer than ``capacity // (k + 1)``,
belongs to class ``k``, and each bin of class ``k`` takes exactly ``k`` pieces. As most pieces are exactly
as long as their class allows, full bins hold almost no padding. A worker keeps one open bin a class;
at the end of its partition the open bins' ids are laid end to end and cut anew, and the last, short
stretch is cut into powers of two, which need no padding. No shuffle, and memory for some 60 open bins.

Null and empty texts are one piece with the end id alone. Repeated rows are packed as often as they occur.
An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from graphsieve.llm.common import slices, texts
from graphsieve.llm.tokens import ids_of

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, n_pieces_class long"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
#: Sequence ids: partition, then class (0: bins laid together at the end), then the bin's number.
CLASS_BITS, BIN_BITS = 12, 28


def cuts(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of ``n`` ids, in order."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    for _ in range(2):
        if rest:
            part = capacity // -(-capacity // rest)
            out.append(part)
            rest -= part
    return out + [rest] * bool(rest)


def kind(length: int, capacity: int) -> int:
    """The class: how many pieces of this length fit into one bin."""
    return capacity // length


class Packer:
    """One worker's open bins. ``add`` and ``close`` return finished rows, in the order of NAMES."""

    def __init__(self, capacity: int, worker: int):
        self.capacity, self.base = capacity, worker << (CLASS_BITS + BIN_BITS)
        self.open: dict[int, list] = {}
        self.done: dict[int, int] = {}

    def bin_id(self, k: int, number: int) -> int:
        return self.base | k << BIN_BITS | number

    def add(self, doc, ids: np.ndarray) -> list[tuple]:
        rows, at, total = [], 0, len(ids)
        for length in cuts(total, self.capacity):
            piece = ids[at : at + length]
            k = kind(length, self.capacity)
            held = self.open.setdefault(k, [])
            held.append((doc, at, piece, total))
            at += length
            if len(held) == k:
                rows += self.flush(k, self.open.pop(k))
        return rows

    def flush(self, k: int, held: list) -> list[tuple]:
        number = self.done.get(k, 0)
        self.done[k] = number + 1
        sequence, offset, rows = self.bin_id(k, number), 0, []
        for doc, start, piece, total in held:
            rows.append((doc, start, len(piece), zlib.crc32(piece.astype("<u4").tobytes()), total, sequence, offset, k))
            offset += len(piece)
        return rows

    def close(self) -> list[tuple]:
        """The open bins, laid end to end and cut anew."""
        left = [x for k in sorted(self.open) for x in self.open[k]]
        self.open = {}
        size = sum(len(x[2]) for x in left)
        ends = [self.capacity] * (size // self.capacity)
        rest = size % self.capacity
        ends += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        rows, held, room = [], [], 0
        sizes = iter(ends)
        for doc, start, piece, total in left:
            while len(piece):
                if not room:
                    room = next(sizes)
                take = piece[:room]
                held.append((doc, start, take, total))
                room, start, piece = room - len(take), start + len(take), piece[len(take) :]
                if not room:
                    rows += self.flush(0, held)
                    held = []
        return rows


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: where it lies in its document, and in which sequence at which offset.

    ``tokenizer`` is the path of a tokenizers file that every executor has; ``end_id`` closes each document.
    Further columns of ``docs`` are ignored. Ids of sequences are unique and follow the partition that made them.
    """
    if not 1 <= capacity < 1 << CLASS_BITS:
        raise ValueError(f"capacity must be from 1 to {(1 << CLASS_BITS) - 1}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ids_of(tokenizer)
        packer = Packer(capacity, TaskContext.get().partitionId())
        end = np.array([end_id], known.dtype).tobytes()

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], NAMES)

        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows += packer.add(doc, np.frombuffer(known.encode(text) + end, known.dtype))
            if rows:
                yield out(rows)
        if rows := packer.close():
            yield out(rows)

    return texts(docs, id_col, text_col).mapInArrow(run, SCHEMA)
