"""Token-id output: shards of ids in document order, compressed by Re-Pair, with random access.

A shard is one row of a Parquet table; its ``payload`` is this format (little endian throughout):

    bytes 0-3    b"RPG1"
    bytes 4-27   six unsigned 32-bit numbers: vocabulary size, rules, stored symbols, documents, ids, symbol bytes (2 or 4)
    rules        left and right symbol of each rule, all left ones first, unsigned 32-bit
    lengths      how many ids each rule expands to, unsigned 32-bit
    offsets      where each document's symbols begin, and the end, unsigned 32-bit
    symbols      the compressed sequence

Symbols below the vocabulary size are ids, the others rules. Re-Pair works in rounds: each counts the
neighbouring pairs and replaces those that occur LEAST times or more by rules, the more frequent one first where two overlap,
until no pair occurs so often. A pair never spans two
documents, so document ``i`` is symbols[offsets[i]:offsets[i + 1]] and can be read without the others;
the rules' lengths lead to a position inside it.

Null and empty texts hold the end id alone. Null ids come first. Rows with equal ids are ordered by a hash of their text and
by where they were read, so that one id's many rows, copies too, fall into several partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphsieve.llm.common import slices, texts
from graphsieve.llm.tokens import ids_of

MAGIC = b"RPG1"
#: How often a pair must occur in a shard to become a rule, which takes 12 bytes; 2 leaves no pair that repeats.
LEAST = 8
#: Marks a document's last symbol while rules are sought.
END = np.uint32(1 << 31)
SHARD_SCHEMA = "part int, shard int, first_doc long, n_docs long, n_tokens long, doc_ids array<long>, payload binary"


def repair(ids: np.ndarray, last: np.ndarray, vocabulary: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, their document-end marks, and left, right and length of the rules; no pair that occurs ``least`` times is left.

    ``seq[i]`` and ``seq[i + 1]`` are pair ``i``. It is looked at again only while it may become a rule (``alive``): a pair of old
    symbols never gains an occurrence, so one that is too rare stays so.
    """
    seq, symbols = ids.astype(np.uint32), vocabulary
    seq[last] |= END
    lengths = np.ones(vocabulary, np.uint32)
    made = rules = np.zeros(0, np.uint64)  # rules as left << 32 | right, as they were made; sorted
    names = np.zeros(0, np.uint32)  # the symbols of ``rules``
    alive = ~last
    while len(at := np.flatnonzero(alive)):
        bits, low = symbols.bit_length(), len(at).bit_length()
        if 4 * len(at) > len(seq):
            pair = (seq[:-1].astype(np.uint64) << np.uint64(bits) | seq[1:] & ~END).take(at)
        else:
            pair = seq.take(at).astype(np.uint64) << np.uint64(bits) | seq.take(at + 1) & ~END
        if 2 * bits + low <= 64:
            pair <<= np.uint64(low)
            pair |= np.arange(len(at), dtype=np.uint64)
            pair.sort()
            pos = (pair & np.uint64((1 << low) - 1)).view(np.int64)
            pair >>= np.uint64(low)
        else:
            pos = np.argsort(pair, kind="stable")
            pair = pair[pos]
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        size, pair = np.diff(np.append(first, len(pos))), pair[first]
        name = pair >> np.uint64(bits) << np.uint64(32) | pair & np.uint64((1 << bits) - 1)
        known = np.minimum(np.searchsorted(rules, name), max(0, len(rules) - 1))
        has = rules[known] == name if len(rules) else np.zeros(len(name), bool)
        good = (size >= least) | has
        pos = at.take(pos[np.repeat(good, size)])
        name, size, has, known = name[good], size[good], has[good], known[good]
        kind = np.repeat(np.arange(len(size), dtype=np.int32), size)
        alive = np.zeros(len(seq), bool)
        alive[pos] = True
        # of overlapping occurrences of one pair, in a run of one symbol, every other counts, from the left
        if (own := name >> np.uint64(32) == name & np.uint64(0xFFFFFFFF)).any():
            some = np.flatnonzero(own[kind])
            place = np.arange(len(some))
            touching = np.concatenate([[False], (np.diff(pos[some]) == 1) & (np.diff(kind[some]) == 0)])
            skipped = some[(place - np.maximum.accumulate(np.where(touching, 0, place))) % 2 == 1]
            size = size - np.bincount(kind[skipped], minlength=len(size))
            rare = (size < least) & ~has
            alive[pos[some[rare[kind[some]]]]] = False
            counted = ~rare[kind]
            counted[skipped] = False
            pos, kind = pos[counted], kind[counted]
        if not len(pos):
            break
        # the most frequent pairs go first: an occurrence is replaced if no overlapping one has more
        rank = (size << 24) + (np.arange(len(size)) * 11400719 & 0xFFFFFF)
        weight = np.zeros(len(seq) + 2, np.int64)
        own = rank.take(kind)
        weight[pos + 1] = own
        chosen = np.flatnonzero((own > weight.take(pos)) & (own >= weight.take(pos + 2)))
        pos, kind = pos.take(chosen), kind.take(chosen)
        new = np.flatnonzero(~has & (np.bincount(kind, minlength=len(size)) >= least))
        symbol = np.zeros(len(size), np.uint32)
        if len(names):
            symbol[has] = names[known[has]]
        symbol[new] = np.arange(symbols, symbols + len(new))
        made = np.append(made, name[new])
        lengths = np.append(lengths, lengths[name[new] >> np.uint64(32)] + lengths[name[new] & np.uint64(0xFFFFFFFF)])
        order = np.argsort(rules := np.append(rules, name[new]))
        rules, names, symbols = rules[order], np.append(names, symbol[new])[order], symbols + len(new)
        put = symbol.take(kind)
        pos, put = pos[put > 0], put[put > 0]
        put |= seq[pos + 1] & END
        seq[pos] = put
        alive[pos] = put < END
        before = pos[pos > 0] - 1
        alive[before] = seq[before] < END
        keep = np.ones(len(seq), bool)
        keep[pos + 1] = False
        keep = np.flatnonzero(keep)
        seq, alive = seq.take(keep), alive.take(keep)
    return seq & ~END, seq >= END, (made >> np.uint64(32)).astype(np.uint32), (made & np.uint64(0xFFFFFFFF)).astype(np.uint32), lengths[vocabulary:]


def to_payload(parts: list[np.ndarray], vocabulary: int, least: int = LEAST) -> bytes:
    """The shard format for documents given as arrays of ids; none may be empty."""
    ids = np.concatenate(parts)
    last = np.zeros(len(ids), bool)
    last[np.cumsum([len(x) for x in parts]) - 1] = True
    seq, last, left, right, lengths = repair(ids, last, vocabulary, least)
    offsets = np.concatenate([[0], np.flatnonzero(last) + 1]).astype("<u4")
    width = 2 if vocabulary + len(left) <= 1 << 16 else 4
    head = np.array([vocabulary, len(left), len(seq), len(parts), len(ids), width], "<u4")
    return b"".join([MAGIC, *(x.astype("<u4").tobytes() for x in (head, left, right, lengths, offsets)), seq.astype(f"<u{width}").tobytes()])


class Shard:
    """Reads a payload; ``document(i)`` and ``slice(i, a, b)`` expand no more than they need."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a shard of token ids")
        self.vocabulary, rules, symbols, self.n_docs, self.n_ids, width = (int(x) for x in np.frombuffer(payload, "<u4", 6, 4))
        at = 28
        self.left, self.right, self.lengths = (np.frombuffer(payload, "<u4", rules, at + 4 * rules * i) for i in range(3))
        at += 12 * rules
        self.offsets = np.frombuffer(payload, "<u4", self.n_docs + 1, at)
        self.symbols = np.frombuffer(payload, f"<u{width}", symbols, at + 4 * (self.n_docs + 1))
        self.size = np.concatenate([np.ones(self.vocabulary, np.int64), self.lengths.astype(np.int64)])

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        seq = symbols.astype(np.uint32)
        while len(at := np.flatnonzero(seq >= self.vocabulary)):
            times = np.ones(len(seq), np.int64)
            times[at] = 2
            rule = seq[at] - self.vocabulary
            place = at + np.arange(len(at))
            seq = np.repeat(seq, times)
            seq[place], seq[place + 1] = self.left[rule], self.right[rule]
        return seq

    def document(self, i: int) -> np.ndarray:
        return self.expand(self.symbols[self.offsets[i] : self.offsets[i + 1]])

    def slice(self, i: int, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` of document ``i``: only the symbols that cover them are expanded."""
        symbols = self.symbols[self.offsets[i] : self.offsets[i + 1]]
        ends = np.cumsum(self.size[symbols])
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, end, "left") + 1
        skipped = int(ends[a - 1]) if a else 0
        return self.expand(symbols[a:b])[start - skipped : end - skipped]

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each document begins and the last one ends."""
        sums = np.concatenate([[0], np.cumsum(self.size[self.symbols])])
        return self.expand(self.symbols), sums[self.offsets]


def encode(docs: DataFrame, tokenizer: str, end_id: int = 2, shard_tokens: int = 1 << 19, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards of about ``shard_tokens`` ids in ascending order of the id column, a row each (SHARD_SCHEMA).

    One range shuffle puts the documents into order. ``part`` numbers the sorted partitions and ``shard``
    those inside one. A document lies in one shard, whatever its length. Pairs that occur ``least`` times in a shard become rules; with 2 none is left.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ids_of(tokenizer)
        vocabulary = known.tokenizer.get_vocab_size()
        end = np.array([end_id], known.dtype).tobytes()
        part, number, docs_held, parts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def shard() -> pa.RecordBatch:
            row = {"part": part, "shard": number, "first_doc": docs_held[0], "n_docs": len(parts), "n_tokens": size, "doc_ids": docs_held, "payload": to_payload(parts, vocabulary, least)}
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), kinds, strict=True)], list(row))

        for batch in slices(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.frombuffer(known.encode(text) + end, known.dtype)
                docs_held.append(doc)
                parts.append(ids)
                size += len(ids)
                if size >= shard_tokens:
                    yield shard()
                    number, docs_held, parts, size = number + 1, [], [], 0
        if parts:
            yield shard()

    keyed = texts(docs, id_col, text_col).withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = ["doc_id", "h", "row"]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, SHARD_SCHEMA)


def save(docs: DataFrame, path: str, tokenizer: str, **options) -> None:
    """Writes the shards of ``encode`` as Parquet; fails if the path exists."""
    encode(docs, tokenizer, **options).write.parquet(path)


def read(spark, path: str) -> DataFrame:
    """A row for each document of the files: doc_id, start, n_tokens and the ids' crc32.

    Shards are decoded where they lie; only small rows move. The starts are sums over the partitions' totals
    (a row for each of the writer's partitions) and, within a partition, over its shards.
    """
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, begins = Shard(row["payload"]).all()
                data = ids.astype("<u4").tobytes()
                n = row["n_docs"]
                crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * n, pa.int32()), pa.array([row["shard"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(begins[:-1], pa.int64()), pa.array(np.diff(begins), pa.int64()), pa.array(crcs, pa.int64())],
                    ["part", "shard", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    rows = shards.select("part", "shard", "doc_ids", "n_docs", "payload").mapInArrow(run, "part int, shard int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    sizes = shards.select("part", "shard", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = sizes.withColumn("within", within).join(parts.select("part", before.alias("before")), "part").select("part", "shard", (F.col("before") + F.col("within")).alias("base"))
    return rows.join(begins, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
