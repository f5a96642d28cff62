"""LM scoring: prediction by partial matching (PPM) over bytes, with escapes and symbol exclusion.

A text is its words, in lower case (A-Z), with a space after each, and an end. The context of a symbol is the ORDER symbols
before it, across words; start marks stand before the text. In a context, a
symbol that followed it ``c`` times in training has probability (1 - e) c / T, with T the sum of the symbols that followed; the others
get the escape probability e together and are coded in the next shorter context, where the symbols of the longer one are
excluded from all counts; below the empty context all symbols not seen at all are alike. Escapes are counted when each
occurrence in training is coded by all the others (one left out), in contexts of like T and number of symbols D; method C,
D / (T + D), is their prior. Code lengths add up to the log10 probability of the text.

Nothing is left out of the trie, and it is never in one place. A situation is a context of full length with its symbol; every
shorter context's counts are sums over situations that end alike. Situations are dealt into buckets by their contexts' last
three symbols, so all longer contexts with that ending meet. Contexts of two symbols at most, whose number the
alphabet bounds, are broadcast. Three steps, each a table or a shuffle:

1. Tasks count the situations and words of the training texts they read and send sums to buckets; each bucket is written down.
2. Documents are dealt into blocks by a hash. A block asks each bucket for its distinct situations and words, once,
   however often they occur in it; the bucket reads its part of the trie, codes what the blocks ask and answers in the order asked.
3. The answers meet the block's documents, where they add up to the texts' code lengths and base scores.

Rows that agree in id and text lie in one block. Null texts count as empty: one end token. Without training texts all
symbols are alike. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphsieve.llm.common import slices, texts, written

ORDER = 5
#: Contexts up to this order are broadcast, the others are dealt by so many of their last symbols and one more.
LOW = 2
#: Symbols that are no bytes of words stand for the start, the end of a word, and the end of the text.
START, WORD_END, TEXT_END = 9, 32, 10
#: 256 bytes without the six white-space ones, and the two ends.
ALPHABET = 252
#: A node is order << ORDER_SHIFT | context << 8 | symbol; a situation has the highest order and its bucket above that.
ORDER_SHIFT = 8 * (ORDER + 1)
BUCKET_SHIFT = ORDER_SHIFT + 4
#: Buckets of situations and of words.
BUCKETS, WORD_BUCKETS = 256, 512
#: Bytes of text in a block, about; symbols that are worked on at once; situations and words that a task sums before it sends them; situations coded at once.
BLOCK, STEP, HELD, PART = 6 << 20, 1 << 18, 1 << 21, 1 << 18
SITUATIONS, WORDS = 0, 1
#: Steps of T and D by which escapes are counted.
T_STEPS, D_STEPS = 32, 12
CELLS = (ORDER + 1) * 2 * T_STEPS * D_STEPS


def words_of(text: str) -> list[bytes]:
    """Words of a text in lower case (A-Z only), split at the six ASCII white-space bytes."""
    return text.encode().lower().split()


def symbols_of(texts_words: Iterable[list[bytes]]) -> np.ndarray:
    """All texts' symbols end to end: start marks, words and their ends, text end."""
    start = bytes([START]) * ORDER
    return np.frombuffer(b"".join(start + b" ".join(words) + (b" \n" if words else b"\n") for words in texts_words), np.uint8)


def situations(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where symbols are coded, and the situation there: bucket, order, context, symbol."""
    one = flat.astype(np.int64)
    two = one.copy()
    two[1:] |= one[:-1] << 8
    code = two.copy()
    for back in range(2, ORDER + 1, 2):
        code[back:] |= two[:-back] << (8 * back)
    code &= (1 << (8 * ORDER + 8)) - 1
    at = np.flatnonzero(flat != START)
    code = code[at]
    bucket = (code >> 8 & ((1 << (8 * (LOW + 1))) - 1)) * 2654435761 >> 20 & (BUCKETS - 1)
    return at, bucket << BUCKET_SHIFT | ORDER << ORDER_SHIFT | code


def coded_runs(flat: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in ``flat``, the symbols of whole texts, and their situations, some STEP at once."""
    for begin in range(0, len(flat), STEP):
        first = max(0, begin - ORDER)
        at, code = situations(flat[first : begin + STEP])
        use = at + first >= begin
        yield at[use] + first, code[use]


def tally(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, and how often each occurs."""
    code = np.sort(code)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(code)), bool), code[1:] != code[:-1]]))
    return code[first], np.diff(np.append(first, len(code)))


def summed(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, and their sums."""
    order = np.argsort(code)
    code = code[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(code)), bool), code[1:] != code[:-1]]))
    return code[first], np.add.reduceat(n[order], first).astype(np.int64) if len(first) else np.zeros(0, np.int64)


def distinct(codes: Iterable[np.ndarray]) -> np.ndarray:
    """The distinct ones, ascending."""
    return tally(np.concatenate([np.zeros(0, np.int64), *codes]))[0]


def nodes_of(code: np.ndarray, n: np.ndarray, orders: range) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of these orders, with their counts, that situations occurring ``n`` times make."""
    code, n = code[n > 0], n[n > 0]
    got = [summed(code & ((np.int64(1) << (8 * order + 8)) - 1) | np.int64(order) << ORDER_SHIFT, n) for order in orders]
    return np.concatenate([c for c, _ in got]), np.concatenate([k for _, k in got])


def cells(order: int, came: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Which count of escapes a situation belongs to."""
    t = np.where(total < 8, total, 5 + np.floor(np.log2(np.maximum(total, 1))).astype(np.int64))
    d = np.where(kinds < 4, kinds, 2 + np.floor(np.log2(np.maximum(kinds, 1))).astype(np.int64))
    return ((order * 2 + came) * T_STEPS + np.minimum(t, T_STEPS - 1)) * D_STEPS + np.minimum(d, D_STEPS - 1)


@dataclass
class Trie:
    codes: np.ndarray  # nodes, ascending
    counts: np.ndarray
    contexts: np.ndarray  # nodes without their symbols, ascending
    total: np.ndarray  # T of each context
    kinds: np.ndarray  # D
    rest_total: np.ndarray  # T of the next shorter context without this one's symbols
    rest_kinds: np.ndarray
    escapes: np.ndarray  # by cell
    visits: np.ndarray

    @staticmethod
    def build(codes: np.ndarray, counts: np.ndarray) -> Trie:
        order = np.argsort(codes)
        codes, counts = codes[order].astype(np.int64), counts[order].astype(np.int64)
        contexts, first, kinds = np.unique(codes >> 8, return_index=True, return_counts=True)
        total = np.add.reduceat(counts, first) if len(codes) else counts
        depth = contexts >> (ORDER_SHIFT - 8)
        shorter = np.where(depth > 0, shorten(contexts, depth), -1)
        up = find(contexts, shorter)
        of_node = np.repeat(np.arange(len(contexts)), kinds)
        same = find(codes, shorter[of_node] << 8 | codes & 255)
        inside = np.bincount(of_node, np.where(same >= 0, counts[same], 0), len(contexts)).astype(np.int64)
        also = np.bincount(of_node, same >= 0, len(contexts)).astype(np.int64)
        has = up >= 0
        return Trie(codes, counts, contexts, total, kinds, np.where(has, total[up] - inside, 0), np.where(has, kinds[up] - also, 0), np.zeros(CELLS), np.zeros(CELLS))

    def coded(self, code: np.ndarray, tally: tuple | None = None) -> np.ndarray:
        """Log10 probabilities of situations; with ``tally`` (escapes, visits, weights) each symbol counts once less, and escapes are counted."""
        out = np.zeros(len(code))
        todo = np.arange(len(code))
        longer = np.full(len(code), -1)  # the context escaped from
        held = np.zeros(len(code), np.int64)  # whether that one has the symbol, its only time being left out
        less = int(tally is not None)
        symbol = code & 255
        for order in range(ORDER, -1, -1):
            here = todo
            context = code[here] >> 8 & ((np.int64(1) << (8 * order)) - 1) | np.int64(order) << (ORDER_SHIFT - 8)
            node = find(self.contexts, context)
            here, context, node = here[node >= 0], context[node >= 0], node[node >= 0]
            found = find(self.codes, context << 8 | symbol[here])
            times = np.where(found >= 0, self.counts[found], 0) if len(self.counts) else np.zeros(len(here), np.int64)
            came = longer[here]
            total, kinds = np.where(came >= 0, self.rest_total[came], self.total[node]), np.where(came >= 0, self.rest_kinds[came], self.kinds[node])
            if less:
                # the symbol's only time in the longer context is left out there, so it is not excluded here
                back = held[here] * (came >= 0)
                total, kinds = total + back * times - (times > 0), kinds + back * (times > 0) - (times == 1)
                times = np.maximum(times - 1, 0)
            open_ = total > 0  # with every symbol excluded there is nothing to code, and the escape is certain
            cell = cells(order, (came >= 0).astype(np.int64), total, kinds)
            hit = open_ & (times > 0)
            missed = open_ & ~hit
            if tally:
                np.add.at(tally[0], cell[missed], tally[2][here[missed]])
                np.add.at(tally[1], cell[open_], tally[2][here[open_]])
            with np.errstate(divide="ignore", invalid="ignore"):
                e = (self.escapes[cell] + 2 * kinds / (total + kinds)) / (self.visits[cell] + 2)
            out[here[hit]] += np.log10((1 - e[hit]) * times[hit] / total[hit])
            out[here[missed]] += np.log10(e[missed])
            # a context that only the left-out time has made isn't there
            real = open_ | (came >= 0) if less else np.ones(len(here), bool)
            passed = ~hit & real
            longer[here[passed]] = node[passed]
            held[here[passed]] = found[passed] >= 0
            left = np.ones(len(out), bool)
            left[here[hit]] = False
            todo = todo[left[todo]]
        empty = find(self.contexts, np.zeros(1, np.int64))[0]
        seen = int(self.kinds[empty]) if empty >= 0 else 0
        out[todo] -= np.log10(max(1, ALPHABET - seen))
        return out


def shorten(contexts: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The contexts without their oldest symbol."""
    fewer = np.maximum(depth - 1, 0)
    return contexts & ((np.int64(1) << (8 * fewer)) - 1) | fewer << (ORDER_SHIFT - 8)


def find(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each is, or -1."""
    if not len(sorted_values):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
    return np.where(sorted_values[at] == wanted, at, -1)


def squeeze(*columns: np.ndarray, text: bytes = b"") -> bytes:
    """Columns of one length (8-byte numbers are stored byte by byte: what is alike lies together) and a string, compressed."""
    import zstandard

    head = np.array([len(columns), len(columns[0]) if columns else 0, len(text)], "<i8").tobytes()
    planes = [np.ascontiguousarray(c.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head, text, *planes]))


def unsqueeze(data: bytes) -> tuple[list[np.ndarray], bytes]:
    """The columns and the string."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    columns, n, size = (int(x) for x in np.frombuffer(raw, "<i8", 3))
    planes = np.frombuffer(raw, np.uint8)[24 + size :].reshape(columns, 8, n)
    return [np.ascontiguousarray(p.T).view("<i8").ravel() for p in planes], raw[24 : 24 + size]


#: kind (SITUATIONS or WORDS), bucket, asks (whether a block asks), block, data
ROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("asks", pa.bool_()), ("block", pa.int64()), ("data", pa.binary())])
ROW_SCHEMA = "kind int, bucket int, asks boolean, block long, data binary"
KEY = ["kind", "bucket"]


def rows_of(kind: int, bucket: list[int], data: list[bytes], block: int | None = None) -> pa.RecordBatch:
    n = len(data)
    return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), pa.array(bucket, pa.int32()), pa.array([block is not None] * n), pa.array([block] * n, pa.int64()), pa.array(data, pa.binary())], schema=ROW)


def by_bucket(code: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Buckets of ascending situations, and where each one's are."""
    edges = np.searchsorted(code, np.arange(BUCKETS + 1) << BUCKET_SHIFT).tolist()
    for bucket, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if b > a:
            yield bucket, slice(a, b)


def words_by_bucket(words: Iterable[bytes]) -> dict[int, list[bytes]]:
    """Words by bucket, in each as they come."""
    out: dict[int, list[bytes]] = {}
    for w in words:
        out.setdefault(zlib.crc32(w) % WORD_BUCKETS, []).append(w)
    return out


def counted(docs: DataFrame) -> DataFrame:
    """ROW_SCHEMA: what each task has counted in the texts it read (a column ``text``), summed in pieces of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        codes, counts, size, chars = [], [], 0, 0

        def out() -> Iterator[pa.RecordBatch]:
            code, n = summed(np.concatenate(codes), np.concatenate(counts))
            parts = [*by_bucket(code)]
            yield rows_of(SITUATIONS, [b for b, _ in parts], [squeeze(code[s], n[s]) for _, s in parts])
            held = words_by_bucket(words)
            yield rows_of(WORDS, [*held], [squeeze(np.array([words[w] for w in ws]), text=b"\n".join(ws)) for ws in held.values()])

        for batch in slices(batches, most=4 << 20):
            split = [words_of(t) for t in batch.column("text").to_pylist()]
            for own in split:
                words.update(own)
            for _, c in coded_runs(symbols_of(split)):
                code, n = tally(c)
                codes.append(code)
                counts.append(n)
                size += len(code)
            chars += batch.column("text").nbytes
            if size > HELD:
                code, n = summed(np.concatenate(codes), np.concatenate(counts))
                codes, counts, size = [code], [n], len(code)
            if 2 * size > HELD or len(words) > HELD // 8 or chars > 1 << 26:
                yield from out()
                words.clear()
                codes, counts, size, chars = [], [], 0, 0
        if codes:
            yield from out()

    return docs.mapInArrow(run, ROW_SCHEMA)


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], Iterator[tuple[bool, int, bytes]]]]:
    """Rows that come sorted by kind and bucket, bucket by bucket: (asks, block, data), one at a time."""
    rows = ((k, b, a, d, x) for batch in batches for k, b, a, d, x in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    ahead = next(rows, None)

    def own(key: tuple[int, int]) -> Iterator[tuple[bool, int, bytes]]:
        nonlocal ahead
        while ahead is not None and ahead[:2] == key:
            yield ahead[2:]
            ahead = next(rows, None)

    while ahead is not None:
        key = ahead[:2]
        held = own(key)
        yield key, held
        for _ in held:  # whatever was not read
            pass


def merged(rows: DataFrame) -> DataFrame:
    """ROW_SCHEMA: one row for each bucket with the sums over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (kind, bucket), held in grouped(batches):
            if kind == WORDS:
                words: Counter = Counter()
                for _, _, data in held:
                    (n,), text = unsqueeze(data)
                    for w, k in zip(text.split(b"\n"), n.tolist(), strict=True):
                        words[w] += k
                yield rows_of(kind, [bucket], [squeeze(np.array([*words.values()]), text=b"\n".join(words))])
                continue
            codes, counts, size = [], [], 0
            for _, _, data in held:
                code, n = unsqueeze(data)[0]
                codes.append(code)
                counts.append(n)
                size += len(code)
                if size > HELD:
                    code, n = summed(np.concatenate(codes), np.concatenate(counts))
                    codes, counts, size = [code], [n], len(code) // 2
            yield rows_of(kind, [bucket], [squeeze(*summed(np.concatenate(codes), np.concatenate(counts)))])

    return rows.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(run, ROW_SCHEMA)


def lower_nodes(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Nodes up to order LOW and their counts: strings of three symbols at most, as many as the alphabet has, however large the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data").to_pylist():
                code, n = nodes_of(*unsqueeze(data)[0], range(LOW + 1))
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])

    got = table.where(F.col("kind") == SITUATIONS).select("data").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    return summed(got.column("code").to_numpy(), got.column("n").to_numpy())


def part_of_trie(low: tuple[np.ndarray, np.ndarray], code: np.ndarray, n: np.ndarray) -> Trie:
    nodes = nodes_of(code, n, range(LOW + 1, ORDER + 1))
    return Trie.build(*(np.concatenate(c) for c in zip(low, nodes, strict=True)))


def escapes_of(table: DataFrame, low) -> tuple[np.ndarray, np.ndarray]:
    """Escapes and visits by cell, each training symbol left out in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escapes, visits = np.zeros(CELLS), np.zeros(CELLS)
        for batch in batches:
            for data in batch.column("data").to_pylist():
                code, n = unsqueeze(data)[0]
                part_of_trie(low.value, code, n).coded(code, (escapes, visits, n))
        some = np.flatnonzero(visits)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(escapes[some]), pa.array(visits[some])], ["cell", "e", "v"])

    escapes, visits = np.zeros(CELLS), np.zeros(CELLS)
    rows = table.where(F.col("kind") == SITUATIONS).select("data").mapInArrow(run, "cell long, e double, v double")
    for r in rows.groupBy("cell").agg(F.sum("e").alias("e"), F.sum("v").alias("v")).collect():  # CELLS rows at most
        escapes[r["cell"]], visits[r["cell"]] = r["e"], r["v"]
    return escapes, visits


def asked(blocks: DataFrame) -> DataFrame:
    """ROW_SCHEMA: the distinct situations and words of each block (rows of one block come together), by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, codes, words = None, [], set()

        def out() -> Iterator[pa.RecordBatch]:
            code = distinct(codes)
            parts = [*by_bucket(code)]
            yield rows_of(SITUATIONS, [b for b, _ in parts], [squeeze(code[s]) for _, s in parts], block)
            held = words_by_bucket(words)
            yield rows_of(WORDS, [*held], [squeeze(text=b"\n".join(ws)) for ws in held.values()], block)

        for batch in slices(batches, most=4 << 20):
            own = batch.column("block").to_numpy()
            for part in np.split(np.arange(len(own)), np.flatnonzero(np.diff(own)) + 1):
                if own[part[0]] != block:
                    if block is not None:
                        yield from out()
                    block, codes, words = int(own[part[0]]), [], set()
                split = [words_of(t) for t in batch.column("text").slice(part[0], len(part)).to_pylist()]
                codes = [distinct([*codes, *(tally(c)[0] for _, c in coded_runs(symbols_of(split)))])]
                words.update(*split)
        if block is not None:
            yield from out()

    return blocks.mapInArrow(run, ROW_SCHEMA)


def answered(rows: DataFrame, low, cell_counts: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """block, kind, asked (as it came), data: log10 probabilities (4-byte floats) or counts, in the order asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(kind: int, blocks: list[int], wants: list[bytes], data: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([kind] * len(blocks), pa.int32()), pa.array(wants, pa.binary()), pa.array(data, pa.binary())], ["block", "kind", "asked", "data"])

        for (kind, _), held in grouped(batches):
            trie, known, size = None, {}, 0
            code = n = np.zeros(0, np.int64)
            blocks, wants, came = [], [], []

            def answers() -> pa.RecordBatch:
                nonlocal trie
                if trie is None:
                    trie = part_of_trie(low.value, code, n)
                    trie.escapes, trie.visits = cell_counts
                every = distinct(wants)
                log10 = trie.coded(every).astype("<f4")
                return out(kind, blocks, came, [log10[np.searchsorted(every, w)].tobytes() for w in wants])

            for asks, block, data in held:
                columns, text = unsqueeze(data)
                if kind == WORDS:
                    words = text.split(b"\n")
                    if asks:
                        yield out(kind, [block], [data], [squeeze(np.fromiter((known.get(w, 0) for w in words), np.int64, len(words)))])
                    else:
                        known = dict(zip(words, columns[0].tolist(), strict=True))
                elif asks:
                    blocks.append(block)
                    wants.append(columns[0])
                    came.append(data)
                    size += len(columns[0])
                    if size > PART:
                        yield answers()
                        blocks, wants, came, size = [], [], [], 0
                else:
                    code, n = columns
            if wants:
                yield answers()

    order = [*KEY, "asks", "block"]
    return rows.repartition(*KEY).sortWithinPartitions(*order).mapInArrow(run, "block long, kind int, asked binary, data binary")


def score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each row.

    ``held_out`` is a boolean Column over ``doc_id`` and ``text``; the model learns from the other rows. ``base_score`` is
    the smoothed unigram log10 probability of words and end, ``score`` that of the PPM model.
    """
    spark = docs.sparkSession
    source = texts(docs, id_col, text_col).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    table = written(merged(counted(source.where(~F.col("held_out")).select("text"))), "ppm-trie")
    size, ends = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if(~F.col("held_out"))).first()

    def word_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [unsqueeze(data)[0][0] for data in batch.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([int(x.sum()) for x in sums], pa.int64()), pa.array([*map(len, sums)], pa.int64())], ["n", "kinds"])

    total, kinds = table.where(F.col("kind") == WORDS).select("data").mapInArrow(word_sums, "n long, kinds long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    n_train, n_kinds = total + ends, kinds + bool(ends)
    low = spark.sparkContext.broadcast(lower_nodes(table))
    cell_counts = escapes_of(table, low)

    n_blocks = max(1, -(-size // BLOCK))
    blocks = source.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks))).repartition("block")
    answers = answered(asked(blocks.sortWithinPartitions("block")).union(table), low, cell_counts)

    def sums(docs_part: pa.Table, answers_part: pa.Table) -> pa.Table:
        code, log10, index, counts = [np.zeros(0, np.int64)], [np.zeros(0, "<f4")], {}, [np.zeros(0, np.int64)]
        for kind, asked_for, data in zip(*(answers_part.column(c) for c in ("kind", "asked", "data")), strict=True):
            columns, text = unsqueeze(asked_for.as_py())
            if kind.as_py() == WORDS:
                words = text.split(b"\n")
                index.update(zip(words, range(len(index), len(index) + len(words)), strict=True))
                counts += unsqueeze(data.as_py())[0]
            else:
                code += columns
                log10.append(np.frombuffer(data.as_py(), "<f4"))
        code, log10, c = np.concatenate(code), np.concatenate(log10), np.concatenate(counts)
        order = np.argsort(code)
        code, log10 = code[order], log10[order]
        split = [words_of(t) for t in docs_part.column("text").to_pylist()]
        flat = symbols_of(split)
        each = np.zeros(len(flat), "<f4")
        for at, own in coded_runs(flat):
            order = np.argsort(own)
            each[at[order]] = log10[np.searchsorted(code, own[order])]
        begins = np.cumsum([0] + [sum(map(len, own)) + len(own) + 1 + ORDER for own in split[:-1]])
        scored = np.add.reduceat(each, begins, dtype=np.float64)
        base = np.log10(c + 0.5)
        below = np.log10(n_train + 0.5 * (n_kinds + 1))
        rows = []
        for own in split:
            at = np.fromiter(map(index.__getitem__, own), np.int64, len(own))
            n = len(at) + 1
            rows.append((n, int((c[at] > 0).sum()) + (ends > 0), float(base[at].sum() + np.log10(ends + 0.5) - n * below)))
        n, known, based = zip(*rows, strict=True)
        return pa.table({"doc_id": docs_part.column("doc_id"), "held_out": docs_part.column("held_out"), "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array([n_train] * len(n), pa.int64()), "base_score": pa.array(based, pa.float64()), "score": pa.array(scored, pa.float64())})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(sums, schema)
