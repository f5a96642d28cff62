"""Benchmark decontamination: a prefix-filtered set join of item windows and documents.

A window is ``width`` consecutive words of an item; an item of fewer words, but not none, is one window. Its set is its shingles,
runs of SHINGLE words (of all its words, if it has fewer), each with its place. A document contains a window if it contains
every shingle at its place, so one shingle is a necessary prefix, and the rarest is the best one:

1. Shingles of the windows are counted over all documents, in tasks that look them up in a broadcast table.
2. Windows are joined with the counts, and each is posted under its rarest shingle. A window one of whose shingles occurs nowhere
   occurs nowhere, and is not posted.
3. Documents are joined with the postings by shingle. A posting's place in its window tells where the window would begin and
   end: it must lie within the document. Then the words themselves are compared.

Windows are dealt into blocks of about BLOCK by a hash (with their items), so that what is broadcast at once is bounded however large the benchmark; each block is
joined with all documents in turn. Documents are never shuffled, except that with several blocks what was found is added up by
document.

Null texts have no words. Rows with equal id and text get equal results. Items with equal ids count as one; the words of an item
without id are hit, but the item isn't listed. Empty tables on either side: no items found. Further columns are ignored. A
document takes some ten times its bytes.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphsieve.llm.common import slices, written
from graphsieve.llm.words import Lexis, Words, grams, words_of

WIDTH, SHINGLE = 10, 3
LEXIS = Lexis.of(word=string.digits + string.ascii_letters)
#: Windows that are broadcast at once, about; candidates that are compared at once.
BLOCK, PART = 1 << 17, 1 << 18
#: Bits of the table that tells most shingles apart before they are looked up.
BITS = 22


class Lookup:
    """Distinct 64-bit keys, ascending, with a table of bits before them."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys.astype(np.uint64))
        self.bits = np.zeros(1 << BITS, bool)
        self.bits[self.keys >> np.uint64(64 - BITS)] = True

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of those found, and which keys they are."""
        at = np.flatnonzero(self.bits[wanted >> np.uint64(64 - BITS)])
        if not len(at):
            return at, at
        key = np.minimum(np.searchsorted(self.keys, wanted[at]), len(self.keys) - 1)
        same = self.keys[key] == wanted[at]
        return at[same], key[same]


def windows(benchmark: DataFrame, width: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id (as string), words (of the window, joined by a space), n (of words), shingles (hashes, by place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1 << 20):
            found = words_of(batch.column("text"), LEXIS)
            first, h = found.first(), found.hashes()
            shingles = {n: grams(h, n) for n in range(1, SHINGLE + 1)}
            count = np.diff(first)
            for n in np.unique(np.minimum(count, width)).tolist():
                if not n:
                    continue
                own = np.flatnonzero(np.minimum(count, width) == n)
                many = count[own] - n + 1
                text = np.repeat(own, many)
                at = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many) + first[text]
                size = min(SHINGLE, n)
                table = shingles[size][at[:, None] + np.arange(n - size + 1)].astype(np.int64)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(table.ravel()), n - size + 1).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(text)), found.phrases(at, n).cast(pa.string()), pa.array(np.full(len(at), n, np.int32)), lists], ["item_id", "words", "n", "shingles"])

    chosen = benchmark.select(benchmark[id_col].cast("string").alias("item_id"), benchmark[text_col].alias("text"))
    return chosen.mapInArrow(run, "item_id string, words string, n int, shingles array<long>")


def shingle_counts(docs: DataFrame, wanted) -> DataFrame:
    """shingle, n: how often each wanted shingle occurs in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looked = wanted.value
        n = {size: np.zeros(len(v.keys), np.int64) for size, v in looked.items()}
        for batch in slices(batches):
            found = words_of(batch.column("text"), LEXIS)
            first, h = found.first(), found.hashes()
            for size, lookup in looked.items():
                at, key = lookup.find(grams(h, size))
                whole = at + size <= first[found.text[at] + 1]
                n[size] += np.bincount(key[whole], minlength=len(lookup.keys))
        for size, lookup in looked.items():
            some = np.flatnonzero(n[size])
            yield pa.RecordBatch.from_arrays([pa.array(lookup.keys[some].astype(np.int64)), pa.array(n[size][some])], ["shingle", "n"])

    return docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


class Postings:
    """Windows of one block under their rarest shingles."""

    def __init__(self, rows: pa.Table):
        size = np.minimum(rows.column("n").to_numpy(), SHINGLE)
        rows = rows.take(pa.array(np.lexsort([rows.column("shingle").to_numpy().astype(np.uint64), size])))
        self.n, self.place = rows.column("n").to_numpy().astype(np.int64), rows.column("place").to_numpy().astype(np.int64)
        self.words, self.items = [w.encode() for w in rows.column("words").to_pylist()], rows.column("items").to_pylist()
        size, shingle = np.minimum(self.n, SHINGLE), rows.column("shingle").to_numpy().astype(np.uint64)
        #: for each size of shingles its keys, and where each key's postings begin and end
        self.by_size = {}
        for s in np.unique(size).tolist():
            own = np.flatnonzero(size == s)
            lookup = Lookup(shingle[own])
            self.by_size[s] = lookup, own[0] + np.searchsorted(shingle[own], lookup.keys), own[0] + np.searchsorted(shingle[own], lookup.keys, "right")

    def candidates(self, found: Words, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Where windows may begin, and which; all within their text."""
        for size, (lookup, begin, end) in self.by_size.items():
            at, key = lookup.find(grams(h, size))
            for low in range(0, len(at), PART):
                a, k = at[low : low + PART], key[low : low + PART]
                many = end[k] - begin[k]
                where, posting = np.repeat(a, many), np.repeat(begin[k] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                text = found.text[where]
                where = where - self.place[posting]
                inside = (where >= first[text]) & (where + self.n[posting] <= first[text + 1])
                yield where[inside], posting[inside]

    def occurrences(self, found: Words) -> tuple[np.ndarray, np.ndarray]:
        """Where windows begin, and which."""
        h, first = found.hashes(), found.first()
        norm = begin = None
        starts, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for where, posting in self.candidates(found, h, first):
            if len(where) and norm is None:
                data, begin = found.norm()
                norm = data.tobytes()
            if len(where):
                ends = (begin[where + self.n[posting]] - 1).tolist()
                same = np.fromiter((norm[a:b] == self.words[p] for a, b, p in zip(begin[where].tolist(), ends, posting.tolist(), strict=True)), bool, len(where))
                starts.append(where[same])
                which.append(posting[same])
        return np.concatenate(starts), np.concatenate(which)


def runs_of(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of true begin and end."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


FOUND = "doc_id {0}, h long, n_words long, spans array<struct<first:long,last:long>>, items array<string>"


def found_in(docs: DataFrame, postings) -> DataFrame:
    """FOUND: for each document its words, the spans of words hit (first, and one past the last) and the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posted = postings.value
        span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        for batch in slices(batches):
            found = words_of(batch.column("text"), LEXIS)
            first = found.first()
            at, which = posted.occurrences(found)
            change = np.zeros(len(found) + 1, np.int64)
            np.add.at(change, at, 1)
            np.add.at(change, at + posted.n[which], -1)
            spans, items = [[] for _ in range(batch.num_rows)], [set() for _ in range(batch.num_rows)]
            if len(at):
                # no window crosses texts, but two may meet there
                begins, ends = runs_of(np.cumsum(change)[:-1] > 0)
                for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
                    for t in range(found.text[a], found.text[b - 1] + 1):
                        if (x := max(a, first[t])) < (y := min(b, first[t + 1])):
                            spans[t].append({"first": int(x - first[t]), "last": int(y - first[t])})
                for t, p in np.unique(np.stack([found.text[at], which], 1), axis=0).tolist():
                    items[t].update(posted.items[p])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(np.diff(first)), pa.array(spans, span), pa.array([*map(sorted, items)], pa.list_(pa.string()))], ["doc_id", "h", "n_words", "spans", "items"])

    return docs.mapInArrow(run, FOUND.format(docs.schema["doc_id"].dataType.simpleString()))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, spans, items: a row for each row of ``docs``.

    ``spans``: runs of words inside occurrences of windows (first, and one past the last), those of several blocks side by side;
    ``items``: ids of the items with occurring windows, as strings in order.
    """
    spark = docs.sparkSession
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("h"))
    made = written(windows(benchmark, width), "leak-windows")
    blocks = max(1, -(-made.count() // block))
    made = made.withColumn("block", F.pmod(F.xxhash64("words", "item_id"), F.lit(blocks)))
    parts = []
    for k in range(blocks):
        own = made.where(F.col("block") == k)
        distinct = own.select(F.least("n", F.lit(SHINGLE)).alias("size"), F.explode("shingles").alias("shingle")).distinct().toArrow()  # width times ``block`` rows, about
        size, shingle = distinct.column("size").to_numpy(), distinct.column("shingle").to_numpy()
        wanted = spark.sparkContext.broadcast({s: Lookup(shingle[size == s]) for s in np.unique(size).tolist()})
        counts = shingle_counts(source, wanted)
        sets = own.groupBy("words", "n", "shingles").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
        placed = sets.select("words", "n", "items", F.posexplode("shingles").alias("place", "shingle"))
        # shingles that occur nowhere count 0 and come first: their windows go
        times = counts.withColumnRenamed("n", "times")
        rare = placed.join(times, "shingle", "left").groupBy("words", "n", "items").agg(F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "place", "shingle")).alias("least"))
        posted = rare.where("least.times > 0").select("words", "n", "items", "least.place", "least.shingle").toArrow()  # a block's windows
        wanted.unpersist()
        found = found_in(source, spark.sparkContext.broadcast(Postings(posted)))
        if blocks > 1:
            found = written(found.groupBy("doc_id", "h").agg(*(F.first(c).alias(c) for c in ("n_words", "spans", "items")), F.count("*").cast("int").alias("copies")), "leak-found")
        parts.append(found)
    if blocks == 1:
        return parts[0].select("doc_id", "n_words", "spans", "items")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    lists = (F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("spans", "items"))
    merged = every.groupBy("doc_id", "h").agg(F.first("n_words").alias("n_words"), F.first("copies").alias("copies"), *lists)
    return merged.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc_id", "n_words", "spans", "items")


def n_hit(spans: str = "spans"):
    """How many words lie in some span; spans in order may overlap."""
    state = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("upto"))
    step = lambda s, x: F.struct((s.hit + F.greatest(F.lit(0), x["last"] - F.greatest(x["first"], s.upto))).alias("hit"), F.greatest(s.upto, x["last"]).alias("upto"))
    return F.aggregate(spans, state, step, lambda s: s.hit)
