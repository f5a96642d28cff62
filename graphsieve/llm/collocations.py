"""Phrase collocation mining: frequent runs of words by the PCY/DHP method, scored by how their parts go together.

Pass 1 counts words exactly, by language, and hashes each pair of words that follow each other into buckets, which are counted too.
Pass k counts exactly the runs of k words whose bucket is frequent and whose two runs of k - 1 words are frequent
(Apriori), and hashes into buckets those runs of k + 1 words both of whose parts of k words may be frequent. Tasks know frequent
buckets and frequent runs by broadcast bitmaps, nothing else: a bit too many costs a count, never a result, as what is counted
is the words themselves, summed by Spark.

A bitmap has a bit for about every four bytes of text (for runs of words: 16 for each) and MOST_BITS at most, so what is broadcast is bounded; in
corpora so large that buckets then fill up, fewer runs are passed over before they are counted, and the results are the same.
Bucket counts travel as lists of 16-bit places in slices of 65,536 buckets, a slice being one key.

Null texts count as empty and null languages as ``und``. Repeated rows count each. A text takes some twelve times its bytes. An
empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphsieve.llm.common import slices, written
from graphsieve.llm.words import Lexis, grams, mixed, words_of

LEAST, LONGEST, TOP = 30, 4, 2000
SCORE, INSIDE = 2_000_000, (100, 80)
LEXIS = Lexis.of(gap=" \t", breaks=".,;:!?\n\x0b\x0c\r")
#: Bits of a bitmap: at least one slice, at most 64 MB.
LEAST_BITS, MOST_BITS, SLICE = 1 << 16, 1 << 29, 16
#: Runs and bucket places that a task holds before it sends them.
HELD = 1 << 19
ROWS = "lang string, phrase string, n long, slice int, places binary"
SCHEMA = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64()), ("slice", pa.int32()), ("places", pa.binary())])


def bits_for(n: int) -> int:
    """A power of two within the bounds."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << max(0, n - 1).bit_length()))


class Bitmap:
    def __init__(self, bits: int, rows: list[tuple[int, bytes]]):
        self.shift = np.uint64(64 - (bits.bit_length() - 1))
        self.data = np.zeros(bits >> 3, np.uint8)
        for k, data in rows:
            self.data[k << (SLICE - 3) : (k + 1) << (SLICE - 3)] = np.frombuffer(data, np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def placed(hashes: np.ndarray, bits: int) -> Iterator[tuple[int, bytes]]:
    """Slices of buckets, and in each the places of these hashes."""
    at = np.sort(hashes >> np.uint64(64 - (bits.bit_length() - 1)))
    part = (at >> np.uint64(SLICE)).astype(np.int32)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(at)), bool), part[1:] != part[:-1]]))
    low = at.astype("<u2")
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(at)], strict=True):
        yield int(part[a]), low[a:b].tobytes()


def bitmap(rows: DataFrame, bits: int, least: int) -> Bitmap:
    """The buckets in which at least so many places lie; ``rows``: slice, places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, counts = None, np.zeros(1 << SLICE, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([np.packbits(counts >= least, bitorder="little").tobytes()])], ["slice", "bits"])

        for batch in batches:
            for k, data in zip(batch.column("slice").to_pylist(), batch.column("places"), strict=True):
                if k != last:
                    if last is not None:
                        yield out()
                    last = k
                    counts[:] = 0
                places = np.frombuffer(data.as_py(), "<u2")
                if len(places) < 1 << 13:
                    np.add.at(counts, places, 1)
                else:
                    counts += np.bincount(places, minlength=1 << SLICE)
        if last is not None:
            yield out()

    dealt = rows.repartition("slice").sortWithinPartitions("slice")
    return Bitmap(bits, [(r[0], r[1]) for r in dealt.mapInArrow(run, "slice int, bits binary").collect()])  # MOST_BITS in all, at most


def seeds(langs: list[str], n: int) -> np.ndarray:
    """A number for each language, by which its runs' hashes differ from other languages'."""
    return words_of(pa.array([f"x{k}" for k in langs], pa.string()), Lexis(bytes(256))).hashes() + np.uint64(n)


def frequent_bitmap(frequent: DataFrame, n: int, bits: int) -> Bitmap:
    """The runs of ``n`` words (lang, phrase)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1 << 18):
                part = batch.slice(low, 1 << 18)
                found = words_of(part.column("phrase"), LEXIS)
                rows = [*placed(runs(found.hashes(), n, seeds_of(part.column("lang"), n)[found.text])[::n], bits)]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], ["slice", "places"])

    return bitmap(frequent.select("lang", "phrase").mapInArrow(run, "slice int, places binary"), bits, 1)


def seeds_of(langs: pa.Array, n: int) -> np.ndarray:
    coded = langs.dictionary_encode()
    return seeds(coded.dictionary.to_pylist(), n)[coded.indices.to_numpy()] if len(langs) else np.zeros(0, np.uint64)


def runs(hashes: np.ndarray, n: int, seed: np.ndarray) -> np.ndarray:
    """Hashes of the runs of ``n`` words from each word on, with their languages'."""
    found = grams(hashes, n)
    return mixed(found ^ seed[: len(found)])


def counted(docs: DataFrame, k: int, allowed, next_bits: int) -> DataFrame:
    """ROWS: runs of ``k`` words with their number (phrase, n), as far as ``allowed`` (bitmaps of buckets of k and of frequent runs of k - 1) lets them; and places of the runs of k + 1 in buckets (slice, places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps = allowed.value if allowed is not None else None
        held, pending, places, size = [], 0, [], 0

        def phrases() -> pa.Table:
            return pa.concat_tables(held).group_by(["lang", "phrase"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["lang", "phrase", "n"])

        def out_phrases(table: pa.Table) -> Iterator[pa.RecordBatch]:
            for part in table.to_batches(max_chunksize=1 << 17):
                none = pa.nulls(part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, none.cast(pa.int32()), none.cast(pa.binary())], schema=SCHEMA)

        def out_places() -> pa.RecordBatch:
            rows = [*placed(np.concatenate(places), next_bits)]
            none = pa.nulls(len(rows))
            return pa.RecordBatch.from_arrays([none.cast(pa.string()), none.cast(pa.string()), none.cast(pa.int64()), pa.array([s for s, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], schema=SCHEMA)

        for batch in slices(batches, most=1 << 20):
            found = words_of(batch.column("text"), LEXIS)
            if not len(found):
                continue
            h, langs = found.hashes(), batch.column("lang")
            # whether so many words from here on are one run
            whole = {1: np.ones(len(found), bool)}
            for n in range(2, min(k + 1, LONGEST) + 1):
                whole[n] = whole[n - 1][: len(found) - n + 1] & found.joined[n - 2 : len(found) - 1]
            ok = whole[k]
            if k > 1:
                parts = bitmaps[1].has(runs(h, k - 1, seeds_of(langs, k - 1)[found.text]))
                ok = ok & parts[:-1] & parts[1:]
                at = np.flatnonzero(ok)
                own = runs(h, k, seeds_of(langs, k)[found.text])
                ok[at] = bitmaps[0].has(own[at])
            at = np.flatnonzero(ok)
            if len(at):
                coded = (found.phrases(at, k) if k > 1 else found.strings()).dictionary_encode()
                tongue = langs.dictionary_encode()
                key = tongue.indices.to_numpy().astype(np.int64)[found.text[at]] * len(coded.dictionary) + coded.indices.to_numpy()
                key, n = np.unique(key, return_counts=True)
                held.append(pa.table({"lang": tongue.dictionary.take(pa.array(key // len(coded.dictionary))), "phrase": coded.dictionary.take(pa.array(key % len(coded.dictionary))).cast(pa.string()), "n": pa.array(n.astype(np.int64))}))
                pending += held[-1].num_rows
            if k < LONGEST:
                longer = whole[k + 1] & ok[:-1] & ok[1:] if k > 1 else whole[k + 1]
                places.append(runs(h, k + 1, seeds_of(langs, k + 1)[found.text])[longer])
                size += len(places[-1])
            if pending > HELD:
                held = [phrases()]
                pa.default_memory_pool().release_unused()
                pending = held[0].num_rows
                if 2 * pending > HELD:
                    yield from out_phrases(held[0])
                    held, pending = [], 0
            if size > 4 * HELD:
                yield out_places()
                places, size = [], 0
        if held:
            yield from out_phrases(phrases())
        if size:
            yield out_places()

    return docs.mapInArrow(run, ROWS)


def frequent_runs(spark: SparkSession, docs: DataFrame, least: int) -> list[DataFrame]:
    """For each number of words up to LONGEST: lang, phrase, n of the runs that occur ``least`` times; in pass 1 also the sum of all words by language, at last."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = bits_for(size // 4)
    out, totals, allowed = [], None, None
    for k in range(1, LONGEST + 1):
        rows = counted(docs, k, allowed, bits)
        rows = written(rows, f"phrases-{k}")
        sums = rows.where("phrase is not null").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        if k == 1:
            totals = rows.where("phrase is not null").groupBy("lang").agg(F.sum("n").alias("total"))
        frequent = written(sums.where(F.col("n") >= least), f"frequent-{k}")
        out.append(frequent)
        if allowed is not None:
            allowed.unpersist()
        if k < LONGEST:
            buckets = bitmap(rows.where("slice is not null").select("slice", "places"), bits, least)
            allowed = spark.sparkContext.broadcast((buckets, frequent_bitmap(frequent, k, bits_for(16 * frequent.count()))))
    return [*out, totals]


def part(phrase: str, begin: str, n: str) -> F.Column:
    """SQL for ``n`` words of a phrase."""
    return F.expr(f"array_join(slice(split({phrase}, ' '), {begin}, {n}), ' ')")


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases.

    ``a``: how often the phrase occurs; ``l``, ``r``: its two parts, cut where floor(SCORE a / (l + r)) is least, and
    that is ``score``; ``n``: all words. Phrases inside a longer candidate that occurs nearly as often are left out.
    """
    spark = docs.sparkSession
    source = docs.select(F.coalesce(docs[text_col], F.lit("")).alias("text"), F.coalesce(docs[lang_col], F.lit("und")).alias("lang"))
    *frequent, totals = frequent_runs(spark, source, least)
    known = frequent[0]
    for more in frequent[1:-1]:
        known = known.unionByName(more)
    candidates = [f.withColumn("words", F.lit(k)) for k, f in enumerate(frequent[1:], 2)]
    every = candidates[0]
    for more in candidates[1:]:
        every = every.unionByName(more)
    every = every.withColumnRenamed("n", "a")

    # both parts of every cut are frequent, so they are among the known
    cuts = every.withColumn("cut", F.explode(F.expr("sequence(1, words - 1)")))
    cuts = cuts.withColumns({"left": part("phrase", "1", "cut"), "right": part("phrase", "cut + 1", "words - cut")})
    side = lambda name, n: known.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    score = F.call_function("div", F.lit(SCORE).cast("decimal(10,0)") * F.col("a").cast("decimal(19,0)"), (F.col("l") + F.col("r")).cast("decimal(20,0)"))
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "words").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))

    inner = every.where("words > 2").select("lang", "a", "phrase", F.explode(F.expr("flatten(transform(sequence(2, words - 1), n -> transform(sequence(1, words - n + 1), b -> struct(b, n))))")).alias("of"))
    inner = inner.select("lang", part("phrase", "of.b", "of.n").alias("phrase"), F.col("a").alias("around")).groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    many, share = (F.lit(x).cast("decimal(10,0)") for x in INSIDE)
    absorbed = inner.join(every.select("lang", "phrase", "a"), ["lang", "phrase"]).where(many * F.col("around").cast("decimal(19,0)") >= share * F.col("a").cast("decimal(19,0)")).select("lang", "phrase")
    left = best.join(absorbed, ["lang", "phrase"], "left_anti").select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
