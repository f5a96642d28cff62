"""Source divergence audit: how far the term frequencies of the sources of a language lie apart, from joint count histograms.

Tasks count the terms of the texts they read by language and source, with the number of documents; sums by term then meet once,
and each kept term becomes a row with its sources' counts. From these rows tasks tally, for each pair of sources, how many terms have
which two counts. Cells with a zero are implied: a source's terms with a count, less those that the pair's tally pairs with a
count of the other source, and the kept terms that neither has. The divergence is evaluated once for each cell and multiplied with the number of its terms,
so its cost grows with the distinct counts, not with the vocabulary. A term's pairs of sources are tallied in pieces of PAIRS, never
listed; one row for each term holds as many counts as the language has sources with it.

Arithmetic is in integers: 10^9 times a count in 38 decimal digits, the rest in 64 bits. Null text, language and source count as
''. Groups without terms count too; where a language keeps no term, values are 0. Repeated rows count each. An empty table gives
an empty result. Further columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphsieve.llm.common import slices, written
from graphsieve.llm.words import Lexis, words_of

LEAST_DOCS, TOP = 10, 10
SCALE = 1_000_000_000
LEXIS = Lexis.of(word=string.ascii_letters)
#: Rows that a task sums before it sends them; pairs of counts that are tallied at once.
HELD, PAIRS = 1 << 19, 1 << 19
COUNTS = "lang string, source string, term string, n long, docs long"


def counted(docs: DataFrame) -> DataFrame:
    """COUNTS: what each task has counted in the texts it read; a key may come several times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pending = [], 0

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(["lang", "source", "term", "n", "docs"])

        for batch in slices(batches, most=4 << 20):
            found = words_of(batch.column("text"), LEXIS)
            coded = found.strings().dictionary_encode()
            code, terms = coded.indices.to_numpy().astype(np.int64), coded.dictionary
            # by document and term, then by group and term
            one, n = np.unique(found.text * len(terms) + code, return_counts=True)
            if not len(one):
                continue
            names: dict[tuple[str, str], int] = {}
            group = np.array([names.setdefault(g, len(names)) for g in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)], np.int64)
            key = group[one // len(terms)] * len(terms) + one % len(terms)
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            which = key[first] // len(terms)
            lang, source = (pa.array([g[k] for g in names], pa.string()).take(pa.array(which)) for k in (0, 1))
            term = terms.take(pa.array(key[first] % len(terms))).cast(pa.string())
            held.append(pa.table({"lang": lang, "source": source, "term": term, "n": pa.array(np.add.reduceat(n[order], first)), "docs": pa.array(np.diff(np.append(first, len(key))))}))
            pending += held[-1].num_rows
            if pending > HELD:
                held = [summed()]
                pending = held[0].num_rows
                if 2 * pending > HELD:
                    yield from held[0].to_batches(max_chunksize=1 << 17)
                    held, pending = [], 0
        if held:
            yield from summed().to_batches(max_chunksize=1 << 17)

    return docs.mapInArrow(run, COUNTS)


def kept_terms(docs: DataFrame, least_docs: int) -> DataFrame:
    """lang, term, total, each (source and n of each source that has it): the terms that enough documents of their language have."""
    # hash partitions by lang and term serve both groupings
    counts = counted(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("each"))
    return terms.where(F.col("docs") >= least_docs).drop("docs")


TALLY = "lang string, a string, b string, n_a long, n_b long, terms long"


def tally(terms: DataFrame) -> DataFrame:
    """TALLY: for pairs of sources a < b, how many terms a task has read that have these two counts (both above 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1 << 15):
                part = batch.slice(low, 1 << 15)
                lists = part.column("each")
                flat = lists.flatten()
                sources = flat.field("source").dictionary_encode()
                langs = part.column("lang").dictionary_encode()
                values, n = np.unique(flat.field("n").to_numpy(), return_inverse=True)
                code, size = sources.indices.to_numpy().astype(np.int64), np.diff(np.asarray(lists.offsets))
                lang = np.repeat(langs.indices.to_numpy().astype(np.int64), size)
                # each count is paired with those after it in its row
                after = np.repeat(np.cumsum(size), size) - 1 - np.arange(len(code))
                upto = np.cumsum(after)
                begin = 0
                while begin < len(code):
                    end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + PAIRS, "right")))
                    many = after[begin:end]
                    left = np.repeat(np.arange(begin, end), many)
                    right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many)
                    pair = (lang[left] * len(sources.dictionary) + code[left]) * len(sources.dictionary) + code[right]
                    pairs, pair = np.unique(pair, return_inverse=True)
                    cell, times = np.unique((pair * len(values) + n[left]) * len(values) + n[right], return_counts=True)
                    pair, n_a, n_b = pairs[cell // len(values) ** 2] if len(cell) else cell, values[cell // len(values) % len(values)], values[cell % len(values)]
                    own = pair // len(sources.dictionary)
                    columns = [langs.dictionary.take(pa.array(own // len(sources.dictionary))), sources.dictionary.take(pa.array(own % len(sources.dictionary))), sources.dictionary.take(pa.array(pair % len(sources.dictionary))), pa.array(n_a), pa.array(n_b), pa.array(times)]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "a", "b", "n_a", "n_b", "terms"])
                    begin = end

    return terms.select("lang", "each").mapInArrow(run, TALLY)


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (n + 2) / (total + 2 terms)), exactly."""
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(18,0)") * (n + 2).cast("decimal(19,0)"), (total + 2 * terms).cast("decimal(20,0)"))


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most SCALE + 1, so 64 bits hold the square."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: each other source of the language, with the sum over all kept terms of ``apart`` of the two sources' shares. Part
    ``term``: the source's ``top`` terms that it has more often than the language, by ``apart`` from the language's share.
    """
    empty = lambda c, name: F.coalesce(docs[c], F.lit("")).alias(name)
    source = docs.select(empty(text_col, "text"), empty(lang_col, "lang"), empty(source_col, "source"))
    terms = written(kept_terms(source, least_docs), "audit-terms")
    counts = terms.select("lang", "term", "total", F.explode("each").alias("one")).select("lang", "term", "total", "one.*")
    vocabulary = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("all"))
    have = counts.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count("*").alias("own"))
    groups = source.select("lang", "source").distinct().join(have, ["lang", "source"], "left").join(vocabulary, "lang", "left")
    groups = written(groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("size", "own", "v", "all"))), "audit-groups")

    # a row for each result: pairs of sources
    other = groups.select("lang", F.col("source").alias("b"), F.col("size").alias("size_b"), F.col("own").alias("own_b"))
    pairs = written(groups.withColumnsRenamed({"source": "a", "size": "size_a", "own": "own_a"}).join(other, "lang").where("a < b"), "audit-pairs")
    both = written(tally(terms).groupBy("lang", "a", "b", "n_a", "n_b").agg(F.sum("terms").alias("terms")), "audit-tally")
    alone = counts.groupBy("lang", "source", "n").agg(F.count("*").alias("terms"))
    names = ["lang", "a", "b"]
    cell = lambda a, b, n: F.struct(a.cast("long").alias("n_a"), b.cast("long").alias("n_b"), n.cast("long").alias("terms"))
    zero, n_a, n_b, n = F.lit(0), F.col("n_a"), F.col("n_b"), F.col("terms")
    # what a pair's tally has is missing from the cells with a zero
    cells = both.select(*names, F.inline(F.array(cell(n_a, n_b, n), cell(n_a, zero, -n), cell(zero, n_b, -n), cell(zero, zero, n))))
    keys = pairs.select(*names)
    cells = cells.unionByName(keys.join(alone.withColumnRenamed("source", "a"), ["lang", "a"]).select(*names, F.col("n").alias("n_a"), zero.cast("long").alias("n_b"), "terms"))
    cells = cells.unionByName(keys.join(alone.withColumnRenamed("source", "b"), ["lang", "b"]).select(*names, zero.cast("long").alias("n_a"), F.col("n").alias("n_b"), "terms"))
    cells = cells.unionByName(pairs.select(*names, F.inline(F.array(cell(zero, zero, F.col("v") - F.col("own_a") - F.col("own_b"))))))
    histogram = cells.groupBy(*names, "n_a", "n_b").agg(F.sum("terms").alias("terms")).where("terms > 0")
    sized = histogram.join(pairs, names)
    p, q = share(F.col("n_a"), F.col("size_a"), F.col("v")), share(F.col("n_b"), F.col("size_b"), F.col("v"))
    values = sized.select(*names, "terms", p.alias("p"), q.alias("q")).groupBy(*names).agg(F.sum(F.col("terms") * apart(F.col("p"), F.col("q"))).alias("value"))
    valued = keys.join(values, names, "left").select(*names, F.coalesce("value", F.lit(0)).alias("value"))
    sides = valued.select("lang", F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    by_pair = sides.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    own = counts.join(groups, ["lang", "source"])
    own = own.select("lang", "source", F.col("term").alias("item"), share(F.col("n"), F.col("size"), F.col("v")).alias("p"), share(F.col("total"), F.col("all"), F.col("v")).alias("q")).where("p > q")
    ranked = own.select("lang", "source", "item", apart(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return by_pair.unionByName(ranked.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
