"""N-gram Jaccard join: MinHash LSH forest, followed by exact verification.

A document is the set of its runs of WORDS words (in lower case, split at white space; a shorter text is
one run). Documents with the same set are one node, whatever their number. In each of TREES trees a node
has a signature of MAX_DEPTH letters (16 bits of a minimum hash each). Sorted by signature, a tree is a prefix trie.
Two nodes are candidates if they share a prefix in some tree. Prefixes are matched at full length first and then
a letter less each round. The signatures of a round's candidates tell how alike they are, and so with which chance pairs like these
share a prefix of that length in some tree; rounds end when that chance is at least the wanted recall for
the least alike candidates found, or when the prefix is so short that it is for the wanted similarity itself.

Large groups: nodes that share a prefix are dealt into blocks of BLOCK nodes by hash (fewer, if their sets are large), and every
pair of blocks is a unit of work of bounded size, so a node of a group of n is shipped n / BLOCK times: counting all links
within a group takes its square of comparisons, in products of matrices. A pair belongs to the first round that finds it and there to the first
tree, so each pair is looked at once, and sums over units are counts of distinct links. In the rounds
only signatures are compared; shingle sets are then shipped only to units where a node has a candidate.
A unit compares shingle sets exactly (64-bit hashes of shingles, intersections by matrix products), and returns
a row for each node with its number of links and its component within the unit: never a row for each pair.
Components then grow together by the alternating large-star and small-star steps, each written to the
shared folder. A step joins each node's least neighbour to its edges: one component's root has as many edges there as the component
has units and nodes, which is skew that Spark splits where a join's side is large (adaptive skew joins), not here.

Null and empty texts have no shingles; they are copies of each other. Repeated rows are copies. An empty
table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphsieve.llm.common import slices, texts, written

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.999
TREES, MAX_DEPTH = 10, 6
#: Most nodes of a block, about, and most shingles.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 18
#: Steps of estimated similarity, of the whole, in which candidates are counted.
STEPS = TREES * MAX_DEPTH
_rng = np.random.default_rng(20240)
#: Odd factors and summands of the hash functions, a row for each tree.
FACTORS = _rng.integers(1 << 62, (1 << 63) - 1, (TREES, MAX_DEPTH), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
SUMMANDS = _rng.integers(0, (1 << 63) - 1, (TREES, MAX_DEPTH), dtype=np.int64).astype(np.uint64)


def recall_at(depth: int, trees: int = TREES, similarity: float = SIMILARITY) -> float:
    """The chance that two documents of this similarity agree on so long a prefix in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_depth(recall: float = RECALL, trees: int = TREES, similarity: float = SIMILARITY) -> int:
    """The longest prefix with that recall, found by shortening; 1 if none has it."""
    depth = MAX_DEPTH
    while depth > 1 and recall_at(depth, trees, similarity) < recall:
        depth -= 1
    return depth


def shingles(text: str, n_words: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of the text's runs of words, ascending."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(n_words, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        out = (out ^ hashed[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def node_of(found: np.ndarray) -> bytes:
    """16 bytes that stand for a set of shingles."""
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def letters(sets: list[np.ndarray]) -> np.ndarray:
    """Signatures: for each set, tree and depth 16 bits of a minimum hash."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), TREES, MAX_DEPTH), "<u2")
    for tree in range(TREES):
        for k in range(MAX_DEPTH):
            low = np.minimum.reduceat(flat * FACTORS[tree, k] + SUMMANDS[tree, k], starts)
            out[:, tree, k] = (low * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(48)
    return out


def signatures(docs: DataFrame, n_words: int) -> DataFrame:
    """doc_id, h, node, size (of the set), sig (letters of all trees; null where there are no shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=4 << 20):
            sets = [shingles(t, n_words) for t in batch.column("text").to_pylist()]
            full = [s for s in sets if len(s)]
            rows = iter(letters(full) if full else ())
            signed = [next(rows).tobytes() if len(s) else None for s in sets]
            own = [pa.array([node_of(s) for s in sets], pa.binary()), pa.array([*map(len, sets)], pa.int32()), pa.array(signed, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("h"), *own], ["doc_id", "h", "node", "size", "sig"])

    return docs.withColumn("h", F.xxhash64("text")).mapInArrow(run, "doc_id long, h long, node binary, size int, sig binary")


def units(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Runs of rows with the same depth, tree, key, i and j; the rows come sorted by these."""
    held, last = [], None
    for row in (row for batch in batches for at in range(0, batch.num_rows, 128) for row in batch.slice(at, 128).to_pylist()):
        key = row["depth"], row["tree"], row["key"], row["i"], row["j"]
        if key != last and held:
            yield held
            held = []
        last = key
        held.append(row)
    if held:
        yield held


def codes(sigs: np.ndarray, depth: int) -> np.ndarray:
    """For each node and tree a number that stands for its prefix of this length."""
    out = np.empty(sigs.shape[:2], np.int64)
    for tree in range(TREES):
        prefix = np.ascontiguousarray(sigs[:, tree, :depth]).view(f"V{2 * depth}").ravel()
        out[:, tree] = np.unique(prefix, return_inverse=True)[1]
    return out


def candidates(unit: list[dict], similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs within a unit, and how many letters they share.

    Pairs of different blocks (or all pairs of its one block) that share no longer prefix in any tree and this one in no
    earlier tree, and whose sets' sizes allow the similarity.
    """
    depth, tree, i, j = (unit[0][k] for k in ("depth", "tree", "i", "j"))
    sigs = np.frombuffer(b"".join(r["sig"] for r in unit), "<u2").reshape(len(unit), TREES, MAX_DEPTH)
    size, block = np.array([r["size"] for r in unit]), np.array([r["block"] for r in unit])
    if i == j:
        a, b = np.triu_indices(len(unit), 1)
    else:
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        a, b = np.repeat(left, len(right)), np.tile(right, len(left))
    fits = np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]) - 1e-9
    a, b = a[fits], b[fits]
    code = codes(sigs, depth)
    longer = codes(sigs, depth + 1) if depth < MAX_DEPTH else None
    for t in range(TREES):
        new = np.ones(len(a), bool)
        if t < tree:
            new &= code[a, t] != code[b, t]
        if longer is not None:
            new &= longer[a, t] != longer[b, t]
        a, b = a[new], b[new]
    flat = sigs.reshape(len(unit), -1)
    shared = np.concatenate([np.zeros(0, np.int64), *((flat[a[at : at + 4096]] == flat[b[at : at + 4096]]).sum(1) for at in range(0, len(a), 4096))])
    return a, b, shared


def with_candidates(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of units that take part in some candidate pair; then a row without node for each number of shared letters (in ``i``) with how many pairs share so many (in ``copies``)."""
        seen = np.zeros(STEPS + 1, np.int64)
        for unit in units(batches):
            a, b, shared = candidates(unit, similarity)
            if len(a):
                seen += np.bincount(shared, minlength=STEPS + 1)
                yield pa.RecordBatch.from_pylist([unit[k] for k in np.union1d(a, b).tolist()], schema=MEMBER)
        yield pa.RecordBatch.from_pylist([{"i": k, "copies": int(seen[k])} for k in np.flatnonzero(seen).tolist()], schema=MEMBER)

    return run


MEMBER_SCHEMA = "depth int, tree int, key binary, i int, j int, block int, node binary, copies long, size int, sig binary"
MEMBER = pa.schema([("depth", pa.int32()), ("tree", pa.int32()), ("key", pa.binary()), ("i", pa.int32()), ("j", pa.int32()), ("block", pa.int32()), ("node", pa.binary()), ("copies", pa.int64()), ("size", pa.int32()), ("sig", pa.binary())])
UNIT = ["depth", "tree", "key", "i", "j"]


def linked(unit: list[dict], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The candidate pairs whose Jaccard similarity is large enough, worked out exactly."""
    a, b, _ = candidates(unit, similarity)
    sets = [np.frombuffer(r["shingles"], np.uint64) for r in unit]
    sizes = np.array([len(s) for s in sets])
    if not len(a):
        return a, b
    if len(a) <= 4 * len(unit):
        common = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a.tolist(), b.tolist(), strict=True)])
    else:
        values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), sizes)
        shared = times[column] > 1
        row, column = row[shared], np.cumsum(times > 1)[column[shared]] - 1
        together = np.zeros((len(sets), len(sets)), np.float32)
        for at in range(0, int((times > 1).sum()), 2048):
            here = (column >= at) & (column < at + 2048)
            has = np.zeros((len(sets), 2048), np.float32)
            has[row[here], column[here] - at] = 1
            together += has @ has.T
        common = together[a, b].astype(np.int64)
    near = common >= similarity * (sizes[a] + sizes[b] - common) - 1e-9
    return a[near], b[near]


def verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in units(batches):
            unit = [*{r["node"]: r for r in unit}.values()]
            a, b = linked(unit, similarity)
            if not len(a):
                continue
            copies = np.array([r["copies"] for r in unit])
            n = len(unit)
            texts_linked = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
            docs_linked = np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
            root = np.arange(n)
            while True:  # the least index spreads along the links
                low = np.minimum(root[a], root[b])
                new = root.copy()
                np.minimum.at(new, a, low)
                np.minimum.at(new, b, low)
                new = new[new]
                if (new == root).all():
                    break
                root = new
            some = np.flatnonzero(texts_linked)
            nodes = [unit[k]["node"] for k in some.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array([unit[k]["node"] for k in root[some].tolist()], pa.binary()), pa.array(texts_linked[some], pa.int64()), pa.array(docs_linked[some].astype(np.int64), pa.int64())], ["node", "root", "n_texts", "n_docs"])

    return run


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """a, b (any comparable type, undirected) to ``node`` and ``root``, the least node of its component; nodes without edges are not listed.

    Alternates large-star and small-star until nothing changes: about log n rounds, whatever the paths' length.
    A round groups by node with partial sums and joins the least neighbour back, so that no task holds a node's neighbours.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        # both directions; each node u learns the least of itself and (large) all or (small) its smaller neighbours
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b"), F.col("a")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        rows = both.join(least, "u")
        if large:
            out = rows.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            down = rows.where("v < u").select(F.col("v").alias("a"), F.col("m").alias("b"))
            out = down.union(least.select(F.col("u"), F.col("m")))
        return out.where("a <> b").distinct()

    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while not now.isEmpty():
        new = written(star(star(now, True), False), name)
        changed = new.exceptAll(now).isEmpty() and now.exceptAll(new).isEmpty()
        now = new
        if changed:
            break
    lone = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(lone)


def round_of(trie: DataFrame, depth: int) -> DataFrame:
    """MEMBER rows of the units in which nodes share a prefix of this length, but not all of them one letter more."""
    keyed = trie.withColumn("key", F.expr(f"substring(sig, tree * {2 * MAX_DEPTH} + 1, {2 * depth})"))
    letter = F.expr(f"substring(sig, tree * {2 * MAX_DEPTH} + {2 * depth + 1}, 2)")
    more = F.min(letter) != F.max(letter) if depth < MAX_DEPTH else F.lit(True)
    groups = keyed.groupBy("tree", "key").agg(F.count("*").alias("n"), F.sum(F.col("size").cast("long")).alias("all"), more.alias("new")).where("n > 1 and new").select("tree", "key", "n", "all")
    blocks = F.least("n", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("all") / BLOCK_SHINGLES)))
    members = keyed.join(groups, ["tree", "key"]).withColumn("blocks", blocks.cast("int"))
    members = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return members.select(F.lit(depth).alias("depth"), "tree", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "copies", "size", "sig")


def classes(docs: DataFrame, similarity: float, recall: float, n_words: int) -> tuple[DataFrame, DataFrame]:
    """From doc_id and text: the rows' nodes (doc_id, h, node), and for each node its class (root), least row, copies and links.

    A row is known by its id and a hash of its text; rows that agree in both are copies.
    """
    signed = written(signatures(docs, n_words), "nj-signed")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    nodes = written(signed.groupBy("node").agg(F.min(row).alias("least"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("sig").alias("sig")), "nj-nodes")

    # the forest, from the shortest prefix that may be wanted on: nodes that are alone there have no candidates
    shortest = prefix_depth(recall, TREES, similarity)
    keyed = nodes.where("sig is not null").select("node", "copies", "size", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    prefix = F.expr(f"substring(sig, tree * {2 * MAX_DEPTH} + 1, {2 * shortest})")
    groups = keyed.groupBy("tree", prefix.alias("prefix")).agg(F.count("*").alias("n")).where("n > 1").select("tree", "prefix")
    trie = keyed.withColumn("prefix", prefix).join(groups, ["tree", "prefix"]).drop("prefix")
    trie = written(trie.sortWithinPartitions("tree", F.expr(f"substring(sig, tree * {2 * MAX_DEPTH} + 1, {2 * MAX_DEPTH})")), "nj-trie")
    asked = None
    for depth in range(MAX_DEPTH, shortest - 1, -1):
        found = written(round_of(trie, depth).repartition(*UNIT).sortWithinPartitions(*UNIT).mapInArrow(with_candidates(similarity), MEMBER_SCHEMA), "nj-asked")
        asked = found if asked is None else asked.union(found)
        alike = asked.where("node is null and i is not null").groupBy("i").agg(F.sum("copies").alias("n")).collect()  # STEPS + 1 rows at most
        near = [r.i / STEPS for r in alike if r.i / STEPS >= similarity]
        if near and recall_at(depth, TREES, min(near)) >= recall:
            break
    asked = asked.where("node is not null")

    # shingle sets of the nodes asked for, made anew from one document of each
    wanted = asked.select("node").distinct().join(nodes.select("node", "least"), "node").select(F.col("least.doc_id").alias("one"), F.col("least.h").alias("h")).distinct()
    some = docs.withColumn("h", F.xxhash64("text")).alias("d").join(wanted.alias("w"), F.expr("d.doc_id <=> w.one and d.h = w.h"), "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=4 << 20):
            found = [shingles(t, n_words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], ["node", "shingles"])

    held = some.select("text").mapInArrow(sets, "node binary, shingles binary").dropDuplicates(["node"])
    full = asked.join(held, "node").repartition(*UNIT).sortWithinPartitions(*UNIT)
    found = written(full.mapInArrow(verify(similarity), "node binary, root binary, n_texts long, n_docs long"), "nj-links")

    links = found.groupBy("node").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_docs").alias("n_docs"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "nj-components")
    told = nodes.join(roots, "node", "left").join(links, "node", "left")
    return signed.select("doc_id", "h", "node"), told.select("node", F.coalesce("root", "node").alias("root"), "least", "copies", F.coalesce("n_texts", F.lit(0)).alias("n_texts"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, recall: float = RECALL, n_words: int = WORDS) -> DataFrame:
    """A row for each row: doc_id, class_id, n_links, n_texts, n_copies.

    ``class_id``: the least id in its class, the documents that links and copies connect. ``n_links``: how many other
    documents are at least ``similarity`` alike, copies counted; ``n_texts``: how many other sets of
    shingles; ``n_copies``: documents with this set, itself included. Null ids are listed, but name a class only
    where no other id does.
    """
    rows, nodes = classes(texts(docs, id_col, text_col), similarity, recall, n_words)
    least = nodes.groupBy("root").agg(F.min("least").alias("first"))
    told = nodes.join(least, "root").select("node", F.col("first.doc_id").alias("class_id"), (F.col("n_docs") + F.col("copies") - 1).alias("n_links"), "n_texts", F.col("copies").alias("n_copies"))
    return rows.join(told, "node").select("doc_id", "class_id", "n_links", "n_texts", "n_copies")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, recall: float = RECALL, n_words: int = WORDS) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class the row with the least id stays, and among equal ids the one with the least hash of its text.

    Null ids come last. Ids may repeat, within a class or across classes: each class keeps one row. Of rows with the same id and
    text the one with the least hash of the other columns stays.
    """
    rows, nodes = classes(texts(docs, id_col, text_col), similarity, recall, n_words)
    kept = nodes.groupBy("root").agg(F.min("least").alias("first")).select(F.col("first.doc_id").alias("kept_id"), F.col("first.h").alias("kept_h"))
    kept = written(kept, "nj-kept")
    repeated = rows.groupBy(F.col("doc_id").alias("kept_id"), F.col("h").alias("kept_h")).agg(F.count("*").alias("n")).where("n > 1")
    same = F.expr("k.kept_id <=> r.kept_id and k.kept_h = r.kept_h")
    lead = "row"
    while any(c.startswith(lead) for c in docs.columns):
        lead += "_"
    keyed = docs.select(docs[id_col].cast("long").alias(f"{lead}id"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias(f"{lead}h"), F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias(f"{lead}all"))

    def of(keys: DataFrame) -> DataFrame:
        return keyed.join(keys, keyed[f"{lead}id"].eqNullSafe(keys["kept_id"]) & (keyed[f"{lead}h"] == keys["kept_h"]), "left_semi")

    alone = of(kept.alias("k").join(repeated.alias("r"), same, "left_anti")).select(F.col(f"{lead}all"))
    others = [c for c in docs.columns if c not in (id_col, text_col) and "map<" not in dict(docs.dtypes)[c]]
    order = F.xxhash64(*(F.col(f"{lead}all")[c] for c in others)) if others else F.lit(0)
    several = of(kept.alias("k").join(repeated.alias("r"), same, "left_semi")).groupBy(f"{lead}id", f"{lead}h").agg(F.min_by(f"{lead}all", order).alias(f"{lead}all")).select(f"{lead}all")
    return alone.union(several).select(*(F.col(f"{lead}all")[c].alias(c) for c in docs.columns))
