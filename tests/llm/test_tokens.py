"""Packing and the token store against the tokenizers library and exact round trips."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphsieve.llm import packing, token_store
from graphsieve.llm.common import work_path
from graphsieve.llm.tokens import Ids, ids_of

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, start string, sequence_id int, part string, shard int"
TEXTS = ["", None, "a", "Hello, world.\nIt's  12 o'clock ", "same text here", "same text here", "é ü ñ 漢字   x", "<|endoftext|> ok", "ab " * 3000, "long" * 5000, " lead", "tab\there"]


@pytest.fixture(scope="module")
def ids():
    return Ids(PATH)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in rows], SCHEMA)


def expected(ids, text):
    return ids.tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'sZ9 .,\n\t\r\x0b\x1c\x85\xa0é漢² ª"), max_size=30) | st.text(max_size=30))
def test_pieces_encode_like_the_library(text):
    known = ids_of(PATH)
    assert np.frombuffer(known.encode(text), known.dtype).tolist() == expected(known, text)


def test_packing(spark, ids):
    rows = [*enumerate(TEXTS), (3, TEXTS[3]), (None, "null id")]
    got = packing.pack(frame(spark, rows).repartition(3), PATH, end_id=0).collect()
    bins, docs = defaultdict(list), defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
    for i, text in rows:
        whole = [*expected(ids, text), 0]
        own, at = sorted(docs[i]), 0
        copies = 2 if i == 3 else 1
        assert sum(x[1] for x in own) == copies * len(whole)
        for start, length, c, n in own:
            assert n == len(whole) and c == crc(whole[start : start + length])
            assert copies == 2 or start == at
            at = start + length
    assert packing.pack(frame(spark, []), PATH).collect() == []
    with pytest.raises(ValueError):
        packing.pack(frame(spark, []), PATH, capacity=5000)


def test_packing_pads_little(ids):
    packer, rng, rows, total = packing.Packer(1024, 3), np.random.default_rng(1), [], 0
    for i in range(2000):
        n = int(rng.integers(1, 3000))
        total += n
        rows += packer.add(i, np.arange(n, dtype="<u2"))
    rows += packer.close()
    used = defaultdict(int)
    for r in rows:
        used[r[5]] += r[2]
    padded = sum(n if n & (n - 1) == 0 else 1024 for n in used.values())
    assert sum(used.values()) == total and padded / total < 1.005


def test_token_store(spark, ids):
    rows = [*enumerate(TEXTS), (3, TEXTS[3]), (None, "null id")]
    path = work_path(spark, "t")
    token_store.save(frame(spark, rows).repartition(3), path, PATH, end_id=2, shard_tokens=50)
    got = sorted(token_store.read(spark, path).collect(), key=lambda r: r.start)
    want, at = [], 0
    for i, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        whole = [*expected(ids, text), 2]
        want.append((i, at, len(whole), crc(whole)))
        at += len(whole)
    assert [tuple(r) for r in got] == want
    empty = work_path(spark, "e")
    token_store.save(frame(spark, []), empty, PATH)
    assert token_store.read(spark, empty).count() == 0


def test_plain_texts_take_the_rank_encoder(ids):
    assert ids.fast is not None
    words = ["the", "thonly", "ingble", "Überfluß", "niño,", "it's", "12.5", "Привет", "αβγ", "“so”", "—", "…", "€5", "x" * 30, "\n", "\n\n", "  "]
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(words, int(rng.integers(1, 80)))) for _ in range(300)] + ["a" * 50_000, " " * 50_000, "b " * 30_000]
    assert sum(ids.plain(t) for t in texts) >= 300
    for text in texts:
        assert np.frombuffer(ids.encode(text), ids.dtype).tolist() == expected(ids, text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), min_size=1, max_size=60), min_size=1, max_size=6), st.integers(2, 5))
def test_repair_leaves_no_frequent_pair(docs, least):
    ids = np.concatenate([np.array(d, "<u2") for d in docs])
    last = np.zeros(len(ids), bool)
    last[np.cumsum([*map(len, docs)]) - 1] = True
    seq, ends, left, right, lengths = token_store.repair(ids, last, 10, least)
    expand = lambda x: [x] if x < 10 else expand(int(left[x - 10])) + expand(int(right[x - 10]))
    got, doc = [[]], 0
    for x, end in zip(seq.tolist(), ends.tolist(), strict=True):
        got[-1] += expand(x)
        if end:
            got.append([])
    assert got[:-1] == docs and [len(expand(10 + i)) for i in range(len(left))] == lengths.tolist()
    assert len(set(zip(left.tolist(), right.tolist(), strict=True))) == len(left)
    times, at = defaultdict(int), 0
    while at < len(seq) - 1:  # a run of one symbol counts every other pair
        if not ends[at]:
            times[seq[at], seq[at + 1]] += 1
        run = at + 1
        while seq[at] == seq[run] and not ends[at] and run < len(seq) - 1 and seq[run + 1] == seq[at] and not ends[run]:
            times[seq[at], seq[at]] += (run - at) % 2 == 0
            run += 1
        at = run
    assert all(n < least for n in times.values())


def test_one_id_for_many_rows(spark):
    rows = [(7, f"text number {i % 50} of many") for i in range(400)] + [(None, "same")] * 100 + [(9, "z")]
    path = work_path(spark, "hot")
    token_store.save(frame(spark, rows).repartition(3), path, PATH)
    got = sorted(token_store.read(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 100 + [7] * 400 + [9]
    assert all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:], strict=False))


def test_repair_round_trip_and_random_access():
    rng = np.random.default_rng(7)
    phrase = rng.integers(0, 50000, 40)
    parts = [np.concatenate([phrase[: rng.integers(1, 40)] if rng.random() < 0.8 else rng.integers(0, 9, 30) for _ in range(20)]).astype("<u2") for _ in range(60)]
    parts += [np.array([2], "<u2"), np.full(1000, 7, "<u2")]
    payload = token_store.to_payload(parts, 50257)
    shard = token_store.Shard(payload)
    assert len(shard.left) > 5 and len(payload) < sum(map(len, parts)) * 2
    for i, part in enumerate(parts):
        assert shard.document(i).tolist() == part.tolist()
        for _ in range(5):
            a = int(rng.integers(0, len(part)))
            b = int(rng.integers(a + 1, len(part) + 1))
            assert shard.slice(i, a, b).tolist() == part[a:b].tolist()
    whole, begins = shard.all()
    assert whole.tolist() == np.concatenate(parts).tolist() and begins.tolist() == np.concatenate([[0], np.cumsum([*map(len, parts)])]).tolist()
    with pytest.raises(ValueError):
        token_store.Shard(b"nope" + payload[4:])


def test_least_reaches_every_writer(spark, ids):
    rng = np.random.default_rng(2)
    parts = [rng.integers(0, 6, int(rng.integers(1, 60))).astype("<u2") for _ in range(60)]
    sizes = {}
    for least in (2, 8, 10**6):
        payload = token_store.to_payload(parts, 10, least)
        shard = token_store.Shard(payload)
        assert all((shard.document(i) == p).all() for i, p in enumerate(parts))
        sizes[least] = len(shard.symbols)
    assert sizes[2] < sizes[8] < sizes[10**6] == sum(map(len, parts))
    texts = [(i, "one two three four " * 5) for i in range(6)]
    counted = {}
    for least in (2, 10**6):
        shards = token_store.encode(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), PATH, least=least)
        counted[least] = sum(len(token_store.Shard(bytes(r.payload)).symbols) for r in shards.collect())
    assert counted[2] < counted[10**6]
