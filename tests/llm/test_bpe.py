"""The segment-tree encoder against the tiktoken library, and exact round trips."""

import base64

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from graphsieve.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, ids string, sequence_id int"
TEXTS = ["", None, "a", "Hello,  world.\n\nIt's 12 o'clock ", "same", "same", "é ü ñ 漢字   x\t", "<|endoftext|> ok", "ab " * 3000, "longword" * 3000, "x" * 300]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Code points that are unassigned here may be letters in a newer Unicode version, on one side alone.
ASSIGNED = st.characters(exclude_categories=("Cs", "Cn"))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aentsi'sZ9 .,\n\té漢²"), max_size=60) | st.text(ASSIGNED, max_size=30), max_size=4))
def test_like_the_library(library, batch):
    own = bpe.bpe_of(PATH, public_tokenizers.PATTERN)
    for text, ids in zip(batch, own.encode_batch(batch), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_long_words_take_the_same_merges(library):
    own, rng = bpe.bpe_of(PATH, public_tokenizers.PATTERN), np.random.default_rng(3)
    for n in (2, 3, 17, 255, 256, 257, 1500):
        word = "".join(rng.choice(list("abenstioéñ"), n))
        assert own.encode_long(word.encode()).tolist() == library.encode_ordinary(word)


def test_frames(spark, library):
    rows = [*enumerate(TEXTS), (None, "null id"), (4, "same")]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)
    got = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, bytes(r.ids)) for r in got) == sorted((i is None, i or 0, np.array(library.encode_ordinary(t or ""), "<u4").tobytes()) for i, t in rows)
    assert sorted(bytes(r.data) for r in got) == sorted((t or "").encode() for _, t in rows)
    assert bpe.decode(bpe.encode(docs.limit(0), PATH), PATH).count() == 0
