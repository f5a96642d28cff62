"""GIF: round trips, hand-made files with transparency, disposal, interlacing and local palettes."""

import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphsieve.llm import gif

SCHEMA = "doc_id long, text string, media string, data int, id int"


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 40))
def test_lzw_round_trip(data, times):
    data = data * times
    assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)) == data


def test_lzw_full_table_and_literals():
    data = np.random.default_rng(1).integers(0, 256, 60_000).astype(np.uint8).tobytes()
    assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)) == data
    # a table that stays full: no clear code before the end
    rng = np.random.default_rng(2)
    samples, codes, table, following = rng.integers(0, 4, 40_000).tolist(), [], {}, 6
    prefix = samples[0]
    for s in samples[1:]:
        if (prefix, s) in table:
            prefix = table[prefix, s]
        else:
            codes.append(prefix)
            if following < 4096:
                table[prefix, s] = following
                following += 1
            prefix = s
    codes += [prefix, 5]
    value, at = 4, 3
    for m, c in enumerate(codes):
        value |= c << at
        at += min(12, max(3, (5 + m).bit_length()))
    assert gif.lzw_decode(value.to_bytes((at + 7) // 8, "little"), 2, len(samples)) == bytes(samples)


def test_payload():
    for n in (0, 1, 575, 576, 577):
        p = gif.payload(b"x" * n)
        assert len(p) == max(1, -(-n // 576)) * 576 and p.rstrip(b"\xff") == b"x" * n


def test_compositing():
    head = b"GIF89a" + struct.pack("<HHBBB", 4, 2, 0xF7, 0, 0) + gif.GREY
    a = gif.image_block(bytes(range(10, 18)), 0, 0, 4, 2, delay=5, disposal=1)
    b = gif.image_block(bytes([7, 99]), 1, 0, 2, 1, delay=6, disposal=3, transparent=7)  # one pixel shows, then goes
    c = gif.image_block(bytes([50]), 0, 1, 1, 1, delay=7, disposal=2)  # cleared afterwards
    d = gif.image_block(bytes([60]), 3, 1, 1, 1, delay=8)
    shown = [*gif.decode(head + a + b + c + d + b";")]
    grey = [f.canvas[..., 0].ravel().tolist() for f in shown]
    assert grey[0] == [10, 11, 12, 13, 14, 15, 16, 17]
    assert grey[1] == [10, 11, 99, 13, 14, 15, 16, 17]
    assert grey[2] == [10, 11, 12, 13, 50, 15, 16, 17]
    assert grey[3] == [10, 11, 12, 13, 0, 15, 16, 60] and shown[3].canvas[1, 0, 3] == 0
    assert [f.delay for f in shown] == [5, 6, 7, 8]
    assert gif.histogram(shown[3].canvas)[0] == {"colour": 0, "n": 6}


def test_interlaced_local_palette():
    rows = gif.interlaced(9)
    assert sorted(rows.tolist()) == list(range(9)) and rows.tolist()[:3] == [0, 8, 4]
    stream = gif.lzw_encode(bytes(int(r) for r in rows), 8)
    local = bytes(v for i in range(256) for v in (255 - i, i, 0))
    data = b"GIF87a" + struct.pack("<HHBBB", 1, 9, 0, 0, 0) + struct.pack("<BHHHHB", 0x2C, 0, 0, 1, 9, 0x80 | 0x40 | 7) + local + b"\x08" + bytes([len(stream)]) + stream + b"\0;"
    (frame,) = gif.decode(data)
    assert frame.canvas[:, 0, 1].tolist() == list(range(9)) and frame.canvas[:, 0, 0].tolist() == [255 - i for i in range(9)]


def test_frames(spark):
    rows = [(1, "abc", "x", 1, 2), (2, None, "x", 1, 2), (3, "", "x", 1, 2), (3, "", "x", 1, 2), (None, "é" * 30_000, "x", 1, 2)]
    stored = gif.store(spark.createDataFrame(rows, SCHEMA)).cache()
    back = {(r.doc_id, r.n_bytes): bytes(r.data) for r in gif.load(stored).collect()}
    assert back == {(i, len((t or "").encode())): gif.payload((t or "").encode()) for i, t, *_ in rows}
    whole = spark.createDataFrame([(9, b"junk"), (10, None), (11, bytes(stored.first().media)[:-900])], "doc_id long, media binary")
    got = gif.frames(whole).collect()
    assert sorted(r.id for r in got) == [9, 11] and all(r.error for r in got)
    shown = gif.frames(stored.where("doc_id is null")).orderBy("frame").collect()
    assert len(shown) == 7 and shown[3].start_cs == 3 * gif.DELAY and all(sum(h.n for h in r.histogram) == r.canvas_width * r.canvas_height for r in shown[:6])
    assert gif.load(gif.store(spark.createDataFrame([], SCHEMA))).count() == 0


def test_errors():
    for bad in (b"", b"GIF89a", b"GIF89a" + bytes(7) + b"\x99"):
        with pytest.raises(ValueError):
            list(gif.decode(bad))
