"""Media columns: animated GIFs as rows of timed frames, and bytes stored as such.

``frames`` decodes GIF files: LZW code streams, global and local palettes, interlacing, transparency and
the disposal rules; it returns a row a frame with the canvas as it shows and a colour histogram.
``store`` keeps any bytes as a GIF of 8-bit samples with a grey palette, and ``load`` gets them back.

A null medium has no frames. Bytes that are no GIF, or one that breaks off, give one row with ``error`` set
and the frames before it. Repeated rows are decoded as often as they occur.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphsieve.llm.common import slices

#: Geometry of stored bytes: samples in a row, rows in a frame, hundredths of a second a frame shows.
WIDTH, ROWS, DELAY = 576, 16, 4
#: Each of red, green and blue falls into so many levels of the histogram.
LEVELS = 8
#: After a clear code, the width of the code number m (8-bit samples), and the bits before it.
FULL = 1 << 12
HISTOGRAM = "array<struct<colour:int,n:long>>"
FRAMES_SCHEMA = f"id long, frame int, start_cs long, delay_cs long, disposal int, x int, y int, width int, height int, canvas_width int, canvas_height int, pixels binary, samples binary, histogram {HISTOGRAM}, error string"


def schedule(bits: int, n: int) -> np.ndarray:
    """Widths of the first ``n`` codes after a clear code, for samples of ``bits`` bits."""
    held = (1 << bits) + 1 + np.arange(n)
    return np.clip(np.floor(np.log2(held)).astype(np.int64) + 1, bits + 1, 12)


_widths = {b: schedule(b, FULL) for b in range(2, 9)}
_starts = {b: np.concatenate([[0], np.cumsum(w)]) for b, w in _widths.items()}


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """The code stream of samples: begins with a clear code, and clears again whenever the table is full."""
    clear, first = 1 << bits, (1 << bits) + 2
    runs, codes, table, following = [], [], {}, first
    get, prefix = table.get, -1
    for sample in data:
        if prefix < 0:
            prefix = sample
            continue
        key = prefix << 8 | sample
        code = get(key)
        if code is not None:
            prefix = code
            continue
        codes.append(prefix)
        if following < FULL:
            table[key] = following
            following += 1
        else:
            codes.append(clear)
            runs.append(codes)
            codes, following = [], first
            table.clear()
        prefix = sample
    if prefix >= 0:
        codes.append(prefix)
    codes.append(clear + 1)
    runs.append(codes)
    values, widths = [np.array([clear])], [np.array([bits + 1])]
    for run in runs:
        values.append(np.array(run))
        widths.append(_widths[bits][: len(run)])
    value, width = np.concatenate(values), np.concatenate(widths)
    start = np.cumsum(width) - width
    flat = np.zeros(int(start[-1] + width[-1] + 24) // 8 + 3, np.uint8)
    shifted = value.astype(np.uint64) << (start % 8).astype(np.uint64)
    for i in range(3):
        # no two codes share more than a byte's bits, and these never overlap: adding is joining
        flat[: len(flat)] += np.bincount(start // 8 + i, (shifted >> np.uint64(8 * i)) & np.uint64(255), len(flat)).astype(np.uint8)
    return flat[: (int(start[-1] + width[-1]) + 7) // 8].tobytes()


def lzw_decode(stream: bytes, bits: int, most: int) -> bytes:
    """The first ``most`` samples of a code stream. Codes are cut out of the bits in blocks, as their widths are known."""
    clear = 1 << bits
    data = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    total, at, out, made = 8 * len(stream), 0, [], 0
    singles = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, previous, since, step = singles.copy(), b"", 0, 64
    while made < most:
        if since < FULL - step:
            width, place = _widths[bits][since : since + step], at + _starts[bits][since : since + step] - _starts[bits][since]
        else:
            width, place = np.minimum(schedule(bits, 1 << 16)[since : since + step] if since < (1 << 16) - step else np.full(step, 12), 12), None
            place = at + np.cumsum(width) - width
        fits = int(np.searchsorted(place + width, total, "right"))
        if not fits:
            break
        width, place = width[:fits], place[:fits]
        byte = place >> 3
        codes = ((data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16) >> (place & 7)) & ((1 << width) - 1)
        special = np.flatnonzero((codes == clear) | (codes == clear + 1))
        n = int(special[0]) if len(special) else fits
        for code in codes[:n].tolist():
            if not previous:
                entry = table[code]
            elif code < len(table):
                entry = table[code]
                if len(table) < FULL:
                    table.append(previous + entry[:1])
            elif code == len(table) and code < FULL:
                entry = previous + previous[:1]
                table.append(entry)
            else:
                raise ValueError("LZW code out of range")
            out.append(entry)
            made += len(entry)
            previous = entry
        since += n
        if len(special):
            if codes[n] == clear + 1:
                break
            at = int(place[n] + width[n])
            table, previous, since, step = singles.copy(), b"", 0, 64
        else:
            at = int(place[-1] + width[-1])
            step = min(1024, step * 2)
    return b"".join(out)[:most]


@dataclass
class Frame:
    x: int
    y: int
    width: int
    height: int
    delay: int
    disposal: int
    canvas: np.ndarray  # height, width, red green blue alpha
    samples: bytes  # of the frame's own rectangle


def interlaced(height: int) -> np.ndarray:
    """The rows in the order in which an interlaced image stores them."""
    return np.concatenate([np.arange(a, height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode(data: bytes) -> Iterator[Frame]:
    """Frames with the canvas that a viewer shows. Raises ValueError where the file breaks its format."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    wide, high, flags = struct.unpack_from("<HHB", data, 6)
    at = 13

    def palette(flags: int) -> np.ndarray:
        nonlocal at
        n = 2 << (flags & 7)
        if at + 3 * n > len(data):
            raise ValueError("palette breaks off")
        out = np.zeros((256, 3), np.uint8)
        out[:n] = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
        return out

    def blocks() -> bytes:
        nonlocal at
        held = []
        while True:
            if at >= len(data):
                raise ValueError("data breaks off")
            n = data[at]
            if not n:
                at += 1
                return b"".join(held)
            held.append(data[at + 1 : at + 1 + n])
            at += 1 + n

    shared = palette(flags) if flags & 0x80 else None
    canvas = np.zeros((high, wide, 4), np.uint8)
    delay = disposal = 0
    clear = None
    while at < len(data):
        mark = data[at]
        at += 1
        if mark == 0x3B:
            return
        if mark == 0x21:
            label = data[at] if at < len(data) else 0
            at += 1
            body = blocks()
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, body[1] | body[2] << 8
                clear = body[3] if body[0] & 1 else None
        elif mark == 0x2C:
            if at + 10 > len(data):
                raise ValueError("image breaks off")
            x, y, w, h, local = struct.unpack_from("<HHHHB", data, at)
            at += 9
            colours = palette(local) if local & 0x80 else shared
            bits = data[at]
            at += 1
            if not 2 <= bits <= 8 or colours is None:
                raise ValueError("no palette or odd sample size")
            raw = lzw_decode(blocks(), bits, w * h)
            if len(raw) < w * h:
                raise ValueError("image breaks off")
            index = np.frombuffer(raw, np.uint8).reshape(h, w)
            if local & 0x40:
                straight = np.empty_like(index)
                straight[interlaced(h)] = index
                index = straight
            old = canvas.copy() if disposal == 3 else None
            part = canvas[y : y + h, x : x + w]
            seen = index[: part.shape[0], : part.shape[1]]
            shown = np.concatenate([colours[seen], np.full((*seen.shape, 1), 255, np.uint8)], 2)
            if clear is None:
                part[:] = shown
            else:
                part[seen != clear] = shown[seen != clear]
            yield Frame(x, y, w, h, delay, disposal, canvas.copy(), index.tobytes())
            if disposal == 2:
                part[:] = 0
            elif disposal == 3:
                canvas = old
            delay, disposal, clear = 0, 0, None
        else:
            raise ValueError("unknown block")


def image_block(samples: bytes, x: int, y: int, w: int, h: int, delay: int = DELAY, disposal: int = 1, transparent: int | None = None) -> bytes:
    """A graphic control extension and an image of 8-bit samples for the shared palette."""
    control = struct.pack("<BBBBHB", 0x21, 0xF9, 4, disposal << 2 | (transparent is not None), delay, transparent or 0) + b"\0"
    stream = lzw_encode(samples)
    cut = b"".join(bytes([len(c)]) + c for c in (stream[i : i + 255] for i in range(0, len(stream), 255)))
    return control + struct.pack("<BHHHHB", 0x2C, x, y, w, h, 0) + b"\x08" + cut + b"\0"


GREY = bytes(v for i in range(256) for v in (i, i, i))


def payload(data: bytes) -> bytes:
    """``data`` with bytes 255 behind it, up to a positive multiple of WIDTH."""
    return data + b"\xff" * (-len(data) % WIDTH or (0 if data else WIDTH))


def to_gif(data: bytes) -> bytes:
    """Samples, a multiple of WIDTH, as frames of at most ROWS rows; the last may show fewer."""
    rows = len(data) // WIDTH
    high = min(rows, ROWS)
    parts = [b"GIF89a" + struct.pack("<HHBBB", WIDTH, high, 0xF7, 0, 0) + GREY]
    for at in range(0, rows, ROWS):
        h = min(ROWS, rows - at)
        parts.append(image_block(data[at * WIDTH : (at + h) * WIDTH], 0, 0, WIDTH, h))
    return b"".join(parts) + b"\x3b"


def histogram(canvas: np.ndarray) -> list[dict]:
    """How many opaque pixels have each quantised colour; only colours that occur."""
    flat = canvas.reshape(-1, 4)
    step = 256 // LEVELS
    colour = flat[flat[:, 3] > 0, :3].astype(np.int64) // step
    counts = np.bincount(colour @ np.array([LEVELS * LEVELS, LEVELS, 1]))
    return [{"colour": int(c), "n": int(counts[c])} for c in np.flatnonzero(counts)]


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and ``media``: each text's UTF-8 bytes as a GIF. Null counts as empty."""
    chosen = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("binary"), F.lit(b"")).alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "data", most=4 << 20):
            data = batch.column("data").to_pylist()
            media = [to_gif(payload(d)) for d in data]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([*map(len, data)], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return chosen.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def frames(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each frame (FRAMES_SCHEMA): its time, rectangle, samples, shown canvas and histogram."""
    kinds = pa.schema([("id", pa.int64()), ("frame", pa.int32()), ("start_cs", pa.int64()), ("delay_cs", pa.int64()), *((c, pa.int32()) for c in ("disposal", "x", "y", "width", "height", "canvas_width", "canvas_height")), ("pixels", pa.binary()), ("samples", pa.binary()), ("histogram", pa.list_(pa.struct([("colour", pa.int32()), ("n", pa.int64())]))), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", most=1 << 20):
            for key, data in zip(batch.column("id").to_pylist(), batch.column("media").to_pylist(), strict=True):
                rows, clock, number = [], 0, 0
                try:
                    for f in decode(data):
                        high, wide = f.canvas.shape[:2]
                        rows.append([key, number, clock, f.delay, f.disposal, f.x, f.y, f.width, f.height, wide, high, f.canvas.tobytes(), f.samples, histogram(f.canvas), None])
                        clock, number = clock + f.delay, number + 1
                        if len(rows) == 64:  # a long film doesn't wait for its end
                            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)
                            rows = []
                except (ValueError, IndexError) as error:
                    rows.append([key, number, clock, *[None] * 11, str(error)])
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    chosen = media.where(media[media_col].isNotNull()).select(media[id_col].alias("id"), media[media_col].alias("media"))
    return chosen.mapInArrow(run, FRAMES_SCHEMA)


@dataclass
class Loaded:
    data: bytes
    n_frames: int
    total_cs: int
    counts: np.ndarray


def load_one(media: bytes) -> Loaded:
    """The samples of a stored GIF in order, and its frames' summed histogram (grey levels)."""
    parts, clock = [], 0
    for f in decode(media):
        # the frame's rows as the canvas shows them: palette, transparency and disposal have been applied
        parts.append(f.canvas[f.y : f.y + f.height, f.x : f.x + f.width, 0].tobytes())
        clock += f.delay
    data = b"".join(parts)
    counts = np.bincount(np.frombuffer(data, np.uint8) // (256 // LEVELS), minlength=LEVELS)
    return Loaded(data, len(parts), clock, counts)


def load(stored: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``store`` with ``data`` (the payload read back), ``n_frames``, ``total_cs`` and ``grey``, the counts of LEVELS grey levels.

    The media pass through unchanged; columns named in ``keep`` too.
    """
    names = ["doc_id", "n_bytes", *keep, "media"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", most=4 << 20):
            got = [load_one(m) for m in batch.column("media").to_pylist()]
            more = [pa.array([g.data for g in got], pa.binary()), pa.array([g.n_frames for g in got], pa.int32()), pa.array([g.total_cs for g in got], pa.int64()), pa.array([g.counts.tolist() for g in got], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*names, "data", "n_frames", "total_cs", "grey"])

    chosen = stored.select(*names)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema)
    return chosen.mapInArrow(run, f"{kinds}, data binary, n_frames int, total_cs long, grey array<long>")
