"""Media columns: GIF89a decoding and encoding, timed frames and colour
histograms, in numpy.

The decoder reads any GIF: it walks the blocks, undoes LZW code streams
(clear and end codes, growing code widths, the code that is not yet in the
table, full tables), applies global and local palettes, interlacing,
transparency and the disposal rules (leave, background, previous), and gives
frames with start times and durations.

LZW is undone by vector operations between two clear codes: the widths of the
codes follow from their number alone, so they are cut out of the stream at
once; each entry of the table is a stretch of the output written before, so
lengths and samples follow by jumping along these references, doubling the
step each time.

Scale: map-only; a row is on its own. Texts are stored as frames of at most
64 x 4096 pixels, so a long text is a film of many frames and the working
memory beyond the text is a few frames. Every frame is drawn in full (palette,
disposal, transparency, time) and kept as a row of ``frames``.

Defined results: null and empty texts are a payload of 64 zero bytes; equal
texts give equal files; null ids stay; an empty table gives an empty result;
other columns are ignored. A file that is cut short or broken, or whose canvas
or image claims over ``MAX_PIXELS`` pixels, raises ``ValueError`` in ``decode``;
``media_table`` records it in ``error`` and keeps the frames before it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.common import table, text_bytes

WIDTH = 64
ROWS = 4096
#: Hundredths of a second that a frame of a stored text stands.
DELAY = 4
#: The largest canvas or image that is drawn.
MAX_PIXELS = 1 << 26
GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()


@dataclass
class Frame:
    """A whole canvas: RGBA pixels, when it begins and how long it stands (ms),
    and the colour numbers that its image block wrote."""

    rgba: np.ndarray
    start_ms: int
    duration_ms: int
    samples: np.ndarray


# LZW


def _widths(bits: int) -> np.ndarray:
    """Widths of the codes after a clear code, until the table is full. Each
    code but the first completes an entry; a width is that of the next one."""
    entry = (1 << bits) + 2 + np.maximum(np.arange(4096 - (1 << bits)) - 1, 0)
    return np.minimum(12, np.floor(np.log2(entry)).astype(np.int64) + 1)


_SCHEDULES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _schedule(bits: int) -> tuple[np.ndarray, np.ndarray]:
    if bits not in _SCHEDULES:
        w = _widths(bits)
        _SCHEDULES[bits] = w, np.r_[0, np.cumsum(w)]
    return _SCHEDULES[bits]


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """A code stream; the table is cleared when it is full."""
    clear, end = 1 << bits, (1 << bits) + 1
    width, _ = _schedule(bits)
    codes: list[int] = [clear << 8]  # codes stand eight bits up, so that a sample fits below
    starts = [0]
    known: dict[int, int] = {}
    get, put = known.get, codes.append
    if data:
        first, last = (end + 1) << 8, (4096 - 1) << 8
        fresh = first
        prefix = data[0] << 8
        for b in data[1:]:
            key = prefix | b
            code = get(key)
            if code is not None:
                prefix = code
                continue
            put(prefix)
            known[key] = fresh
            if fresh == last:
                put(clear << 8)
                starts.append(len(codes) - 1)
                known.clear()
                fresh = first
            else:
                fresh += 256
            prefix = b << 8
        put(prefix)
    put(end << 8)
    # widths: a clear code is written at the width in force before it; the codes after it follow the schedule
    out = np.array(codes, np.uint32) >> np.uint32(8)
    size = np.empty(len(out), np.int64)
    edges = [*starts, len(out)]
    for a, b in zip(edges, edges[1:], strict=False):
        run = width[: b - a]
        size[a + 1 : b] = run[: b - a - 1]
        if b < len(out):
            size[b] = run[b - a - 1]
    size[0] = bits + 1
    return _pack(out, size)


def _pack(codes: np.ndarray, size: np.ndarray) -> bytes:
    """Codes of up to 12 bits, least bit first: each touches at most three bytes."""
    at = np.r_[0, np.cumsum(size)]
    total = int((at[-1] + 7) // 8)
    byte, shift = at[:-1] >> 3, (at[:-1] & 7).astype(np.uint32)
    value = codes << shift
    out = np.zeros(total + 3, np.uint16)
    for k in range(3):  # codes do not overlap, so sums are unions
        out += np.bincount(byte + k, weights=(value >> np.uint32(8 * k)) & np.uint32(255), minlength=total + 3).astype(np.uint16)[: total + 3]
    return out[:total].astype(np.uint8).tobytes()


def lzw_decode(stream: bytes, bits: int, need: int) -> bytes:
    """At most ``need`` samples of a code stream."""
    clear, end = 1 << bits, (1 << bits) + 1
    width, offset = _schedule(bits)
    raw = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.uint32)
    total, pos = len(stream) * 8, 0
    out: list[np.ndarray] = []
    while pos + bits + 1 <= total and need > 0:
        # codes after a clear code (a stream may begin without one), up to the next clear or end code
        room = total - pos
        n = int(np.searchsorted(offset, room, side="right")) - 1
        n = min(n, len(width))
        at, size = pos + offset[:n], width[:n]
        if n == len(width):  # a full table: codes of 12 bits until a clear code comes
            more = (room - int(offset[n])) // 12
            at = np.r_[at, pos + offset[n] + 12 * np.arange(more)]
            size = np.r_[size, np.full(more, 12)]
        byte = at >> 3
        codes = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (at & 7).astype(np.uint32) & ((1 << size) - 1).astype(np.uint32)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else len(codes)
        if stop:
            out.append(_expand(codes[:stop].astype(np.int64), end, need))
            need -= len(out[-1])
        if stop == len(codes):
            break
        pos = int(at[stop] + size[stop])
        if codes[stop] == end:
            break
    return np.concatenate(out).tobytes() if out else b""


def _expand(codes: np.ndarray, end: int, need: int) -> np.ndarray:
    """What the codes between two clear codes stand for, at most ``need``
    samples. Entry k of the table is what code k wrote and the sample after it."""
    n = len(codes)
    plain, entry = codes < end, codes - (end + 1)
    if (~plain & (entry >= np.arange(n))).any():
        raise ValueError("a code stands for no entry")
    # a code's length is one more than that of the code its entry began with
    parent, steps = np.where(plain, np.arange(n), entry), (~plain).astype(np.int64)
    while True:
        more = steps[parent]
        if not more.any():
            break
        steps, parent = steps + more, parent[parent]
    length = steps + 1
    ends = np.cumsum(length)
    if ends[-1] > need:
        n = int(np.searchsorted(ends, need)) + 1
        codes, plain, entry, length, ends = codes[:n], plain[:n], entry[:n], length[:n], ends[:n]
    begin = ends - length
    # each sample is a copy of an earlier one, in the end of one that a plain code wrote
    source = np.arange(int(ends[-1])) - np.repeat(np.where(plain, 0, begin - begin[np.where(plain, 0, entry)]), length)
    while True:
        further = source[source]
        if np.array_equal(further, source):
            break
        source = further
    written = np.zeros(len(source), np.uint8)
    written[begin[plain]] = codes[plain]
    return written[source][:need]


# Containers


def _blocks(data: bytes) -> bytes:
    n = len(data)
    return b"".join(bytes([min(255, n - i)]) + data[i : i + 255] for i in range(0, n, 255)) + b"\0"


def encode_text(payload: bytes) -> bytes:
    """A greyscale film of the payload (a multiple of 64 bytes): each sample is
    a byte; frames have at most ROWS rows."""
    rows = len(payload) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, ROWS), 0xF7, 0, 0), GREY]
    for at in range(0, rows, ROWS):
        part = payload[at * WIDTH : (at + ROWS) * WIDTH]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", 2 << 2, DELAY, 0, 0))  # each frame clears its area
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0) + b"\x08" + _blocks(lzw_encode(part)))
    return b"".join([*out, b"\x3b"])


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(data):
            raise ValueError("cut short")
        n = data[at]
        if not n:
            return b"".join(parts), at + 1
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n


def images(data: bytes):
    """Image blocks as (left, top, width, height, samples, palette, control);
    control is (disposal, delay in 1/100 s, transparent number or None)."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("no GIF")
    flags = data[10]
    at, shared = 13, None
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        shared = np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3)
        at += n
    control = (0, 0, None)
    while True:
        if at >= len(data):
            raise ValueError("cut short")
        kind = data[at]
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at + 1] if at + 1 < len(data) else 0
            body, at = _sub_blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                control = (body[0] >> 2 & 7, body[1] | body[2] << 8, body[3] if body[0] & 1 else None)
        elif kind == 0x2C:
            if at + 10 > len(data):
                raise ValueError("cut short")
            left, top, w, h, own = struct.unpack("<HHHHB", data[at + 1 : at + 10])
            at += 10
            palette = shared
            if own & 0x80:
                n = 3 << ((own & 7) + 1)
                palette = np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3)
                at += n
            if at >= len(data):
                raise ValueError("cut short")
            if w * h > MAX_PIXELS:
                raise ValueError("too large")
            bits = data[at]
            if not 2 <= bits <= 8:
                raise ValueError("bad code size")
            stream, at = _sub_blocks(data, at + 1)
            flat = lzw_decode(stream, bits, w * h)
            if len(flat) < w * h:
                raise ValueError("too few samples")
            samples = np.frombuffer(flat, np.uint8).reshape(h, w)
            if own & 0x40:
                order = np.r_[np.arange(0, h, 8), np.arange(4, h, 8), np.arange(2, h, 4), np.arange(1, h, 2)]
                straight = np.empty_like(samples)
                straight[order] = samples
                samples = straight
            yield left, top, w, h, samples, palette, control
            control = (0, 0, None)
        else:
            raise ValueError("unknown block")


def decode(data: bytes):
    """The frames of a GIF, one at a time."""
    if len(data) < 13:
        raise ValueError("no GIF")
    width, height = struct.unpack("<HH", data[6:10])
    if width * height > MAX_PIXELS:
        raise ValueError("too large")
    canvas, now = np.zeros((height, width), "<u4"), 0  # RGBA, a byte each
    for left, top, w, h, samples, palette, (disposal, delay, clear) in images(data):
        if palette is None:
            raise ValueError("no palette")
        before = canvas.copy() if disposal == 3 else None
        right, bottom = min(width, left + w), min(height, top + h)
        seen = samples[: max(0, bottom - top), : max(0, right - left)]
        colours = palette.astype("<u4") @ np.array([1, 1 << 8, 1 << 16], "<u4") | np.uint32(0xFF000000)
        if len(colours) < 256:  # numbers beyond the palette are its last colour
            colours = np.r_[colours, np.repeat(colours[-1:], 256 - len(colours))]
        area = canvas[top:bottom, left:right]
        if clear is None:
            area[...] = colours[seen]
        else:
            np.copyto(area, colours[seen], where=seen != clear)
        yield Frame(canvas.copy().view(np.uint8).reshape(height, width, 4), now * 10, delay * 10, samples)
        now += delay
        if disposal == 2:
            canvas[top:bottom, left:right] = 0
        elif disposal == 3:
            canvas = before


def _visible(rgba: np.ndarray) -> np.ndarray:
    """The colours of visible pixels, red in the lowest byte."""
    flat = np.ascontiguousarray(rgba).reshape(-1).view("<u4")
    shown = flat >> np.uint32(24) > 0
    return flat if shown.all() else flat[shown]


def histogram(rgba: np.ndarray, levels: int = 4) -> list[int]:
    """Visible pixels by colour, ``levels`` steps a channel."""
    step = np.arange(256) * levels // 256
    seen = _visible(rgba)
    red, green, blue = (step[seen >> np.uint32(k) & np.uint32(255)] for k in (0, 8, 16))
    return np.bincount((red * levels + green) * levels + blue, minlength=levels**3).tolist()


def lumas(rgba: np.ndarray) -> np.ndarray:
    """How many visible pixels have each luma from 0 to 255."""
    seen = _visible(rgba)
    red, green, blue = (seen >> np.uint32(k) & np.uint32(255) for k in (0, 8, 16))
    return np.bincount((299 * red + 587 * green + 114 * blue + 500) // 1000, minlength=256)


FRAMES = "media_id long, frame int, start_ms long, duration_ms long, width int, height int, histogram array<long>, mean_luma double, error string"


def media_table(files: DataFrame, id_col: str = "media_id", data_col: str = "data") -> DataFrame:
    """A row per timed frame of every GIF of ``files`` (an id and the bytes);
    a broken file ends with a row that says what is wrong. ``mean_luma`` is of
    the visible pixels."""
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.float64(), pa.string()]

    def table_of(rows: list[tuple]):
        cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in FRAMES.split(", ")])

    def run(batches):
        for rb in batches:
            for media_id, data in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                rows = []
                try:
                    for k, f in enumerate(decode(data or b"")):
                        counts = lumas(f.rgba)
                        n = int(counts.sum())
                        rows.append((media_id, k, f.start_ms, f.duration_ms, f.rgba.shape[1], f.rgba.shape[0], histogram(f.rgba), float(counts @ np.arange(256)) / n if n else None, None))
                        if len(rows) >= 1024:  # a long film leaves in parts
                            yield table_of(rows)
                            rows = []
                except ValueError as e:
                    rows.append((media_id, None, None, None, None, None, None, None, str(e)))
                yield table_of(rows)

    return files.select(F.col(id_col).cast("long"), F.col(data_col)).mapInArrow(run, FRAMES)


#: A frame of a stored text: its number, when it begins and how long it stands, its rows, and its visible pixels by colour.
FRAME = "struct<frame:int,start_ms:long,duration_ms:long,rows:int,histogram:array<long>>"
COLUMNS = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames array<{FRAME}>"
_FRAME = pa.list_(pa.struct([("frame", pa.int32()), ("start_ms", pa.int64()), ("duration_ms", pa.int64()), ("rows", pa.int32()), ("histogram", pa.list_(pa.int64()))]))


def store(data: bytes) -> tuple:
    """A text's bytes as a film, and what reading the film back gives."""
    stored = encode_text(data + b"\0" * (-len(data) % WIDTH or (WIDTH if not data else 0)))
    sha, tail, size, counts, frames, until = hashlib.sha256(), b"", 0, np.zeros(256, np.int64), [], 0
    for k, f in enumerate(decode(stored)):
        back = f.samples.tobytes()
        sha.update(back)
        tail, size = back[-64:], size + len(back)
        counts += lumas(f.rgba)
        frames.append({"frame": k, "start_ms": f.start_ms, "duration_ms": f.duration_ms, "rows": len(f.samples), "histogram": histogram(f.rgba)})
        until = f.start_ms + f.duration_ms
    steps = ":".join(map(str, counts.reshape(8, 32).sum(axis=1).tolist()))  # by luma, eight steps
    mean = int((counts * np.arange(256)).sum() * 100 // max(1, counts.sum()))  # in hundredths
    return len(data), size, sha.hexdigest(), zlib.crc32(tail), len(stored), hashlib.sha256(stored).hexdigest(), f"frames={len(frames)};ms={until};luma={mean};hist={steps}", frames


def _store(batches):
    kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), _FRAME]
    names = [x.split()[0] for x in COLUMNS.split(", ")]
    for rb in batches:
        rows = [(doc_id, *store(data)) for doc_id, data in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True)]
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text as a GIF, read back: digests, sizes and features."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("b")).mapInArrow(_store, COLUMNS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_texts(table(spark, sf_dir, "documents"))
