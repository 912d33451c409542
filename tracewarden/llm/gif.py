"""GIF media columns: a numpy/pure-Python GIF89a codec (no imaging library).

``encode`` stores bytes losslessly as 8-bit palette indices, LZW-compressed, in one or more frames. ``decode`` reads
any GIF87a/89a: LZW code streams, global and local palettes, interlacing, transparency, disposal methods and delays;
it yields composed RGBA frames. ``gif_frames`` stores timed frames with colour-histogram columns.

Edge cases: null or empty media give no frames (``error`` says why); truncated or foreign bytes give the frames
before the damage and an ``error``; a frame without pixels keeps the canvas.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pick

WIDTH, FRAME_ROWS = 192, 4096  # payload images: rows of 192 samples, at most 4096 rows a frame
LIMIT = 4096  # LZW codes have at most 12 bits


# ---- LZW -------------------------------------------------------------------------------------------------------


def lzw_encode(samples: bytes, depth: int = 8) -> bytes:
    """Variable-width LZW with a clear code whenever the table is full."""
    clear, first = 1 << depth, (1 << depth) + 2
    codes: list[int] = []
    runs = [[clear], codes]
    emit = codes.append
    if samples:
        table: dict[int, int] = {}
        get, free, run = table.get, first, samples[0]
        for b in samples[1:]:
            key = run << 8 | b
            code = get(key)
            if code is not None:
                run = code
                continue
            emit(run)
            run = b
            table[key] = free
            free += 1
            if free == LIMIT:
                emit(clear)
                codes = []
                runs.append(codes)
                emit = codes.append
                table.clear()
                free = first
        emit(run)
    emit(clear + 1)
    return _pack(runs, depth)


_SCHEDULES: dict[int, np.ndarray] = {}


def _schedule(depth: int) -> np.ndarray:
    """Bits of the n-th code after a clear (12 from the full table on): every code but the first adds an entry."""
    if depth not in _SCHEDULES:
        size = (1 << depth) + np.arange(LIMIT + 2)
        width = np.full(len(size), depth + 1)
        for bits in range(depth + 1, 12):
            width[size + 1 >= 1 << bits] = bits + 1
        width[0] = depth + 1
        _SCHEDULES[depth] = width
    return _SCHEDULES[depth]


def _pack(codes: list[list[int]], depth: int) -> bytes:
    """Code runs, each ended by a clear or end code, as a bit stream."""
    table = _schedule(depth)
    width = np.concatenate([table[: len(run)] for run in codes])
    value = np.concatenate([np.array(run, np.int64) for run in codes])
    start = np.cumsum(width) - width
    value <<= start & 7
    byte = start >> 3
    end = (int(start[-1] + width[-1]) + 7) >> 3
    # 12 bits at any offset touch three bytes; the bits of different codes never overlap, so sums are unions.
    out = sum(np.bincount(byte + k, value >> 8 * k & 255, end + 3) for k in range(3))
    return out[:end].astype(np.uint8).tobytes()


def _places(depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit offsets and widths of the codes after a clear, up to some past the full table."""
    width = _schedule(depth)
    return np.cumsum(width) - width, width


def lzw_decode(stream: bytes, depth: int, want: int) -> bytes:
    """Samples of a code stream, at most ``want``; stops at the end code, at the end of data or at a bad code."""
    data = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    total, clear = len(stream) * 8, 1 << depth
    basic = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    table, prev = basic.copy(), b""
    bit = have = 0
    full = False  # the table is full and no clear code came: 12-bit codes go on
    while bit < total and have < want:
        # Codes up to the next clear: their widths depend on their number alone, so they are unpacked at once.
        starts, widths = _places(depth)
        if full:
            starts, widths = np.arange(LIMIT) * 12, np.full(LIMIT, 12)
        n = int(np.searchsorted(starts + widths, total - bit, "right"))
        if not n:
            break
        start, width = starts[:n] + bit, widths[:n]
        byte = start >> 3
        codes = (data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16) >> (start & 7) & ((1 << width) - 1)
        stop = np.flatnonzero((codes & ~1) == clear)
        last = int(stop[0]) if len(stop) else n
        part = codes[:last].tolist()
        bit = int(start[min(last, n - 1)] + width[min(last, n - 1)])
        before = len(out)
        grow, put = table.append, out.append
        try:
            if part and not prev:
                prev = table[part[0]]
                put(prev)
                part = part[1:]
            size = len(table)
            for code in part:
                if code < size:
                    now = table[code]
                    if size < LIMIT:
                        grow(prev + now[:1])
                        size += 1
                else:
                    if size >= LIMIT:
                        raise IndexError
                    now = prev + prev[:1]
                    grow(now)
                    size += 1
                put(now)
                prev = now
        except IndexError:
            break
        have += sum(map(len, out[before:]))
        full = not len(stop)
        if not full:
            if codes[last] != clear:
                break
            table, prev = basic.copy(), b""
    return b"".join(out)[:want]


# ---- container -------------------------------------------------------------------------------------------------


def _blocks(data: bytes) -> bytes:
    whole = len(data) // 255 * 255
    parts = [b"\xff" + data[i : i + 255] for i in range(0, whole, 255)]
    if whole < len(data):
        parts.append(bytes([len(data) - whole]) + data[whole:])
    return b"".join(parts) + b"\0"


GREY = bytes(v for i in range(256) for v in (i, i, i))


def encode(samples: bytes, width: int = WIDTH, frame_rows: int = FRAME_ROWS, delay: int = 10) -> bytes:
    """A GIF89a of grey samples; its length must be a positive multiple of ``width``."""
    rows, rest = divmod(len(samples), width)
    if rest or not rows:
        raise ValueError("samples must fill whole rows")
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, frame_rows), 0xF7, 0, 0), GREY]
    for top in range(0, rows, frame_rows):
        n = min(frame_rows, rows - top)
        out += [b"\x21\xf9\x04\x04" + struct.pack("<H", delay) + b"\0\0", b"\x2c" + struct.pack("<HHHHB", 0, 0, width, n, 0), b"\x08", _blocks(lzw_encode(samples[top * width : (top + n) * width]))]
    return b"".join(out) + b"\x3b"


@dataclass
class Frame:
    index: int
    start_ms: int
    delay_ms: int
    disposal: int
    box: tuple[int, int, int, int]  # left, top, width, height
    samples: np.ndarray  # palette indices in the box
    rgba: np.ndarray  # the composed canvas


class Damaged(ValueError):
    pass


MAX_PIXELS = 1 << 24  # of a screen or a frame; a header that asks for more is damaged, whatever the bytes after it


def decode(data: bytes) -> Iterator[Frame]:
    """Composed frames; raises Damaged where the bytes stop making sense."""
    try:
        yield from _decode(data)
    except (IndexError, struct.error) as error:
        raise Damaged("truncated") from error


def _sub(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def _decode(data: bytes) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise Damaged("no GIF signature")
    wide, high, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, shared = 13, None
    if flags & 0x80:
        size = 2 << (flags & 7)
        shared = np.frombuffer(data, np.uint8, 3 * size, at).reshape(-1, 3) if len(data) >= at + 3 * size else None
        if shared is None:
            raise Damaged("truncated palette")
        at += 3 * size
    if wide * high > MAX_PIXELS:
        raise Damaged("too many pixels")
    canvas = np.zeros((high, wide, 4), np.uint8)
    delay = disposal = index = clock = 0
    clear_index = -1
    while (kind := data[at]) != 0x3B:
        if kind == 0x21:
            label = data[at + 1]
            body, at = _sub(data, at + 2)
            if label == 0xF9:
                packed, delay, transparent = struct.unpack_from("<BHB", body)
                disposal, clear_index = packed >> 2 & 7, transparent if packed & 1 else -1
            continue
        if kind != 0x2C:
            raise Damaged("unknown block")
        left, top, w, h, local = struct.unpack_from("<HHHHB", data, at + 1)
        if w * h > MAX_PIXELS:
            raise Damaged("too many pixels")
        at, palette = at + 10, shared
        if local & 0x80:
            size = 2 << (local & 7)
            if len(data) < at + 3 * size:
                raise Damaged("truncated palette")
            palette = np.frombuffer(data, np.uint8, 3 * size, at).reshape(-1, 3)
            at += 3 * size
        depth = data[at]
        if not 1 < depth < 9 and depth != 1:
            raise Damaged("bad code size")
        stream, at = _sub(data, at + 1)
        raw = np.frombuffer(lzw_decode(stream, depth, w * h), np.uint8)
        if len(raw) < w * h:
            raise Damaged("truncated frame")
        samples = raw.reshape(h, w)
        if local & 0x40:
            order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            woven = np.empty_like(samples)
            woven[order] = samples
            samples = woven
        if palette is None:
            palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, 1)
        if len(palette) < 256:
            palette = np.concatenate([palette, np.zeros((256 - len(palette), 3), np.uint8)])
        before = canvas.copy() if disposal == 3 else None
        seen = samples[: max(0, high - top), : max(0, wide - left)]
        area = canvas[top : top + seen.shape[0], left : left + seen.shape[1]]
        opaque = np.full((256, 4), 255, np.uint8)
        opaque[:, :3] = palette
        colours = opaque.view(np.uint32)[:, 0][seen]
        if clear_index < 0:
            area.view(np.uint32)[..., 0] = colours
        else:
            np.copyto(area.view(np.uint32)[..., 0], colours, where=seen != clear_index)
        yield Frame(index, clock, delay * 10, disposal, (left, top, w, h), samples, canvas.copy())
        if disposal == 2:
            area[:] = 0
        elif disposal == 3:
            canvas = before
        index, clock = index + 1, clock + delay * 10
        delay = disposal = 0
        clear_index = -1


def histogram(rgba: np.ndarray, bins: int = 8) -> list[int]:
    """Counts of opaque pixels by ``bins`` levels of red, then green, then blue."""
    flat = rgba.reshape(-1, 4)
    if not flat[:, 3].all():
        flat = flat[flat[:, 3] > 0]
    scale = np.arange(256) * bins // 256
    return [int(x) for c in range(3) for x in np.bincount(scale, np.bincount(flat[:, c], minlength=256), bins)]


# ---- columns ---------------------------------------------------------------------------------------------------

FRAMES = T.StructType([T.StructField(n, t) for n, t in (
    ("frame", T.IntegerType()), ("start_ms", T.LongType()), ("delay_ms", T.LongType()), ("disposal", T.IntegerType()), ("width", T.IntegerType()), ("height", T.IntegerType()),
    ("rgba", T.BinaryType()), ("histogram", T.ArrayType(T.LongType())), ("error", T.StringType()),
)])


def gif_frames(media: DataFrame, id_col: str = "id", media_col: str = "media", pixels: bool = True) -> DataFrame:
    """One row (id, frame, start_ms, delay_ms, disposal, width, height, rgba, histogram, error) for each composed frame.

    Media without a readable frame, and those damaged after some frames, give a row whose ``error`` is set and whose other
    columns are null; so do screens and frames of more than ``MAX_PIXELS`` pixels.
    """
    base = pick(media, id=id_col, media=media_col)
    schema = T.StructType([base.schema["id"], *FRAMES.fields])

    def run(batches):
        for batch in batches:
            for key, blob in zip(batch.column("id"), batch.column("media")):
                raw = blob.as_py()
                try:
                    if not raw:
                        raise Damaged("empty")
                    for f in decode(raw):  # a frame at a time: a medium may have many
                        h, w = f.rgba.shape[:2]
                        yield row(key, [f.index, f.start_ms, f.delay_ms, f.disposal, w, h, f.rgba.tobytes() if pixels else None, histogram(f.rgba), None])
                except Damaged as damage:
                    yield row(key, [None] * 8 + [str(damage)])

    def row(key: pa.Scalar, values: list) -> pa.RecordBatch:
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([key.as_py()], key.type), *(pa.array([v], t) for v, t in zip(values, types))], names=["id", *FRAMES.names])

    return base.mapInArrow(run, schema)


def store_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): every whole text (null: empty) as a GIF, padded with spaces to whole rows, at least one."""
    base = pick(docs, id=id_col, text=text_col)
    schema = T.StructType([base.schema["id"], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches):
        for batch in batches:
            sizes, blobs, ids, held = [], [], [], 0
            for key, text in zip(batch.column("id"), batch.column("text")):
                raw = (text.as_py() or "").encode()
                blobs.append(encode(raw + b" " * (max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw))))
                sizes.append(len(raw))
                ids.append(key.as_py())
                held += len(blobs[-1])
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("id").type), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], names=["id", "n_bytes", "media"])
                    sizes, blobs, ids, held = [], [], [], 0
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("id").type), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], names=["id", "n_bytes", "media"])

    return base.mapInArrow(run, schema)
