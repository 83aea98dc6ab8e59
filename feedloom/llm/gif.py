"""GIF media columns: writing payloads losslessly, decoding to timed frames, features of what was read.

The decoder reads LZW code streams, local and global palettes, interlacing, transparency, delays and disposal, and
composes each frame on the canvas. The frames of a file become a column of structs with their times and colour histograms.
A payload of bytes is written as 8-bit samples, one frame of at most 65535 rows of 64 samples after the other, with a
palette in which sample k is the grey k.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from feedloom.llm.storage import quoted

WIDTH = 64
MOST_ROWS = 65535
HISTOGRAM = 8
GREYS = bytes(x for k in range(256) for x in (k, k, k))
FULL = 4096


class BrokenGif(ValueError):
    """The bytes are not a GIF, or end too early."""


@dataclass
class Frame:
    """A composed frame: RGB canvas, which pixels were ever painted, start and length in milliseconds."""

    rgb: np.ndarray
    painted: np.ndarray
    start_ms: int
    duration_ms: int
    samples: np.ndarray = field(repr=False)


# --- LZW -------------------------------------------------------------------------------------------------------------

def _widths(size: int, codes: int) -> np.ndarray:
    """Bits of the first `codes` codes after a clear code: the table grows by one entry with each but the first."""
    filled = (1 << size) + 2 + np.maximum(np.arange(codes) - 1, 0)
    return np.clip(np.floor(np.log2(filled)).astype(np.int64) + 1, size + 1, 12)


_CODE_WIDTHS: dict[int, np.ndarray] = {}


def _code_widths(size: int) -> np.ndarray:
    if size not in _CODE_WIDTHS:
        _CODE_WIDTHS[size] = _widths(size, FULL)
    return _CODE_WIDTHS[size]


def lzw_encode(samples: bytes, size: int = 8) -> bytes:
    """The code stream of samples below 2 ** size; begins with a clear code, and clears when the table is full."""
    clear, end = 1 << size, (1 << size) + 1
    parts: list[list[int]] = []
    codes: list[int] = []
    table: dict[int, int] = {}
    free = end + 1
    put, get = codes.append, table.get
    it = iter(samples)
    prefix = next(it, None)
    if prefix is not None:
        for sample in it:
            key = prefix << 8 | sample
            code = get(key)
            if code is not None:
                prefix = code
                continue
            put(prefix)
            prefix = sample
            if free < FULL:
                table[key] = free
                free += 1
            else:
                parts.append(codes)
                codes = []
                put = codes.append
                table.clear()
                free = end + 1
        put(prefix)
    parts.append(codes)
    values, bits = [], []
    schedule = _code_widths(size)
    before = size + 1
    for part in parts:
        own = schedule[: len(part)] if len(part) <= len(schedule) else np.r_[schedule, np.full(len(part) - len(schedule), 12)]
        values.append(np.r_[clear, np.array(part, np.int64)])
        bits.append(np.r_[before, own])
        following = int(schedule[len(part)]) if len(part) < len(schedule) else 12
        before = following
    values.append(np.array([end], np.int64))
    bits.append(np.array([before]))
    return _pack_bits(np.concatenate(values), np.concatenate(bits))


def _pack_bits(values: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes of up to 12 bits, lowest bit first."""
    bits = np.unpackbits(values.astype("<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(bits[np.arange(16) < widths[:, None]], bitorder="little").tobytes()


def lzw_decode(data: bytes, size: int, most: int) -> bytes:
    """At most `most` samples of a code stream; a stream that just ends gives what it held."""
    clear, end = 1 << size, (1 << size) + 1
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    total = 8 * len(data)
    at, out, made = 0, [], 0
    roots = [bytes([k]) for k in range(clear)] + [b"", b""]
    schedule = _code_widths(size)
    while made < most:
        # the codes up to the next clear code have known widths, so they are read all at once
        ends = at + np.cumsum(schedule)
        start = ends - schedule
        ok = int(np.searchsorted(ends, total, "right"))
        if not ok:
            break
        start, width = start[:ok], schedule[:ok]
        place = start >> 3
        codes = (raw[place] | raw[place + 1] << 8 | raw[place + 2] << 16) >> (start & 7) & ((1 << width) - 1)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else ok
        table = roots.copy()
        add, put = table.append, out.append
        run = codes[:stop].tolist()
        growing = FULL - len(roots) + 1  # the first code adds nothing, and a full table stays as it is
        last = None
        for code in run[:growing]:
            try:
                entry = table[code]
            except IndexError:
                if code != len(table) or last is None:
                    raise BrokenGif("a code before its table entry") from None
                entry = last + last[:1]  # the entry that this very code completes
                add(entry)
            else:
                if last is not None:
                    add(last + entry[:1])
            put(entry)
            last = entry
        out.extend([table[code] for code in run[growing:]])
        made += sum(map(len, out[len(out) - len(run):])) if run else 0
        if stop == ok:
            if ok < len(schedule):
                break
            # a full table that is used on: codes of 12 bits until a clear code
            at = int(ends[ok - 1])
            while at + 12 <= total and made < most:
                code = int(raw[at >> 3] | raw[(at >> 3) + 1] << 8 | raw[(at >> 3) + 2] << 16) >> (at & 7) & 0xFFF
                at += 12
                if code in (clear, end):
                    break
                if code >= len(table):
                    raise BrokenGif("a code before its table entry")
                out.append(table[code])
                made += len(table[code])
            else:
                break
            if code == end:
                break
            continue
        if codes[stop] == end:
            break
        at = int(ends[stop])
    return b"".join(out)[:most]


# --- files -----------------------------------------------------------------------------------------------------------

def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    """Sub-blocks from `at` joined, and the place after their end."""
    parts = []
    while True:
        if at >= len(data):
            raise BrokenGif("sub-blocks without an end")
        n = data[at]
        if not n:
            return b"".join(parts), at + 1
        parts.append(data[at + 1:at + 1 + n])
        at += 1 + n


def _as_blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[k:k + 255])]) + data[k:k + 255] for k in range(0, len(data), 255)) + b"\0"


def _deinterlaced(height: int) -> np.ndarray:
    """Row of the picture that each stored row belongs to."""
    rows = [range(0, height, 8), range(4, height, 8), range(2, height, 4), range(1, height, 2)]
    return np.concatenate([np.array(r, np.int64) for r in rows])


def decode(data: bytes) -> list[Frame]:
    """The composed frames of a GIF.

    A frame is shown until its delay is over; then disposal 2 clears its area to transparent, 3 restores what was there
    before, others leave it. Samples of the transparent index and outside the canvas are not painted. Frames without a
    palette, and bytes that are no GIF, raise BrokenGif; missing samples of a frame are not painted.
    """
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise BrokenGif("no GIF header")
    width, height, flags = struct.unpack("<HHB", data[6:11])
    at, common = 13, None
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        common, at = np.frombuffer(data[at:at + n], np.uint8).reshape(-1, 3), at + n
    canvas = np.zeros((height, width, 3), np.uint8)
    painted = np.zeros((height, width), bool)
    frames: list[Frame] = []
    clock, delay, clear_index, disposal = 0, 0, None, 0
    while at < len(data) and data[at] != 0x3B:
        kind = data[at]
        if kind == 0x21:
            label = data[at + 1]
            body, at = _blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                delay = struct.unpack("<H", body[1:3])[0]
                disposal = body[0] >> 2 & 7
                clear_index = body[3] if body[0] & 1 else None
            continue
        if kind != 0x2C:
            raise BrokenGif(f"unknown block {kind}")
        left, top, w, h, local = struct.unpack("<HHHHB", data[at + 1:at + 10])
        at += 10
        colours = common
        if local & 0x80:
            n = 3 << ((local & 7) + 1)
            colours, at = np.frombuffer(data[at:at + n], np.uint8).reshape(-1, 3), at + n
        if colours is None:
            raise BrokenGif("a frame without a palette")
        size = data[at]
        if not 1 <= size <= 8:
            raise BrokenGif(f"code size {size}")
        stream, at = _blocks(data, at + 1)
        samples = np.frombuffer(lzw_decode(stream, max(size, 2), w * h), np.uint8)
        known = np.zeros(w * h, bool)
        known[: len(samples)] = True
        index = np.zeros(w * h, np.uint8)
        index[: len(samples)] = samples
        index, known = index.reshape(h, w), known.reshape(h, w)
        if local & 0x40:
            order = _deinterlaced(h)
            whole, seen = np.empty_like(index), np.empty_like(known)
            whole[order], seen[order] = index, known
            index, known = whole, seen
        if clear_index is not None:
            known = known & (index != clear_index)
        known = known & (index < len(colours))
        before = (canvas.copy(), painted.copy()) if disposal == 3 else None
        rows, columns = slice(top, min(top + h, height)), slice(left, min(left + w, width))
        n, m = max(0, rows.stop - top), max(0, columns.stop - left)
        if n and m:
            paint = known[:n, :m]
            if paint.all():
                canvas[rows, columns] = colours[index[:n, :m]]
                painted[rows, columns] = True
            else:
                canvas[rows, columns][paint] = colours[np.minimum(index[:n, :m], len(colours) - 1)][paint]
                painted[rows, columns] |= paint
        frames.append(Frame(canvas.copy(), painted.copy(), clock, delay * 10, samples))
        clock += delay * 10
        if disposal == 2:
            canvas[rows, columns], painted[rows, columns] = 0, False
        elif before is not None:
            canvas, painted = before
        delay, clear_index, disposal = 0, None, 0
    return frames


def write(payload: bytes, width: int = WIDTH, delay: int = 10) -> bytes:
    """A GIF whose frames hold the payload, a positive multiple of `width` bytes, as samples."""
    rows = len(payload) // width
    if not rows or rows * width != len(payload):
        raise ValueError("the payload must be a positive multiple of the width")
    tall = min(rows, MOST_ROWS)
    out = [b"GIF89a", struct.pack("<HHBBB", width, tall, 0xF7, 0, 0), GREYS]
    for low in range(0, rows, MOST_ROWS):
        n = min(MOST_ROWS, rows - low)
        stream = lzw_encode(payload[low * width:(low + n) * width])
        out += [b"\x21\xf9\x04\x04" + struct.pack("<H", delay) + b"\0\0", b"\x2c" + struct.pack("<HHHHB", 0, 0, width, n, 0),
                b"\x08", _as_blocks(stream)]
    return b"".join(out) + b"\x3b"


def padded(text: str | None, unit: int = WIDTH) -> tuple[int, bytes]:
    """Number of bytes of a text, and the bytes with zeros up to a positive multiple of `unit`."""
    data = (text or "").encode()
    return len(data), data + bytes((-len(data)) % unit or (0 if data else unit))


def histogram(frame: Frame, bins: int = HISTOGRAM) -> list[int]:
    """Painted pixels per channel and bin, red first."""
    return [n for channel in range(3) for n in channel_histogram(frame, channel, bins)]


def channel_histogram(frame: Frame, channel: int, bins: int = HISTOGRAM) -> list[int]:
    values = frame.rgb[..., channel]
    values = values.ravel() if frame.painted.all() else values[frame.painted]
    return np.bincount(values, minlength=256).reshape(bins, -1).sum(axis=1).tolist()


def read_payload(media: bytes) -> tuple[bytes, list[Frame]]:
    """The samples of all frames, one after the other, as they were stored."""
    frames = decode(media)
    return b"".join(f.samples.tobytes() for f in frames), frames


FRAME = "struct<start_ms:long,duration_ms:long,width:int,height:int,painted:long,histogram:array<long>>"


def frame_columns(media: DataFrame, key: str, column: str = "media") -> DataFrame:
    """(key, frames, error): per row the timed frames of a GIF with their histograms.

    A null is no GIF: no frames and a null error; bytes that cannot be read give no frames and the reason. Repeated
    rows are read one by one; an empty table gives no rows.
    """
    schema = media.select(quoted(key)).schema.add("frames", StructType.fromDDL(f"f array<{FRAME}>").fields[0].dataType).add("error", "string")
    frame_type = pa.struct([("start_ms", pa.int64()), ("duration_ms", pa.int64()), ("width", pa.int32()), ("height", pa.int32()),
                            ("painted", pa.int64()), ("histogram", pa.list_(pa.int64()))])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data, found, error = batch.column(1)[row].as_py(), [], None
                if data is not None:
                    try:
                        found = [{"start_ms": f.start_ms, "duration_ms": f.duration_ms, "width": f.rgb.shape[1], "height": f.rgb.shape[0],
                                  "painted": int(f.painted.sum()), "histogram": histogram(f)} for f in decode(data)]
                    except (BrokenGif, struct.error, IndexError, ValueError) as problem:
                        error = str(problem)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, 1), pa.array([found], pa.list_(frame_type)), pa.array([error], pa.string())],
                    [key, "frames", "error"])

    return media.select(quoted(key), quoted(column)).mapInArrow(compute, schema)


def feature(frames: list[Frame]) -> str:
    """Frames, milliseconds, size, and the grey histogram, as text."""
    greys = np.sum([channel_histogram(f, 0) for f in frames], axis=0)
    return f"{len(frames)}f {sum(f.duration_ms for f in frames)}ms {frames[0].rgb.shape[1]}x{frames[0].rgb.shape[0]} " + "/".join(map(str, greys))


SUMMARY = ("n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
           "feature string")


def stored_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): each text, padded, as a GIF; a null text is empty."""
    schema = docs.select(quoted(key)).schema.add("n_bytes", "long").add("media", "binary")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                made = [padded(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([write(p) for _, p in made], pa.binary())],
                    [key, "n_bytes", "media"])

    return docs.select(quoted(key), quoted(text).cast("string")).mapInArrow(compute, schema)


def payload_summary(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """What is read back from stored texts: digests of payload and file, and a feature of the frames."""
    names = [c.split()[0] for c in SUMMARY.split(", ")]
    types = [pa.string() if c.endswith("string") else pa.int64() for c in SUMMARY.split(", ")]
    schema = media.select(quoted(key)).schema
    for name, kind in (c.split() for c in SUMMARY.split(", ")):
        schema = schema.add(name, kind)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                rows = []
                for n, data in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    payload, frames = read_payload(data)
                    rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data),
                                 hashlib.sha256(data).hexdigest(), feature(frames)))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], [key, *names])

    return media.select(quoted(key), "n_bytes", "media").mapInArrow(compute, schema)


def op6(spark, folder: str) -> DataFrame:
    return payload_summary(stored_texts(spark.read.parquet(f"{folder}/documents.parquet")))
