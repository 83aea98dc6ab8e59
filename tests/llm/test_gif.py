import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from feedloom.llm.gif import (GREYS, BrokenGif, _as_blocks, decode, frame_columns, lzw_decode, lzw_encode, op6, padded, read_payload,
                              stored_texts, write)
from llm_help import make, prose  # noqa: F401


def slow_decode(data, size):
    """Code by code, as the format is described."""
    bits = int.from_bytes(data, "little")
    at, out = 0, b""
    clear = 1 << size
    table, width, last = [], size + 1, None
    while True:
        code = bits >> at & ((1 << width) - 1)
        at += width
        if code == clear:
            table, width, last = [bytes([k]) for k in range(clear)] + [b"", b""], size + 1, None
            continue
        if code == clear + 1:
            return out
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last is not None and len(table) < 4096:
            table.append(last + entry[:1])
            if len(table) == 1 << width and width < 12:
                width += 1
        last = entry


@pytest.mark.parametrize("size", [2, 5, 8])
def test_code_streams(size):
    r = random.Random(size)
    for n in (0, 1, 2, 300, 9000, 60000):
        for top in (1, 1 << size):
            data = bytes(r.randrange(top) for _ in range(n))
            stream = lzw_encode(data, size)
            assert lzw_decode(stream, size, n) == data
            if n <= 9000:
                assert slow_decode(stream, size) == data


def test_full_table_without_a_clear_code():
    """A writer may go on with a full table; codes then keep 12 bits."""
    r = random.Random(3)
    data = bytes(r.randrange(256) for _ in range(12000))
    codes, table, prefix = [256], {bytes([k]): k for k in range(256)}, b""
    free, bits, at = 258, 0, 0
    widths = []
    for k in data:
        if prefix + bytes([k]) in table:
            prefix += bytes([k])
            continue
        codes.append(table[prefix])
        if free < 4096:
            table[prefix + bytes([k])] = free
            free += 1
        prefix = bytes([k])
    codes += [table[prefix], 257]
    size, width = 258, 9
    for n, code in enumerate(codes):
        widths.append(width)
        bits |= code << at
        at += width
        if n >= 2 and size < 4096:
            size += 1
        width = max(9, min(12, size.bit_length())) if n else 9
    stream = bits.to_bytes(-(-at // 8), "little")
    assert slow_decode(stream, 8) == data and lzw_decode(stream, 8, len(data)) == data


def picture(frames, width=4, height=4, palette=None):
    palette = palette or bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    out = b"GIF89a" + struct.pack("<HHBBB", width, height, 0x81, 0, 0) + palette
    for left, top, w, h, samples, disposal, clear, delay, flags, local in frames:
        out += b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None)]) + struct.pack("<H", delay) + bytes([clear or 0, 0])
        out += b"\x21\xfe\x03abc\x00\x2c" + struct.pack("<HHHHB", left, top, w, h, flags) + local + b"\x02" + _as_blocks(lzw_encode(bytes(samples), 2))
    return out + b"\x3b"


def test_disposal_transparency_and_palettes():
    local = bytes([9, 9, 9, 8, 8, 8])
    frames = decode(picture([
        (0, 0, 4, 4, [1] * 16, 1, None, 5, 0, b""),
        (1, 1, 2, 2, [2, 0, 2, 2], 2, 0, 7, 0, b""),
        (0, 0, 2, 2, [3] * 4, 3, None, 0, 0, b""),
        (3, 3, 3, 3, [0, 1] * 4 + [0], 0, None, 1, 0x80, local),
    ]))
    red, green, blue = (255, 0, 0), (0, 255, 0), (0, 0, 255)
    at = lambda f, y, x: tuple(int(v) for v in frames[f].rgb[y, x])
    assert [(f.start_ms, f.duration_ms) for f in frames] == [(0, 50), (50, 70), (120, 0), (120, 10)]
    assert at(0, 1, 1) == red and at(1, 1, 1) == green and at(1, 1, 2) == red
    assert not frames[2].painted[2, 2] and at(2, 1, 1) == blue and at(2, 0, 0) == blue
    assert at(3, 0, 0) == red and not frames[3].painted[1, 1] and at(3, 3, 3) == (9, 9, 9)


def test_interlaced_rows():
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7, 9]
    stored = [k % 4 for k in order for _ in range(4)]
    frame = decode(picture([(0, 0, 4, 10, stored, 0, None, 0, 0x40, b"")], 4, 10, bytes(12 * [0]) and bytes(x for k in range(4) for x in (k, k, k))))[0]
    assert frame.rgb[:, 0, 0].tolist() == [k % 4 for k in range(10)]


def test_payloads_round_trip():
    r = random.Random(1)
    for text in [None, "", "a", "x" * 64, "é" * 31 + "ab", prose(1, 9000), "".join(chr(r.randrange(32, 0x2FF)) for _ in range(20000))]:
        n, payload = padded(text)
        assert n == len((text or "").encode()) and len(payload) % 64 == 0 and payload.rstrip(b"\0") == (text or "").encode().rstrip(b"\0")
        assert read_payload(write(payload))[0] == payload
    tall = bytes(64 * 65535) + bytes(range(64))
    back, frames = read_payload(write(tall))
    assert back == tall and len(frames) == 2


def test_broken_files_are_told(spark):
    good = picture([(0, 0, 4, 4, [1] * 16, 1, None, 5, 0, b"")])
    for data in (b"", b"GIF89a", b"PNG" * 9, good[:30]):
        with pytest.raises((BrokenGif, IndexError, struct.error, ValueError)):
            if not decode(data):
                raise BrokenGif("no frame")
    rows = [(1, good), (2, None), (3, b"nothing at all here"), (1, good), (None, good[:-3])]
    out = frame_columns(spark.createDataFrame(rows, "k long, media binary"), "k").collect()
    by = {r.k: r for r in out}
    assert len(out) == 5 and by[1].frames[0].histogram[:8] == [0, 0, 0, 0, 0, 0, 0, 16] and by[1].error is None
    assert by[2].frames == [] and by[2].error is None and by[3].error
    assert frame_columns(spark.createDataFrame([], "k long, media binary"), "k").count() == 0


def test_query(spark, small, make):
    found = {r.doc_id: r for r in op6(spark, small).collect()}
    for d in spark.read.parquet(f"{small}/documents.parquet").collect():
        r, data = found[d.doc_id], (d.text or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(data), len(payload), zlib.crc32(payload[-64:]))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
    media = {r.doc_id: r for r in stored_texts(make([(1, None), (2, ""), (3, "q")])).collect()}
    assert media[1].media == media[2].media and media[1].n_bytes == 0
    assert hashlib.sha256(media[3].media).hexdigest() and np.frombuffer(media[3].media, np.uint8)[13:16].tolist() == list(GREYS[:3])
