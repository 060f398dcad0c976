"""Motion-JPEG in AVI: writing byte payloads as intra frames, reading them back, cutting shots.

A sample is one 8x8 block of constant grey, so the baseline DC coefficient (quantiser 8) is the
sample itself and nothing is lost.  64 samples make a block row, which is also the restart
interval: rows are independent, and all rows of a batch are coded and decoded in step with
vector operations.  ROWS block rows make a frame.
"""
from __future__ import annotations

import hashlib
import re
import struct
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfold.llm.common import row_chunks, texts_of

ACROSS, ROWS, BINS = 64, 8, 16
FRAME_US = 100_000
CHUNK = 400_000
# Code lengths and symbols of the DC table for luminance in annex K of the JPEG standard.
DC_COUNTS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0])
DC_SYMBOLS = bytes(range(12))
AC_COUNTS = bytes([1] + [0] * 15)  # a single code: end of block
AC_SYMBOLS = b"\x00"


def _codes(counts: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    """Canonical codes: symbol -> (code, length)."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[at]] = (code, length)
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _encoder() -> tuple[np.ndarray, np.ndarray]:
    """Bits and bit length of a whole block for each difference -255..255."""
    dc, (end, end_len) = _codes(DC_COUNTS, DC_SYMBOLS), _codes(AC_COUNTS, AC_SYMBOLS)[0]
    bits, length = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = dc[size]
        extra = d if d >= 0 else d + (1 << size) - 1
        bits[d + 255], length[d + 255] = ((code << size | extra) << end_len) | end, n + size + end_len
    return bits, length


BITS, LENGTHS = _encoder()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def frame_header() -> bytes:
    return b"".join([b"\xff\xd8", _segment(0xDB, b"\x00" + bytes([8] * 64)),
                     _segment(0xC0, struct.pack(">BHHBBBB", 8, ROWS * 8, ACROSS * 8, 1, 1, 0x11, 0)),
                     _segment(0xC4, b"\x00" + DC_COUNTS + DC_SYMBOLS), _segment(0xC4, b"\x10" + AC_COUNTS + AC_SYMBOLS),
                     _segment(0xDD, struct.pack(">H", ACROSS)), _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")])


HEADER = frame_header()


def code_rows(samples: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Entropy-coded data of block rows (n x 64 bytes), each followed by its marker, and where each ends.

    The marker is the row's restart marker, or the end of the image after a frame's last row.
    """
    n = len(samples)
    step = samples.astype(np.int32)
    step[:, 1:] -= samples[:, :-1]
    step[:, 0] -= 128
    step += 255
    word, length = BITS[step], LENGTHS[step]
    word = (word[:, 0::2] << length[:, 1::2]) | word[:, 1::2]  # two blocks are at most 30 bits
    length = length[:, 0::2] + length[:, 1::2]
    stop = np.cumsum(length, axis=1)
    total = stop[:, -1]
    size = (total + 7) >> 3
    base = np.cumsum(size) - size
    place = (stop - length) + (base << 3)[:, None]
    at = (place >> 5).ravel()
    word = (word << (64 - (place & 31) - length)).ravel().view(np.uint64)
    cells = int(base[-1] + size[-1]) // 4 + 3
    body = np.bincount(at, word >> np.uint64(32), cells) + np.bincount(at + 1, word & np.uint64(0xFFFFFFFF), cells)
    body = body.astype(">u4").view(np.uint8)[:base[-1] + size[-1]]
    body[base + size - 1] |= ((1 << (size * 8 - total)) - 1).astype(np.uint8)
    full = np.flatnonzero(body == 255)
    ends = base + size
    more = np.searchsorted(full, ends)  # stuffed zeros up to each row's end
    body = np.insert(body, np.concatenate([full + 1, np.repeat(ends, 2)]), np.uint8(0)) if len(full) else np.insert(body, np.repeat(ends, 2), np.uint8(0))
    out = body
    ends = ends + more + 2 * np.arange(1, n + 1)
    k = np.arange(n) % ROWS
    out[ends - 2] = 255
    out[ends - 1] = np.where(k == ROWS - 1, 0xD9, 0xD0 + k)
    return out.tobytes(), ends


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) & 1)


def wrap(frames: list[bytes], payload: int) -> bytes:
    """An AVI file of these frames; the payload's length is a comment in its INFO list."""
    most = max(map(len, frames))
    wide, high = ACROSS * 8, ROWS * 8
    head = struct.pack("<14I", FRAME_US, 0, 0, 0x10, len(frames), 0, 1, most, wide, high, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, FRAME_US, 1_000_000, 0, len(frames), most, 10_000, 0, 0, 0, wide, high)
    form = struct.pack("<IiiHH4sIiiII", 40, wide, high, 1, 24, b"MJPG", wide * high * 3, 0, 0, 0, 0)
    movie, index, at = [], [], 4
    for f in frames:
        movie.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(movie[-1])
    body = b"".join([b"AVI ", _chunk(b"LIST", b"hdrl" + _chunk(b"avih", head) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form))),
                     _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"payload %d" % payload)), _chunk(b"LIST", b"movi" + b"".join(movie)), _chunk(b"idx1", b"".join(index))])
    return b"RIFF" + struct.pack("<I", len(body)) + body


def write_videos(payloads: list[bytes]) -> list[bytes]:
    """One AVI file per payload; a payload is a positive multiple of 64 bytes."""
    frames = [-(-len(p) // (ACROSS * ROWS)) for p in payloads]
    raw = b"".join(p.ljust(n * ACROSS * ROWS, b"\x00") for p, n in zip(payloads, frames))
    data, ends = code_rows(np.frombuffer(raw, np.uint8).reshape(-1, ACROSS))
    ends = ends[ROWS - 1::ROWS].tolist()
    out, k, start = [], 0, 0
    for p, n in zip(payloads, frames):
        own = []
        for stop in ends[k:k + n]:
            own.append(HEADER + data[start:stop])
            start = stop
        k += n
        out.append(wrap(own, len(p)))
    return out


def _chunks(data: bytes, start: int, stop: int):
    """(name, first byte, past the last byte) of the RIFF chunks in a range."""
    while start + 8 <= stop:
        name, size = data[start:start + 4], struct.unpack_from("<I", data, start + 4)[0]
        if start + 8 + size > stop:
            raise ValueError("a chunk runs past its parent")
        yield name, start + 8, start + 8 + size
        start += 8 + size + (size & 1)


def parse_index(data: bytes) -> tuple[list[tuple[int, int]], int, int]:
    """Frames of an AVI file as byte ranges by its index, microseconds a frame, payload length (-1: not told)."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    frames, step, payload, movie, index = [], 0, -1, None, None
    for name, a, b in _chunks(data, 12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0])):
        kind = data[a:a + 4] if name == b"LIST" else b""
        if kind == b"hdrl":
            step = next(struct.unpack_from("<I", data, x)[0] for n, x, _ in _chunks(data, a + 4, b) if n == b"avih")
        elif kind == b"INFO":
            for n, x, y in _chunks(data, a + 4, b):
                if n == b"ICMT" and data[x:x + 8] == b"payload ":
                    payload = int(data[x + 8:y])
        elif kind == b"movi":
            movie = a
        elif name == b"idx1":
            index = (a, b)
    if movie is None or index is None:
        raise ValueError("no frames or no index")
    for at in range(index[0], index[1] - 15, 16):
        name, _, offset, size = struct.unpack_from("<4sIII", data, at)
        if name[2:] == b"dc":
            frames.append((movie + offset + 8, movie + offset + 8 + size))
    return frames, step, payload


class Frame(NamedTuple):
    first: int  # where the coded data begins
    dc: bytes
    ac: bytes
    shape: tuple[int, int]  # blocks across, block rows
    restart: int
    scale: np.ndarray  # quantiser, in zigzag order

    def plain(self) -> bool:
        """Constant blocks in rows of their own: all rows of a batch can be decoded in step."""
        return self.shape == (ACROSS, ROWS) and self.restart == ACROSS and self.scale[0] == 8 and self.ac == AC_COUNTS + AC_SYMBOLS


def parse_frame(data: bytes, start: int) -> Frame:
    """Tables and geometry of a baseline JPEG frame of one component."""
    at, shape, restart, quantisers, tables = start + 2, None, 0, {}, {}
    if data[start:at] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    while True:
        _, marker, size = struct.unpack_from(">BBH", data, at)
        body = data[at + 4:at + 2 + size]
        at += 2 + size
        if marker == 0xC0:
            depth, high, wide, parts, _, _, quantiser = struct.unpack_from(">BHHBBBB", body)
            if depth != 8 or parts != 1:
                raise ValueError("only 8-bit frames of one component can be read")
            shape = -(-wide // 8), -(-high // 8)
        elif 0xC1 <= marker <= 0xCF and marker != 0xC4:
            raise ValueError("not a baseline frame")
        elif marker == 0xC4:
            while body:
                end = 17 + sum(body[1:17])
                tables[body[0]], body = body[1:end], body[end:]
        elif marker == 0xDB:
            while body:
                wide = 64 << (body[0] >> 4)
                quantisers[body[0] & 15] = np.frombuffer(body[1:1 + wide], ">u2" if body[0] >> 4 else np.uint8).astype(np.int64)
                body = body[1 + wide:]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            return Frame(at, tables[body[2] >> 4], tables[0x10 | body[2] & 15], shape, restart, quantisers[quantiser])


ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
COSINES = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (0.5 if u else np.sqrt(0.125)) for x in range(8)] for u in range(8)])


def _coefficients(data: bytes, frame: Frame) -> np.ndarray:
    """Quantised coefficients (blocks x 64, zigzag order) of a frame's coded data."""
    dc, ac = ({(n, code): symbol for symbol, (code, n) in _codes(t[:16], t[16:]).items()} for t in (frame.dc, frame.ac))
    blocks = frame.shape[0] * frame.shape[1]
    out = np.zeros((blocks, 64), np.int64)
    step = frame.restart or blocks
    runs = re.split(rb"\xff[\xd0-\xd9]", data)
    for start in range(0, blocks, step):
        run = runs[start // step].replace(b"\xff\x00", b"\xff")
        place, level = 0, 0

        def take(n):
            nonlocal place
            if place + n > 8 * len(run):
                raise ValueError("the coded data ends early")
            word = int.from_bytes(run[place >> 3:(place >> 3) + 4].ljust(4, b"\x00"), "big")
            word = word >> (32 - n - (place & 7)) & ((1 << n) - 1)
            place += n
            return word

        def symbol(table):
            code = 0
            for n in range(1, 17):
                code = code << 1 | take(1)
                if (n, code) in table:
                    return table[n, code]
            raise ValueError("no such code")

        def value(size):
            bits = take(size)
            return bits if not size or bits >> (size - 1) else bits - (1 << size) + 1
        for block in range(start, min(start + step, blocks)):
            level += value(symbol(dc))
            out[block, 0] = level
            k = 1
            while k < 64:
                at = symbol(ac)
                if at == 0:
                    break
                k += at >> 4
                if at & 15:
                    out[block, k] = value(at & 15)
                k += 1
    return out


def decode_frame(data: bytes, frame: Frame) -> np.ndarray:
    """Samples of any baseline frame: entropy decoding, quantiser, inverse transform; a block's sample is its mean grey."""
    spectrum = np.zeros((frame.shape[0] * frame.shape[1], 64))
    spectrum[:, ZIGZAG] = _coefficients(data, frame) * frame.scale
    pixels = np.clip(np.rint(COSINES.T @ spectrum.reshape(-1, 8, 8) @ COSINES + 128), 0, 255)
    return np.rint(pixels.mean(axis=(1, 2))).astype(np.uint8)


_TABLES: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}


def _decoder(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Difference and bit length of the block that starts each 16-bit window."""
    if table not in _TABLES:
        value, length = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64)
        for size, (code, n) in _codes(table[:16], table[16:]).items():
            if n + size + 1 > 16:
                continue  # cannot occur with 8-bit samples
            span = 1 << (16 - n - size - 1)
            for extra in range(1 << size):
                d = extra if not size or extra >> (size - 1) else extra - (1 << size) + 1
                at = ((code << size | extra) << 1) * span
                value[at:at + span], length[at:at + span] = d, n + size + 1
        _TABLES[table] = value, length
    return _TABLES[table]


def decode_rows(data: np.ndarray, table: bytes) -> np.ndarray:
    """Samples of block rows from coded data in which every row ends in a marker."""
    mark = np.flatnonzero((data[:-1] == 255) & (data[1:] >= 0xD0) & (data[1:] <= 0xD9))
    keep = np.ones(len(data), bool)
    keep[mark] = keep[mark + 1] = False
    keep[1:][(data[:-1] == 255) & (data[1:] == 0)] = False
    kept = np.cumsum(keep)
    starts = np.concatenate([[0], kept[mark[:-1] + 1]]) if len(mark) else np.zeros(0, np.int64)
    body = np.concatenate([data[keep], np.zeros(4, np.uint8)]).astype(np.int32)
    window = (body[:-3] << 16) | (body[1:-2] << 8) | body[2:-1]  # 24 bits from each byte on
    value, length = _decoder(table)
    place = starts.astype(np.int64) << 3
    level = np.zeros(len(place), np.int32)
    out = np.empty((ACROSS, len(place)), np.uint8)
    for c in range(ACROSS):
        code = (window[np.minimum(place >> 3, len(window) - 1)] >> (8 - (place & 7)).astype(np.int32)) & 0xFFFF
        level += value[code]
        place += length[code]
        out[c] = level + 128
    return out.T


def read_videos(files: list[bytes]) -> list[tuple[np.ndarray, int, np.ndarray] | None]:
    """Samples of the payload, microseconds a frame, and histogram per frame (frames x BINS); None for what cannot be read."""
    parts, told, table, other = [], [], None, {}  # other: frames that need the whole decoder, by their place
    usual = Frame(len(HEADER), DC_COUNTS + DC_SYMBOLS, AC_COUNTS + AC_SYMBOLS, (ACROSS, ROWS), ACROSS, np.full(64, 8))
    total = 0
    for data in files:
        try:
            frames, step, payload = parse_index(data)
            spans, apart, common = [], {}, table
            for i, (a, b) in enumerate(frames):
                own = data.startswith(HEADER, a)
                frame = usual if own else parse_frame(data, a)
                body = data[a + len(HEADER) if own else frame.first:b]
                if frame.shape != (ACROSS, ROWS):
                    raise ValueError("another geometry")
                if frame.plain() and (common or frame.dc) == frame.dc:
                    common = frame.dc
                    spans.append(body)
                else:
                    apart[total + i] = decode_frame(body, frame)
            table = common
            parts += spans
            other |= apart
            total += len(frames)
            told.append((len(frames), step, payload))
        except (ValueError, struct.error, StopIteration, TypeError, IndexError, KeyError):
            told.append(None)
    rows = decode_rows(np.frombuffer(b"".join(parts), np.uint8), table) if parts else np.zeros((0, ACROSS), np.uint8)
    each = np.ascontiguousarray(rows).reshape(-1, ROWS * ACROSS)
    if other:
        plain = np.setdiff1d(np.arange(total), list(other))
        whole = np.zeros((total, ROWS * ACROSS), np.uint8)
        whole[plain] = each
        whole[list(other)] = list(other.values())
        each = whole
    bins = (each >> 4).astype(np.int64) + (np.arange(len(each)) * BINS)[:, None]
    histograms = np.bincount(bins.ravel(), minlength=len(each) * BINS).reshape(-1, BINS)
    out, at = [], 0
    for x in told:
        if x is None:
            out.append(None)
            continue
        n, step, payload = x
        flat = each[at:at + n].ravel()
        out.append((flat[:payload] if payload >= 0 else flat, step, histograms[at:at + n]))
        at += n
    return out


def shots(histograms: np.ndarray, reach: int = 8, spread: float = 2.0, least: float = 0.15) -> list[int]:
    """First frames of the shots: frame i starts one if its histogram differs from the last by
    more than ``least`` and more than mean + ``spread`` deviations of the differences of up to
    ``reach`` neighbours on each side."""
    if len(histograms) < 2:
        return [0]
    change = np.abs(np.diff(histograms, axis=0)).sum(axis=1) / (2.0 * histograms[0].sum())
    n = len(change)
    sums = np.concatenate([[0.0], np.cumsum(change)])
    squares = np.concatenate([[0.0], np.cumsum(change * change)])
    lo, hi = np.maximum(0, np.arange(n) - reach), np.minimum(n, np.arange(n) + reach + 1)
    count = np.maximum(hi - lo - 1, 1)
    mean = (sums[hi] - sums[lo] - change) / count
    deviation = np.sqrt(np.maximum((squares[hi] - squares[lo] - change * change) / count - mean * mean, 0))
    return [0, *(np.flatnonzero((change > least) & (change > mean + spread * deviation)) + 1).tolist()]


def encode_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text (null: empty) in UTF-8, zeros appended up to a positive
    multiple of 64, as an AVI file.  Only doc_id and text are read."""
    def work(batches):
        for batch in batches:
            raw, offsets = texts_of(batch.column(1))
            for a, b in row_chunks(offsets, CHUNK):
                sizes = np.diff(offsets[a:b + 1])
                whole = [raw[s:e].tobytes().ljust(max(64, -(-(e - s) // 64) * 64), b"\x00") for s, e in zip(offsets[a:b].tolist(), offsets[a + 1:b + 1].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(write_videos(whole), pa.binary())], ["doc_id", "n_bytes", "media"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, n_bytes long, media binary")


def read_media(videos: DataFrame) -> DataFrame:
    """``videos`` (doc_id, n_bytes, media) -> doc_id, n_bytes, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, clips (array of clip, first_frame, frames, start_ms,
    end_ms).  A null or broken file gives nulls and no clips."""
    clip = pa.list_(pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("frames", pa.int32()), ("start_ms", pa.int64()), ("end_ms", pa.int64())]))

    def work(batches):
        for batch in batches:
            files = [x or b"" for x in batch.column(2).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in files])])
            for a, b in row_chunks(ends, CHUNK):
                rows = []
                for data, got in zip(files[a:b], read_videos(files[a:b])):
                    if got is None:
                        rows.append((None, None, None, len(data), hashlib.sha256(data).hexdigest(), []))
                        continue
                    samples, step, histograms = got
                    back = samples.tobytes()
                    cuts = [*shots(histograms), len(histograms)]
                    clips = [{"clip": i, "first_frame": s, "frames": e - s, "start_ms": s * step // 1000, "end_ms": e * step // 1000} for i, (s, e) in enumerate(zip(cuts, cuts[1:]))]
                    rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(data), hashlib.sha256(data).hexdigest(), clips))
                columns = list(zip(*rows))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), clip]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                                                 ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "clips"])
    return videos.select("doc_id", "n_bytes", "media").mapInArrow(work, """doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long,
        media_sha256 string, clips array<struct<clip int, first_frame int, frames int, start_ms long, end_ms long>>""")


def clip_rows(videos: DataFrame) -> DataFrame:
    """Timed clips, one row each: doc_id, clip, first_frame, frames, start_ms, end_ms."""
    return read_media(videos).select("doc_id", F.inline("clips"))


def media_digest(docs: DataFrame) -> DataFrame:
    """One row per document: sizes and checksums of what was read back, and ``feature``: the
    clips as start-end in milliseconds, comma-joined."""
    read = read_media(encode_documents(docs))
    feature = F.array_join(F.transform("clips", lambda c: F.concat_ws("-", c["start_ms"].cast("string"), c["end_ms"].cast("string"))), ",")
    return read.withColumn("feature", feature).drop("clips")
