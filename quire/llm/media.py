"""Operator 2: AVI motion-JPEG columns.

``avi_of`` writes bytes as grey frames of ``SIDE`` x ``SIDE`` 8-bit samples into a RIFF/AVI image: headers,
a ``movi`` list with one JPEG for each frame, and an ``idx1`` index. Frames are coded by JPEG's lossless
process (SOF3, predictor 1, one Huffman table), so every sample comes back. The table gives the
difference category s a code of 9 - s bits; a code and its s extra bits then always take 9 bits, which
numpy packs and unpacks for all frames at once. ``read_avi`` parses any chunk order by the RIFF sizes and
the index. ``decode_frame`` reads any lossless layout of one component: tables that are not of
that even kind, and predictors 1 to 7, go through a bit-by-bit decoder. Frames of the baseline process, as cameras write them,
are decoded by Huffman codes a symbol at a time and the inverse cosine transform over all blocks at once, with any
sampling of the components, restart markers, and the process' usual tables where a frame has none; their samples are the first component's, the luminance.

Shots: a frame's grey histogram is compared with the one before; a cut is a difference above the median
of the last ``WINDOW`` differences plus ``DEVIATIONS`` times their median deviation plus ``LEAST``. The threshold so
adapts to how much the clip moves. Runs between cuts are clips with times in milliseconds.

Defined results: null or empty text is stored as one frame of 255; equal texts give equal media;
repeated rows stay repeated; other columns are ignored. Null media has null digests and no clips. Damaged media raises
ValueError in ``analysed``; in a column it has no clips, null payload digests and the feature ``damaged``.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import whole_text

SIDE, RATE, PAD = 24, 25, 255
FRAME = SIDE * SIDE
BINS, WINDOW, DEVIATIONS, LEAST = 16, 8, 3.0, 0.25
#: Frames that are coded or decoded together.
SLAB = 2048


def padded(raw: bytes) -> bytes:
    """``raw`` with bytes 255 up to a positive multiple of a frame."""
    return raw + bytes([PAD]) * (-len(raw) % FRAME if raw else FRAME)


# --- lossless JPEG frames -------------------------------------------------------------------------


def _word(diff: int) -> int:
    """The 9 bits of a difference: 8 - s ones, a zero, and the s extra bits."""
    s = abs(diff).bit_length()
    return ((1 << (8 - s)) - 1 << (s + 1)) | (diff if diff > 0 else diff + (1 << s) - 1)


_TO_WORD = np.array([_word(d) for d in range(-255, 256)], np.uint16)
_TO_DIFF = np.full(512, 32767, np.int16)
_TO_DIFF[_TO_WORD] = np.arange(-255, 256)
_LENGTHS = bytes([1] * 9 + [0] * 7)
_SYMBOLS = bytes(range(8, -1, -1))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


HEADER = b"\xff\xd8" + _segment(0xC4, b"\0" + _LENGTHS + _SYMBOLS) + _segment(0xC3, struct.pack(">BHHBBBB", 8, SIDE, SIDE, 1, 1, 0x11, 0)) + _segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))
END = b"\xff\xd9"


def _pack9(words: np.ndarray) -> np.ndarray:
    """Rows of 9-bit words (a multiple of 8 a row) as rows of bytes."""
    w = words.reshape(len(words), -1, 8).astype(np.uint64)
    high = w[:, :, 7] >> np.uint64(8)
    for k in range(7):
        high |= w[:, :, k] << np.uint64(55 - 9 * k)
    out = np.empty((*high.shape, 9), np.uint8)
    out[:, :, :8] = high.astype(">u8")[:, :, None].view(np.uint8)
    out[:, :, 8] = w[:, :, 7] & np.uint64(255)
    return out.reshape(len(words), -1)


def _unpack9(raw: np.ndarray) -> np.ndarray:
    groups = raw.reshape(len(raw), -1, 9)
    high = np.ascontiguousarray(groups[:, :, :8]).view(">u8")[:, :, 0].astype(np.uint64)
    out = np.empty((*high.shape, 8), np.uint16)
    for k in range(7):
        out[:, :, k] = high >> np.uint64(55 - 9 * k) & np.uint64(511)
    out[:, :, 7] = (high & np.uint64(1)) << np.uint64(8) | groups[:, :, 8]
    return out.reshape(len(raw), -1)


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """A lossless JPEG of each frame (n, SIDE, SIDE)."""
    x = samples.astype(np.int16)
    diff = np.empty_like(x)
    diff[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    diff[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    diff[:, 0, 0] = x[:, 0, 0] - 128
    packed = _pack9(_TO_WORD[diff.reshape(len(x), -1) + 255])
    return [HEADER + row.tobytes().replace(b"\xff", b"\xff\0") + END for row in packed]


#: fixed values: the usual Huffman tables of motion-JPEG (codes of each length, then symbols), by class and component
USUAL = {
    0x00: "00010501010101010100000000000000" "000102030405060708090a0b",
    0x01: "00030101010101010101010000000000" "000102030405060708090a0b",
    0x10: "0002010303020403050504040000017d"
    "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a"
    "535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9ca"
    "d2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa",
    0x11: "00020102040403040705040400010277"
    "0001020311040521310612415107617113223281081442" "91a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a"
    "535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9ca"
    "d2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa",
}


def _codes(table: bytes) -> tuple[dict[tuple[int, int], int], int]:
    """Symbols by (length, code) of a table, and the bytes it takes."""
    codes, code, k = {}, 0, 16
    for n, count in enumerate(table[:16], 1):
        for _ in range(count):
            codes[n, code] = table[k]
            code, k = code + 1, k + 1
        code <<= 1
    return codes, k


def _zigzag() -> np.ndarray:
    """The place (row * 8 + column) of each coefficient in order of frequency."""
    return np.array([r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))])


_ZIGZAG = _zigzag()
_COSINE = np.array([[(0.125**0.5 if k == 0 else 0.5) * np.cos((2 * x + 1) * k * np.pi / 16) for x in range(8)] for k in range(8)])


class Bits:
    """The bits of a scan's data, without stuffed bytes."""

    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data.replace(b"\xff\0", b"\xff"), np.uint8)).tolist(), 0

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.bits[self.at]
            self.at += 1
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("no such code")

    def signed(self, size: int) -> int:
        value = 0
        for _ in range(size):
            value = value << 1 | self.bits[self.at]
            self.at += 1
        return value if not size or value >> (size - 1) else value - (1 << size) + 1


def decode_baseline(frame: bytes) -> np.ndarray:
    """The first component's samples (height, width) of a frame of the baseline process."""
    tables = {k: _codes(bytes.fromhex(x))[0] for k, x in USUAL.items()}
    scales, parts, interval, at, size = {}, [], 0, 2, None
    while True:
        if at + 4 > len(frame) or frame[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker, length = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body, at = frame[at + 4 : at + 2 + length], at + 2 + length
        if marker == 0xDB:
            while body:
                wide, place = body[0] >> 4, body[0] & 15
                scales[place] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(float)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                tables[body[0]], taken = _codes(body[1:])
                body = body[1 + taken :]
        elif marker in (0xC0, 0xC1):
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            if bits != 8:
                raise ValueError("only 8-bit frames")
            size, parts = (height, width), [[body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]] for k in range(n)]
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("only the baseline and the lossless process")
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            chosen = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
            break
    if size is None or set(chosen) != {p[0] for p in parts} or any(p[3] not in scales for p in parts):
        raise ValueError("an incomplete frame")
    if len(parts) == 1:
        parts[0][1:3] = 1, 1  # a single component is not interleaved
    across, down = max(p[1] for p in parts), max(p[2] for p in parts)
    wide, high = -(-size[1] // (8 * across)), -(-size[0] // (8 * down))
    name, h, v, scale = parts[0]
    out = np.zeros((high * v, wide * h, 64))
    scans = re.split(rb"\xff[\xd0-\xd7]", frame[at : frame.rindex(END)]) if interval else [frame[at : frame.rindex(END)]]
    unit = 0
    try:
        for data in scans:
            reader, before = Bits(data), {p[0]: 0 for p in parts}
            for _ in range(interval or wide * high):
                if unit >= wide * high:
                    break
                for part, ph, pv, _ in parts:
                    dc, ac = tables[chosen[part] >> 4], tables[0x10 | chosen[part] & 15]
                    for k in range(ph * pv):
                        block, place = [0] * 64, 1
                        before[part] += reader.signed(reader.symbol(dc))
                        block[0] = before[part]
                        while place < 64:
                            x = reader.symbol(ac)
                            if not x:
                                break
                            place += x >> 4
                            if x != 0xF0:
                                block[place] = reader.signed(x & 15)
                            place += 1
                        if part == name:
                            out[unit // wide * v + k // h, unit % wide * h + k % h] = block
                unit += 1
    except (IndexError, KeyError):
        raise ValueError("a scan is damaged") from None
    if unit < wide * high:
        raise ValueError("a scan is too short")
    ordered = np.zeros_like(out)
    ordered[:, :, _ZIGZAG] = out * scales[scale]
    blocks = np.einsum("yxkl,ki,lj->yixj", ordered.reshape(*out.shape[:2], 8, 8), _COSINE, _COSINE)
    rows, columns = -(-size[0] * v // down), -(-size[1] * h // across)
    return np.clip(np.rint(blocks.reshape(out.shape[0] * 8, -1) + 128), 0, 255).astype(np.uint8)[:rows, :columns]


@functools.lru_cache(64)
def _parsed(header: bytes) -> tuple[int, int, int, dict[tuple[int, int], int]]:
    """(height, width, predictor, codes by (length, code)) of a frame up to its scan's data."""
    at, size, codes, predictor = 2, None, {}, None
    if header[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    while at < len(header):
        mark, marker, length = struct.unpack_from(">BBH", header, at)
        if mark != 0xFF:
            raise ValueError("a marker is missing")
        body = header[at + 4 : at + 2 + length]
        if marker == 0xC4:
            codes = _codes(body[1:])[0]
        elif marker == 0xC3:
            bits, height, width, parts = struct.unpack_from(">BHHB", body)
            if bits != 8 or parts != 1:
                raise ValueError("only 8-bit frames of one component")
            size = height, width
        elif 0xC0 <= marker <= 0xCF:
            raise ValueError("only the lossless process")
        elif marker == 0xDA:
            predictor = body[3]
        at += 2 + length
    if size is None or predictor is None or not codes:
        raise ValueError("an incomplete frame")
    return (*size, predictor, codes)


_EVEN = {(n + 1, (1 << (n + 1)) - 2): 8 - n for n in range(9)}


def _bitwise(data: bytes, height: int, width: int, predictor: int, codes: dict) -> np.ndarray:
    """Any Huffman table and predictor, a bit at a time."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8)).tolist()
    at, out = 0, np.zeros((height, width), np.int64)
    for y in range(height):
        for x in range(width):
            code = n = 0
            while (n, code) not in codes:
                code, n, at = code << 1 | bits[at], n + 1, at + 1
                if n > 16:
                    raise ValueError("no such code")
            s, extra = codes[n, code], 0
            for _ in range(s):
                extra, at = extra << 1 | bits[at], at + 1
            diff = extra if not s or extra >> (s - 1) else extra - (1 << s) + 1
            if not y:
                guess = out[0, x - 1] if x else 128
            elif not x:
                guess = out[y - 1, 0]
            else:
                a, b, c = out[y, x - 1], out[y - 1, x], out[y - 1, x - 1]
                guess = (0, a, b, c, a + b - c, a + ((b - c) >> 1), b + ((a - c) >> 1), (a + b) >> 1)[predictor]
            out[y, x] = (guess + diff) & 0xFFFF
    return out.astype(np.uint8)


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """Samples (n, height, width) of frames of one size."""
    if frames and b"\xff\xc3" not in frames[0][: frames[0].find(b"\xff\xda")]:
        samples = [decode_baseline(x) for x in frames]
        if len({x.shape for x in samples}) > 1:
            raise ValueError("frames of several sizes")
        return np.stack(samples)
    scans, sizes, even = [], set(), True
    for frame in frames:
        start = frame.find(b"\xff\xda")
        if start < 0 or frame[-2:] != END:
            raise ValueError("a frame without scan or end")
        start += 2 + struct.unpack_from(">H", frame, start + 2)[0]
        height, width, predictor, codes = _parsed(frame[:start])
        scans.append((frame[start:-2].replace(b"\xff\0", b"\xff"), predictor, codes))
        sizes.add((height, width))
        even &= predictor == 1 and codes == _EVEN and not height * width % 8
    if len(sizes) > 1:
        raise ValueError("frames of several sizes")
    if not frames:
        return np.zeros((0, SIDE, SIDE), np.uint8)
    height, width = sizes.pop()
    if not even:
        return np.stack([_bitwise(data, height, width, predictor, codes) for data, predictor, codes in scans])
    raw = b"".join(x[0] for x in scans)
    if len(raw) != len(frames) * height * width * 9 // 8:
        raise ValueError("a scan is too short or too long")
    diff = _TO_DIFF[_unpack9(np.frombuffer(raw, np.uint8).reshape(len(frames), -1))].reshape(-1, height, width)
    if diff.max() > 255:
        raise ValueError("no such code")
    x = diff.copy()
    x[:, 0, 0] += 128
    x[:, :, 0] = np.cumsum(x[:, :, 0], axis=1, dtype=np.int16)
    return np.cumsum(x, axis=2, dtype=np.int16).astype(np.uint8)


# --- RIFF ---------------------------------------------------------------------------------------


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], width: int = SIDE, height: int = SIDE, rate: int = RATE) -> bytes:
    """An AVI image of motion-JPEG frames with its index."""
    largest = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // rate, largest * rate, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4h", b"vids", b"MJPG", 0, 0, 0, 0, 1, rate, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    form = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form)))
    index, at, body = [], 4, [b"movi"]
    for frame in frames:
        body.append(_chunk(b"00dc", frame))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        at += len(body[-1])
    return _chunk(b"RIFF", b"AVI " + head + _chunk(b"LIST", b"".join(body)) + _chunk(b"idx1", b"".join(index)))


def _chunks(raw: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, begin, end) of the chunks of a range."""
    while at + 8 <= end:
        kind, size = struct.unpack_from("<4sI", raw, at)
        if at + 8 + size > end:
            raise ValueError("a chunk reaches past its list")
        yield kind, at + 8, at + 8 + size
        at += 8 + size + (size & 1)


def read_avi(image: bytes) -> tuple[float, list[bytes]]:
    """(milliseconds a frame, frames by the index; without an index, by the chunks of the movi list)."""
    raw = memoryview(image)
    if image[:4] != b"RIFF" or image[8:12] != b"AVI " or len(image) < 12:
        raise ValueError("not an AVI image")
    step, movi, index = 1000 / RATE, None, None
    for kind, a, b in _chunks(raw, 12, 8 + struct.unpack_from("<I", raw, 4)[0]):
        if kind == b"idx1":
            index = [struct.unpack_from("<4sIII", raw, k) for k in range(a, b, 16)]
        elif kind == b"LIST" and image[a : a + 4] == b"movi":
            movi = a, b
        elif kind == b"LIST" and image[a : a + 4] == b"hdrl":
            for inner, c, _ in _chunks(raw, a + 4, b):
                if inner == b"avih":
                    step = struct.unpack_from("<I", raw, c)[0] / 1000
    if movi is None:
        raise ValueError("no movi list")
    if index is None:
        return step, [image[a:b] for kind, a, b in _chunks(raw, movi[0] + 4, movi[1]) if kind[2:] == b"dc"]
    # index places count from the list's kind, or in some files from the image's begin
    base = movi[0] if not index or index[0][2] < movi[0] else 0
    frames = []
    for kind, _, at, size in index:
        if kind[2:] != b"dc":
            continue
        if struct.unpack_from("<4sI", raw, base + at) != (kind, size):
            raise ValueError("the index does not match the chunks")
        frames.append(image[base + at + 8 : base + at + 8 + size])
    return step, frames


def avi_of(payload: bytes) -> bytes:
    """The payload (whole frames) as an AVI image."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, SIDE, SIDE)
    return write_avi([x for k in range(0, len(samples), SLAB) for x in encode_frames(samples[k : k + SLAB])])


# --- shots --------------------------------------------------------------------------------------


def cuts(samples: np.ndarray) -> np.ndarray:
    """The frames at which a new shot begins; 0 is the first."""
    n = len(samples)
    if n < 2:
        return np.zeros(min(n, 1), np.int64)
    flat = samples.reshape(n, -1)
    bins = np.bincount((np.arange(n)[:, None] * BINS + (flat >> 4)).reshape(-1), minlength=n * BINS).reshape(n, BINS)
    d = np.abs(np.diff(bins, axis=0)).sum(1) / (2 * flat.shape[1])
    # the differences before each one, at most WINDOW; an earlier cut among them moves a median little
    before = np.full((n - 1, WINDOW), np.nan)
    for k in range(1, min(WINDOW, n - 2) + 1):
        before[k:, k - 1] = d[:-k]
    middle, spread = np.zeros(n - 1), np.zeros(n - 1)
    middle[1:] = np.nanmedian(before[1:], axis=1)
    spread[1:] = np.nanmedian(np.abs(before[1:] - middle[1:, None]), axis=1)
    return np.concatenate([[0], 1 + np.flatnonzero(d > middle + DEVIATIONS * spread + LEAST)])


def analysed(image: bytes) -> tuple[bytes, float, int, list[tuple[int, int]]]:
    """(payload, milliseconds a frame, frames, clips as (first frame, end frame)) of an AVI image."""
    step, frames = read_avi(image)
    parts = [decode_frames(frames[k : k + SLAB]) for k in range(0, len(frames), SLAB)]
    samples = np.concatenate(parts) if parts else np.zeros((0, SIDE, SIDE), np.uint8)
    begins = cuts(samples).tolist()
    return samples.tobytes(), step, len(samples), list(zip(begins, [*begins[1:], len(samples)], strict=True))


def tried(image: bytes):
    """``analysed``, or None for damaged media."""
    try:
        return analysed(image)
    except (ValueError, IndexError, struct.error):
        return None


def milliseconds(x: float) -> str:
    """Up to three decimals, without an exponent."""
    return f"{x:.3f}".rstrip("0").rstrip(".")


# --- DataFrames ---------------------------------------------------------------------------------


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): every text stored as an AVI image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                raw = [x.as_py().encode() for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(len, raw)), pa.int64()), pa.array([avi_of(padded(x)) for x in raw], pa.binary())], names=[id_col, "n_bytes", "media"])

    rows = docs.select(F.col(id_col), whole_text(text_col).alias("__text"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, n_bytes long, media binary")


def clips(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each shot: id, clip, first_frame, end_frame, start_ms, end_ms. Null media has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                image = batch.column(1)[k].as_py()
                got = None if image is None else tried(image)
                if got is None:
                    continue
                _, step, _, found = got
                ids = pa.array([batch.column(0)[k].as_py()] * len(found), batch.column(0).type)
                columns = [range(len(found)), [a for a, _ in found], [b for _, b in found]]
                times = [[a * step for a, _ in found], [b * step for _, b in found]]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in columns), *(pa.array(x, pa.float64()) for x in times)], names=[id_col, "clip", "first_frame", "end_frame", "start_ms", "end_ms"])

    rows = media.select(F.col(id_col), F.col(media_col))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, clip long, first_frame long, end_frame long, start_ms double, end_ms double")


def digests(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of every stored image, read back: sizes and hashes of payload and media, and the shots as a string."""
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [None, None, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for cell in batch.column(2):
                image = cell.as_py()
                if image is None:
                    rows.append((None,) * 6)
                    continue
                if (got := tried(image)) is None:
                    rows.append((None, None, None, len(image), hashlib.sha256(image).hexdigest(), "damaged"))
                    continue
                payload, step, n, found = got
                feature = f"frames={n};shots={len(found)};" + ",".join(f"{milliseconds(a * step)}-{milliseconds(b * step)}" for a, b in found)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest(), feature))
            columns = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, t) for x, t in zip(columns, kinds[2:], strict=True))], names=names)

    rows = media.select(id_col, "n_bytes", "media")
    schema = f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return rows.mapInArrow(run, schema)
