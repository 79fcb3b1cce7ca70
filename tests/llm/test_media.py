import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import media


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=4000))
def test_round_trip(raw):
    payload = media.padded(raw)
    assert len(payload) % media.FRAME == 0 and len(payload) > 0 and payload.startswith(raw)
    assert set(payload[len(raw) :]) <= {255}
    image = media.avi_of(payload)
    got, step, frames, clips = media.analysed(image)
    assert got == payload and step == 40 and frames == len(payload) // media.FRAME
    assert clips[0][0] == 0 and clips[-1][1] == frames and all(a[1] == b[0] for a, b in zip(clips, clips[1:]))


def test_extreme_differences():
    samples = np.zeros((2, media.SIDE, media.SIDE), np.uint8)
    samples[:, ::2, ::2] = 255  # differences of 255, whose bits need stuffing
    frames = media.encode_frames(samples)
    assert b"\xff\0" in frames[0][len(media.HEADER) :]
    assert (media.decode_frames(frames) == samples).all()


def test_bitwise_decoder_agrees():
    samples = np.random.default_rng(3).integers(0, 256, (1, media.SIDE, media.SIDE), dtype=np.uint8)
    (frame,) = media.encode_frames(samples)
    data = frame[len(media.HEADER) : -2].replace(b"\xff\0", b"\xff")
    height, width, predictor, codes = media._parsed(media.HEADER)
    assert (height, width, predictor) == (24, 24, 1)
    assert (media._bitwise(data, height, width, predictor, codes) == samples[0]).all()


def test_index_is_optional_and_checked():
    image = media.avi_of(bytes(media.FRAME * 3))
    cut = image[: image.rfind(b"idx1")]
    cut = cut[:4] + (len(cut) - 8).to_bytes(4, "little") + cut[8:]
    assert media.read_avi(cut)[1] == media.read_avi(image)[1]
    at = image.rfind(b"idx1")
    with pytest.raises(ValueError):
        media.read_avi(image[: at + 16] + b"\x09" + image[at + 17 :])
    with pytest.raises(ValueError):
        media.read_avi(b"RIFX" + image[4:])


def test_shots_adapt():
    still = np.full((30, 24, 24), 40, np.uint8)
    still[12:20] = 200
    assert media.cuts(still).tolist() == [0, 12, 20]
    restless = np.stack([np.full((24, 24), 255 * (k % 2), np.uint8) for k in range(30)])
    assert len(media.cuts(restless)) < 15
    assert media.cuts(still[:1]).tolist() == [0] and len(media.cuts(still[:0])) == 0


def test_query_equals_direct(odd_docs):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media.digests(media.media_column(odd_docs)).collect())
    want = []
    for r in odd_docs.collect():
        raw = (r.text or "").encode()
        p = media.padded(raw)
        want.append((r.doc_id is None, r.doc_id or 0, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert got == sorted(want)


def test_clip_rows(odd_docs):
    rows = media.clips(media.media_column(odd_docs)).collect()
    assert all(r.end_ms > r.start_ms and r.end_ms == r.end_frame * 40 for r in rows)
    assert len({r.doc_id for r in rows}) == odd_docs.select("doc_id").distinct().count()
    assert media.clips(media.media_column(odd_docs.limit(0))).collect() == []


def baseline(samples, sampling=(1, 1), interval=0, tables=False):
    """A baseline frame of grey samples, with two flat chroma components where sampling is not (1, 1)."""
    quant = np.full(64, 2.0)
    codes = {k: {s: key for key, s in media._codes(bytes.fromhex(x))[0].items()} for k, x in media.USUAL.items()}
    h, v = sampling
    parts = [(1, h, v, 0x00)] + ([(2, 1, 1, 0x11), (3, 1, 1, 0x11)] if sampling != (1, 1) else [])
    rows, columns = samples.shape
    wide, high = -(-columns // (8 * h)), -(-rows // (8 * v))
    full = np.pad(samples, ((0, high * 8 * v - rows), (0, wide * 8 * h - columns)), mode="edge").astype(float) - 128

    def bits(value, size):
        return format(value if value >= 0 else value + (1 << size) - 1, f"0{size}b") if size else ""

    def put(table, symbol):
        n, code = codes[table][symbol]
        return format(code, f"0{n}b")

    def coded(block, before, table):
        c = np.rint((media._COSINE @ block @ media._COSINE.T).reshape(-1)[media._ZIGZAG] / quant).astype(int).tolist()
        diff = c[0] - before
        out, run = put(table & 15, abs(diff).bit_length()) + bits(diff, abs(diff).bit_length()), 0
        last = max((k for k in range(1, 64) if c[k]), default=0)
        for k in range(1, last + 1):
            if not c[k]:
                run += 1
                continue
            while run > 15:
                out, run = out + put(0x10 | table & 15, 0xF0), run - 16
            n = abs(c[k]).bit_length()
            out, run = out + put(0x10 | table & 15, run << 4 | n) + bits(c[k], n), 0
        return out + (put(0x10 | table & 15, 0) if last < 63 else ""), c[0]

    scans, text, before = [], "", {1: 0, 2: 0, 3: 0}
    for unit in range(wide * high):
        if interval and unit and unit % interval == 0:
            scans.append(text)
            text, before = "", {1: 0, 2: 0, 3: 0}
        for part, ph, pv, table in parts:
            for k in range(ph * pv):
                y, x = (unit // wide * pv + k // ph) * 8, (unit % wide * ph + k % ph) * 8
                got, before[part] = coded(full[y : y + 8, x : x + 8] if part == 1 else np.zeros((8, 8)), before[part], table)
                text += got
    scans.append(text)
    data = b""
    for i, x in enumerate(scans):
        x += "1" * (-len(x) % 8)
        data += (bytes([0xFF, 0xD0 + (i - 1) % 8]) if i else b"") + int(x, 2).to_bytes(len(x) // 8, "big").replace(b"\xff", b"\xff\0")
    head = b"\xff\xd8" + media._segment(0xDB, b"\0" + bytes(quant.astype(np.uint8).tolist()))
    if tables:
        head += media._segment(0xC4, b"".join(bytes([k]) + bytes.fromhex(x) for k, x in media.USUAL.items()))
    if interval:
        head += media._segment(0xDD, interval.to_bytes(2, "big"))
    head += media._segment(0xC0, bytes([8, *rows.to_bytes(2, "big"), *columns.to_bytes(2, "big"), len(parts)]) + b"".join(bytes([p, a << 4 | b, 0]) for p, a, b, _ in parts))
    head += media._segment(0xDA, bytes([len(parts)]) + b"".join(bytes([p, 0x00 if p == 1 else 0x11]) for p, *_ in parts) + bytes([0, 63, 0]))
    return head + data + media.END


@pytest.mark.parametrize("sampling,interval,tables", [((1, 1), 0, False), ((2, 2), 0, True), ((2, 1), 3, False), ((1, 1), 2, True)])
def test_baseline_frames(sampling, interval, tables):
    rng = np.random.default_rng(4)
    y, x = np.mgrid[0:37, 0:53]
    samples = np.clip(100 + 60 * np.sin(x / 9) + 40 * np.cos(y / 7) + rng.normal(size=(37, 53)) * 8, 0, 255).astype(np.uint8)
    got = media.decode_baseline(baseline(samples, sampling, interval, tables))
    assert got.shape == samples.shape and np.abs(got.astype(int) - samples).max() <= 6


def test_shots_of_a_baseline_clip():
    dark, light = np.full((16, 24), 40, np.uint8), np.full((16, 24), 210, np.uint8)
    frames = [baseline(x, (2, 1)) for x in [dark] * 12 + [light] * 9 + [dark] * 5]
    _, step, n, found = media.analysed(media.write_avi(frames, 24, 16))
    assert (step, n, found) == (40.0, 26, [(0, 12), (12, 21), (21, 26)])


def test_usual_tables_are_complete():
    for k, x in media.USUAL.items():
        raw = bytes.fromhex(x)
        assert sum(raw[:16]) == len(raw) - 16 == len(set(raw[16:])) == (12 if k < 0x10 else 162)
    assert media._ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(media._ZIGZAG) == list(range(64))


def test_null_damaged_and_clashing(spark, make_docs):
    good = media.avi_of(media.padded(b"abc"))
    rows = [(1, 3, bytearray(good), 0), (2, None, None, 0), (3, 3, bytearray(b"RIFF no image"), 0), (None, 3, bytearray(good[:-40]), 0)]
    table = spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary, feature int").withColumn("clip", F.lit(1))
    got = {r.doc_id: r for r in media.digests(table).collect()}
    assert got[1].payload_bytes == 576 and got[2].feature is None and got[3].feature == got[None].feature == "damaged" and got[3].payload_sha256 is None
    assert [r.doc_id for r in media.clips(table).collect()] == [1]
    clash = make_docs(["a", None]).withColumns({c: F.lit(1) for c in ("n_bytes", "media", "__text")})
    assert media.digests(media.media_column(clash)).count() == 2


def test_times_without_exponents():
    assert media.milliseconds(10_000_040.0) == "10000040" and media.milliseconds(33.3667) == "33.367" and media.milliseconds(0.0) == "0"
