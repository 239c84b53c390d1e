import hashlib
import random
import zlib

import numpy as np
import pytest

from graphloom.llm import media as M


def payloads():
    rng = random.Random(2)
    return [M.padded(bytes(rng.choice([rng.randrange(256), 255, 0, 32]) for _ in range(n))) for n in (0, 1, 191, 192, 193, 1536, 1537, 6000)] + [b"\xff" * 384, M.padded("naïve — text".encode() * 300)]


def test_lossless_round_trip():
    data = payloads()
    for p, r in zip(data, M.read_avi(M.write_avi(data)), strict=True):
        assert r.payload == p and r.frames == -(-len(p) // (M.UNIT * M.PER_FRAME)) and r.fps == M.FPS


def test_frames_are_baseline_jpeg():
    for p, m in zip(payloads(), M.write_avi(payloads()), strict=True):
        got = b""
        for at, n in M.read_index(m)[0]:
            f = m[at : at + n]
            assert f[:2] == b"\xff\xd8" and f[-2:] == b"\xff\xd9"
            c = M.decode_symbols(f)
            assert c.shape == (M.PER_FRAME, M.UNIT) and ((abs(c) >= 128) & (abs(c) <= 255)).all()
            got += M.coefficient_bytes(c).tobytes()
        assert got[: len(p)] == p


def test_general_tables_are_decoded():
    head = M.FRAME_HEAD.replace(M._huffman(0x10, b"\x08"), M._huffman(0x10, b"\x00\x11"))
    bits = ("0" + "10000001" + "10" + "1" + "0") * 3  # DC of category 8, one coefficient after a run of one, end of block
    part = bytes(int(bits.ljust(-(-len(bits) // 8) * 8, "1")[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
    frame = head + b"".join(part + bytes([0xFF, 0xD0 + i % 8]) for i in range(M.PER_FRAME - 1)) + part + b"\xff\xd9"
    c = M.decode_symbols(frame)
    assert (c[:, 0] == 129).all() and (c[:, 2] == 1).all() and c.sum() == M.PER_FRAME * 3 * 130


def test_inverse_transform():
    rng = np.random.default_rng(0)
    units = rng.integers(0, 256, (3, M.PER_FRAME, M.UNIT), dtype=np.uint8)
    hist = M.luminance_histograms(units)
    zig = [(0, 0), (0, 1), (1, 0), (2, 0), (1, 1), (0, 2)]
    coef = units[0, 0, :64].astype(float)
    coef = np.where(coef < 128, coef - 255, coef)
    assert hist.sum() == 3 * M.PER_FRAME * 64 and (hist[1:] == M.luminance_histograms(units[1:])).all()
    for i, (v, u) in enumerate(zig):
        y, x = np.mgrid[:8, :8]
        want = np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) * (0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) / 4
        assert abs(M._basis()[i].reshape(8, 8) / 4096 - want).max() < 2e-4


def test_shots():
    a, b = np.eye(M.BINS, dtype=np.int64)[2] * 512, np.eye(M.BINS, dtype=np.int64)[9] * 512
    assert M.shot_cuts(np.array([a, a, b, b, b, a])) == [2, 5]
    assert M.shot_cuts(np.array([a])) == [] and M.shot_cuts(np.array([a] * 5)) == []


def test_refused():
    for bad in (b"", b"RIFF1234WAVE", M.write_avi([b" " * 192])[0].replace(b"idx1", b"idxx"), M.write_avi([b" " * 192])[0].replace(b"MJPG", b"H264")):
        with pytest.raises(ValueError):
            M.read_index(bad)
    with pytest.raises(ValueError):
        M.write_avi([b"short"])


def test_digests_and_clips(spark):
    texts = {1: "hello", 2: None, 3: "", 4: "é" * 9000, 5: "hello", None: "x"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "1 as media")
    got = {r.doc_id: r for r in M.media_digests(df).collect()}
    for d, t in texts.items():
        raw = (t or "").encode()
        p = M.padded(raw)
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    assert got[1][1:] == got[5][1:] and got[2][1:] == got[3][1:]
    stored = M.store_texts(df)
    assert {r.doc_id: hashlib.sha256(r.media).hexdigest() for r in stored.collect()} == {d: r.media_sha256 for d, r in got.items()}
    rows = M.clips(stored).collect()
    for d in texts:
        mine = sorted((r for r in rows if r.doc_id == d), key=lambda r: r.clip)
        assert mine[0].start_s == 0 and all(a.end_s == b.start_s for a, b in zip(mine, mine[1:], strict=False))
        assert abs(mine[-1].end_s * M.FPS - sum(r.frames for r in mine)) < 1e-6
    assert M.media_digests(df.limit(0)).count() == 0 and M.clips(stored.limit(0)).count() == 0


def test_long_payloads_in_slices(monkeypatch):
    monkeypatch.setattr(M, "FRAMES", 3)
    raw = [M.padded(bytes(range(256)) * n) for n in (1, 200, 40)]
    stored = M.write_avi(raw)
    sliced = M.read_avi(stored)
    monkeypatch.setattr(M, "FRAMES", 1 << 20)
    assert M.write_avi(raw) == stored
    assert [r.payload for r in sliced] == raw
    assert [r.feature for r in M.read_avi(stored)] == [r.feature for r in sliced]


def test_one_medium_is_read_slice_by_slice(monkeypatch):
    rng = random.Random(8)
    raw = [M.padded(rng.randbytes(n)) for n in (0, 1535, 1536, 1537, 3 * 1536, 3 * 1536 + 1, 40_000)]
    stored = M.write_avi(raw)
    whole = M.read_avi(stored)
    monkeypatch.setattr(M, "FRAMES", 3)
    for p, m, r in zip(raw, stored, whole, strict=True):
        assert M.write_avi([p]) == [m]
        got = M.summaries([m])[0]
        assert (got.payload_bytes, got.payload_sha256, got.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert (got.frames, got.fps, got.cuts, got.feature) == (r.frames, r.fps, r.cuts, r.feature)
    assert M.summaries(stored) == [M.summaries([m])[0] for m in stored]


def test_a_long_text_stands_alone():
    parts = list(M._grouped([(1, 5), (2, M.CHUNK), (3, 7), (4, M.CHUNK - 8), (5, 2), (6, 1)], lambda r: r[1]))
    assert [[r[0] for r in p] for p in parts] == [[1], [2], [3, 4, 5], [6]]
