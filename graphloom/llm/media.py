"""Media columns: AVI files of motion JPEG, with lossless payloads, decoded frames, shots and clips.

A payload is stored one byte to a DCT coefficient, the format's unit: in a size
category of 8 the extra bits of a JPEG coefficient are any byte, and stand for
-255..-128 and 128..255.  192 bytes fill the three blocks of an 8 x 8 colour MCU.
Frames hold ``WIDE`` x ``HIGH`` MCUs, each a restart interval, so predictors start
anew and the bytes survive exactly; with a Huffman table of one code they take nine
bits each, at fixed places, which numpy packs and unpacks for many documents at
once.  Other baseline streams are decoded symbol by symbol.

Frames are found by the RIFF index.  Their luminance (an exact integer inverse
transform) gives histograms; a shot begins where the difference to the frame
before exceeds an adaptive threshold, and shots are timed clip rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_rows

UNIT = 192
WIDE, HIGH = 4, 2
PER_FRAME = WIDE * HIGH
FPS = 25
BINS = 16
PAD = 32
CHUNK = 1 << 20
#: Frames whose bits or pixels are expanded at a time, so that one long payload needs no more room than many short ones.
FRAMES = 256
_MCU_BYTES = UNIT * 9 // 8


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman(kind: int, symbols: bytes) -> bytes:
    """A table of codes 0, 10, 110, ..; the last is never all ones, as the format asks."""
    return _segment(0xC4, bytes([kind]) + bytes([1] * len(symbols) + [0] * (16 - len(symbols))) + symbols)


#: Quantisation by one, three components without subsampling, a restart interval of one MCU.
FRAME_HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, b"\0" + b"\1" * 64)
    + _segment(0xC0, struct.pack(">BHHB", 8, HIGH * 8, WIDE * 8, 3) + b"\1\x11\0\2\x11\0\3\x11\0")
    + _huffman(0x00, b"\x08")
    + _huffman(0x10, b"\x08")
    + _segment(0xDD, struct.pack(">H", 1))
    + _segment(0xDA, b"\3\1\0\2\0\3\0\0\x3f\0")
)
_RESTARTS = np.array([[0xFF, 0xD0 + i % 8] for i in range(PER_FRAME)], np.uint8)
_BODY = PER_FRAME * (_MCU_BYTES + 2) - 2


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def padded(raw: bytes) -> bytes:
    """The bytes with spaces up to a positive multiple of UNIT."""
    return raw + bytes([PAD]) * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def entropy(units: np.ndarray) -> np.ndarray:
    """Coded bytes of MCUs, (n, 192) to (n, 216), before stuffing."""
    step = FRAMES * PER_FRAME
    if len(units) > step:
        return np.concatenate([entropy(units[at : at + step]) for at in range(0, len(units), step)])
    bits = np.zeros((len(units), UNIT, 9), np.uint8)
    bits[:, :, 1:] = np.unpackbits(units.reshape(-1, UNIT, 1), axis=2)
    return np.packbits(bits.reshape(len(units), UNIT * 9), axis=1)


def _frames(payloads: list[bytes]) -> Iterator[list[bytes]]:
    """The JPEG frames of each payload."""
    full = PER_FRAME * UNIT
    filled = [p + bytes([PAD]) * (-len(p) % full) for p in payloads]
    coded = entropy(np.frombuffer(b"".join(filled), np.uint8).reshape(-1, UNIT)).reshape(-1, PER_FRAME, _MCU_BYTES)
    stuffed = (coded == 0xFF).any((1, 2))
    body = np.concatenate([coded, np.broadcast_to(_RESTARTS, (len(coded), PER_FRAME, 2))], 2).reshape(len(coded), -1)[:, :_BODY].tobytes()
    at = 0
    for p in filled:
        out = []
        for i in range(at, at + len(p) // full):
            if stuffed[i]:
                parts = [coded[i, m].tobytes().replace(b"\xff", b"\xff\0") for m in range(PER_FRAME)]
                data = b"".join(x + (_RESTARTS[m].tobytes() if m < PER_FRAME - 1 else b"") for m, x in enumerate(parts))
            else:
                data = body[i * _BODY : (i + 1) * _BODY]
            out.append(FRAME_HEAD + data + b"\xff\xd9")
        at += len(p) // full
        yield out


def _head(n: int, most: int, payload_bytes: int) -> bytes:
    """All that stands before the frames, but for the sizes of the file and of the list of frames; as long for any numbers."""
    w, h = WIDE * 8, HIGH * 8
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, n, 0, 1, most, w, h, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, n, most, 0xFFFFFFFF, 0, 0, 0, w, h)
    strf = struct.pack("<IiiHH4sIiiII", 40, w, h, 1, 24, b"MJPG", w * h * 3, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    return b"AVI " + hdrl + _chunk(b"plen", struct.pack("<Q", payload_bytes))


def _avi(frames: Iterable[bytes], payload_bytes: int) -> bytes:
    """A RIFF file with headers, the frames as they come and their index; chunk ``plen`` has the payload's length."""
    movi = 8 + len(_head(0, 0, 0))
    out = bytearray(movi + 12)
    lengths, places = array("I"), array("I")
    for f in frames:
        places.append(len(out) - movi - 8)
        lengths.append(len(f))
        out += _chunk(b"00dc", f)
    out[movi : movi + 12] = b"LIST" + struct.pack("<I", len(out) - movi - 8) + b"movi"
    index = np.full((len(lengths), 4), int.from_bytes(b"00dc", "little"), "<u4")
    index[:, 1], index[:, 2], index[:, 3] = 0x10, places, lengths
    out += _chunk(b"idx1", index.tobytes())
    out[:movi] = b"RIFF" + struct.pack("<I", len(out) - 8) + _head(len(lengths), max(lengths), payload_bytes)
    return bytes(out)


def write_avi(payloads: list[bytes]) -> list[bytes]:
    """Media of payloads whose lengths are positive multiples of UNIT; one on its own is coded slice by slice."""
    if any(not p or len(p) % UNIT for p in payloads):
        raise ValueError(f"payloads must be positive multiples of {UNIT} bytes")
    if len(payloads) == 1:
        step = FRAMES * PER_FRAME * UNIT
        slices = (next(_frames([payloads[0][at : at + step]])) for at in range(0, len(payloads[0]), step))
        return [_avi(chain.from_iterable(slices), len(payloads[0]))]
    return [_avi(f, len(p)) for f, p in zip(_frames(payloads), payloads, strict=True)]


def read_index(media: bytes) -> tuple[list[tuple[int, int]], int | None, float]:
    """(place, length) of each frame by the RIFF index, the payload's length, frames a second.

    Raises ValueError for what is not a motion-JPEG AVI file with an index.
    """
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, end, movi, index, length, fps = 12, 8 + struct.unpack_from("<I", media, 4)[0], None, None, None, 0.0
    while at + 8 <= min(end, len(media)):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"LIST" and media[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"LIST" and media[at + 8 : at + 12] == b"hdrl":
            fps = 1e6 / max(1, struct.unpack_from("<I", media, at + 20)[0])
            if media[at : at + 8 + size].find(b"vidsMJPG") < 0:
                raise ValueError("not motion JPEG")
        elif name == b"plen":
            length = struct.unpack_from("<Q", media, at + 8)[0]
        elif name == b"idx1":
            index = (at + 8, size // 16)
        at += 8 + size + (size & 1)
    if movi is None or index is None:
        raise ValueError("no frames or no index")
    entries = np.frombuffer(media, "<u4", index[1] * 4, index[0]).reshape(-1, 4)
    entries = entries[entries[:, 0] == int.from_bytes(b"00dc", "little")]
    return [(movi + int(o) + 8, int(n)) for o, n in entries[:, 2:]], length, fps


@dataclass(frozen=True)
class FrameHead:
    width: int
    height: int
    start: int
    restart: int
    tables: dict
    fixed: bool


@lru_cache(maxsize=64)
def read_head(head: bytes) -> FrameHead:
    """Parses the segments up to the scan of a baseline frame."""
    at, tables, size, restart = 2, {}, (0, 0), 0
    while at < len(head):
        marker, n = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        body = head[at + 4 : at + 2 + n]
        if marker == 0xC0:
            size = struct.unpack_from(">HH", body, 1)
        elif marker == 0xDD:
            restart = struct.unpack_from(">H", body)[0]
        elif marker == 0xC4:
            while body:
                counts, code, codes, k = body[1:17], 0, {}, 17
                for bits in range(1, 17):
                    for _ in range(counts[bits - 1]):
                        codes[bits, code] = body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                tables[body[0]] = codes
                body = body[k:]
        at += 2 + n
        if marker == 0xDA:
            break
    fixed = restart == 1 and size == (HIGH * 8, WIDE * 8) and all(tables.get(t) == {(1, 0): 8} for t in (0x00, 0x10))
    return FrameHead(size[1], size[0], at, restart, tables, fixed)


def _scan_start(frame: bytes) -> int:
    at = 2
    while frame[at + 1] != 0xDA:
        at += 2 + struct.unpack_from(">H", frame, at + 2)[0]
    return at + 2 + struct.unpack_from(">H", frame, at + 2)[0]


def _intervals(scan: bytes) -> list[bytes]:
    """The restart intervals of a scan, unstuffed."""
    parts, at, last = [], 0, 0
    while (at := scan.find(b"\xff", at)) >= 0:
        if 0xD0 <= scan[at + 1] <= 0xD7 or scan[at + 1] == 0xD9:
            parts.append(scan[last:at].replace(b"\xff\0", b"\xff"))
            last = at + 2
        at += 2
    return parts


def decode_symbols(frame: bytes) -> np.ndarray:
    """Coefficients (MCU, 192) of any baseline 4:4:4 frame, symbol by symbol."""
    start = _scan_start(frame)
    head, out = read_head(frame[:start]), []
    mcus = head.width * head.height // 64
    for part in _intervals(frame[start:]):
        bits, at = "".join(f"{b:08b}" for b in part), 0
        dc = [0, 0, 0]

        def symbol(table: dict, at: int, bits: str = bits) -> tuple[int, int]:
            for n in range(1, 17):
                got = table.get((n, int(bits[at : at + n], 2)))
                if got is not None:
                    return got, at + n
            raise ValueError("bad code")

        def value(size: int, at: int, bits: str = bits) -> tuple[int, int]:
            v = int(bits[at : at + size] or "0", 2)
            return (v if not size or v >> size - 1 else v - (1 << size) + 1), at + size

        for _ in range(min(head.restart or mcus, mcus - len(out))):
            unit = []
            for c in range(3):
                block = [0] * 64
                size, at = symbol(head.tables[0x00], at)
                diff, at = value(size, at)
                dc[c] += diff
                block[0], k = dc[c], 1
                while k < 64:
                    s, at = symbol(head.tables[0x10], at)
                    if s == 0:
                        break
                    k += s >> 4
                    if s & 15:
                        block[k], at = value(s & 15, at)
                    k += 1
                unit += block
            out.append(unit)
    return np.array(out, np.int16)


def coefficient_bytes(coefficients: np.ndarray) -> np.ndarray:
    """The payload bytes that coefficients of size category 8 stand for."""
    return np.where(coefficients < 0, coefficients + 255, coefficients).astype(np.uint8)


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """Payload bytes (frame, PER_FRAME, 192) of frames with the fixed table, all together."""
    if len(frames) > FRAMES:
        return np.concatenate([decode_frames(frames[at : at + FRAMES]) for at in range(0, len(frames), FRAMES)])
    out, plain, where = np.empty((len(frames), PER_FRAME, UNIT), np.uint8), [], []
    head = len(FRAME_HEAD)
    for i, f in enumerate(frames):
        if len(f) == head + _BODY + 2 and f.startswith(FRAME_HEAD):
            plain.append(f[head:-2] + b"\0\0")
            where.append(i)
            continue
        start = _scan_start(f)
        if read_head(f[:start]).fixed:
            coded = np.frombuffer(b"".join(_intervals(f[start:])), np.uint8).reshape(PER_FRAME, _MCU_BYTES)
            out[i] = np.packbits(np.unpackbits(coded, axis=1).reshape(PER_FRAME, UNIT, 9)[:, :, 1:], axis=2)[:, :, 0]
        else:
            out[i] = coefficient_bytes(decode_symbols(f))
    if plain and read_head(FRAME_HEAD).fixed:
        coded = np.frombuffer(b"".join(plain), np.uint8).reshape(-1, _MCU_BYTES + 2)[:, :_MCU_BYTES]
        bits = np.unpackbits(coded, axis=1).reshape(-1, UNIT, 9)
        if bits[:, :, 0].any():
            raise ValueError("bad code")
        out[where] = np.packbits(bits[:, :, 1:], axis=2).reshape(-1, PER_FRAME, UNIT)
    return out


@lru_cache(maxsize=1)
def _basis() -> np.ndarray:
    """Whole-number inverse transform of zigzag coefficients, times 4096."""
    order = sorted(((x, y) for x in range(8) for y in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    c = lambda k: np.sqrt(0.5) if k == 0 else 1.0
    grid = np.arange(8)
    wave = lambda k: np.cos((2 * grid + 1) * k * np.pi / 16) * c(k)
    return np.stack([np.rint(np.outer(wave(v), wave(u)).ravel() * 1024) for v, u in order])


def luminance_histograms(units: np.ndarray) -> np.ndarray:
    """(frame, BINS) counts of luminance, from payload bytes (frame, PER_FRAME, 192).

    All products and sums are whole numbers below 2**53, so no order of summation
    changes them and equal frames have equal histograms.
    """
    if len(units) > FRAMES:
        return np.concatenate([luminance_histograms(units[at : at + FRAMES]) for at in range(0, len(units), FRAMES)])
    y = units[:, :, :64].reshape(-1, 64).astype(np.float64)
    y -= 255.0 * (y < 128)
    pixel = np.clip(np.floor(y @ _basis() / 4096) + 128, 0, 255).astype(np.int64)
    slot = (pixel * BINS >> 8) + np.repeat(np.arange(len(units)) * BINS, PER_FRAME)[:, None]
    return np.bincount(slot.ravel(), minlength=len(units) * BINS).reshape(-1, BINS)


def shot_cuts(histograms: np.ndarray, memory: int = 8) -> list[int]:
    """Frames that begin a shot (not the first): where the share of pixels that change
    bins exceeds 0.1 and the mean of the shot's last ``memory`` differences by 2.5 deviations."""
    diff = (np.abs(np.diff(histograms, axis=0)).sum(1) / (2.0 * max(1, int(histograms[0].sum()) if len(histograms) else 1))).tolist()
    cuts, recent = [], []
    for i, d in enumerate(diff, 1):
        limit = 0.1
        if len(recent) >= 2:
            mean = sum(recent) / len(recent)
            limit = max(limit, mean + 2.5 * (sum((x - mean) ** 2 for x in recent) / len(recent)) ** 0.5)
        if d > limit:
            cuts.append(i)
            recent = []
        else:
            recent = [*recent[1 - memory :], d]
    return cuts


@dataclass(frozen=True)
class Read:
    """What is read back from a medium."""

    payload: bytes
    frames: int
    fps: float
    cuts: list[int]
    histograms: np.ndarray

    @property
    def feature(self) -> str:
        return _feature(self.cuts, self.histograms)


def _feature(cuts: list[int], histograms: np.ndarray) -> str:
    return f"frames={len(histograms)};cuts={' '.join(map(str, cuts))};hist={zlib.crc32(histograms.astype('<u4').tobytes()):08x}"


def read_avi(media: list[bytes]) -> list[Read]:
    """Decodes media together: payloads, shots, histograms."""
    found = [read_index(m) for m in media]
    units = decode_frames([m[a : a + n] for m, (places, _, _) in zip(media, found, strict=True) for a, n in places])
    hists = luminance_histograms(units)
    flat, out, at = units.reshape(len(units), -1), [], 0
    for places, length, fps in found:
        part = flat[at : at + len(places)]
        h = hists[at : at + len(places)]
        at += len(places)
        out.append(Read(part.tobytes()[: part.size if length is None else length], len(places), fps, shot_cuts(h), h))
    return out


@dataclass(frozen=True)
class Summary:
    """What is read back from a medium, without the payload itself."""

    payload_bytes: int
    payload_sha256: str
    tail_crc32: int
    frames: int
    fps: float
    cuts: list[int]
    feature: str


def _sliced(medium: bytes) -> Summary:
    """Reads a medium ``FRAMES`` frames at a time, with running digests."""
    places, length, fps = read_index(medium)
    left = len(places) * PER_FRAME * UNIT if length is None else length
    size, sha, tail, hists = 0, hashlib.sha256(), b"", [np.empty((0, BINS), np.int64)]
    for at in range(0, len(places), FRAMES):
        units = decode_frames([medium[a : a + n] for a, n in places[at : at + FRAMES]])
        hists.append(luminance_histograms(units))
        part = units.tobytes()[: left - size]
        sha.update(part)
        size += len(part)
        tail = (tail + part[-16:])[-16:]
    h = np.concatenate(hists)
    cuts = shot_cuts(h)
    return Summary(size, sha.hexdigest(), zlib.crc32(tail), len(places), fps, cuts, _feature(cuts, h))


def summaries(media: list[bytes]) -> list[Summary]:
    """Of media that are read together, or of one that is read slice by slice."""
    if len(media) == 1:
        return [_sliced(media[0])]
    return [Summary(len(r.payload), hashlib.sha256(r.payload).hexdigest(), zlib.crc32(r.payload[-16:]), r.frames, r.fps, r.cuts, _feature(r.cuts, r.histograms)) for r in read_avi(media)]


def _grouped(rows: list[tuple], size) -> Iterator[list[tuple]]:
    """Rows of some CHUNK bytes together; one that is as large by itself stands alone."""
    part, total = [], 0
    for r in rows:
        if part and size(r) >= CHUNK:
            yield part
            part, total = [], 0
        part.append(r)
        total += size(r)
        if total >= CHUNK or len(part) >= 1000:
            yield part
            part, total = [], 0
    if part:
        yield part


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, media (binary) for each row of ``docs(doc_id, text)``; a null text is stored as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in arrow_rows(batches, "doc_id", "text"):
            for part in _grouped(rows, lambda r: len(r[1] or "")):
                media = write_avi([padded((t or "").encode("utf-8", "replace")) for _, t in part])
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in part], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, media binary")


def clips(media: DataFrame) -> DataFrame:
    """doc_id, clip, first_frame, frames, start_s, end_s: a row for each shot of ``media(doc_id, media)``.

    A null medium has no clip; one that is not motion-JPEG AVI raises ValueError.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in arrow_rows(batches, "doc_id", "media"):
            for part in _grouped([r for r in rows if r[1] is not None], lambda r: len(r[1])):
                out = []
                for (d, _), r in zip(part, summaries([m for _, m in part]), strict=True):
                    edges = [0, *r.cuts, r.frames]
                    out += [(d, k, a, b - a, a / r.fps, b / r.fps) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=["doc_id", "clip", "first_frame", "frames", "start_s", "end_s"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, clip int, first_frame long, frames long, start_s double, end_s double")


def media_digests(docs: DataFrame) -> DataFrame:
    """Stores each whole text of ``docs(doc_id, text)`` as a medium and reads it back.

    doc_id, n_bytes (of the text), payload_bytes, payload_sha256 and tail_crc32
    (both as read back), media_bytes, media_sha256, feature.  A null text is
    stored as empty.  Rows are neither dropped nor merged.  Other columns are ignored.
    Of a long text the bytes and the medium are in memory; frames are coded and read in slices.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in arrow_rows(batches, "doc_id", "text"):
            for part in _grouped(rows, lambda r: len(r[1] or "")):
                sizes, payloads = [], []
                for _, t in part:
                    raw = (t or "").encode("utf-8", "replace")
                    sizes.append(len(raw))
                    payloads.append(padded(raw))
                    del raw
                media = write_avi(payloads)
                del payloads
                back = summaries(media)
                cols = [
                    pa.array([d for d, _ in part], pa.int64()), pa.array(sizes, pa.int64()), pa.array([b.payload_bytes for b in back], pa.int64()), pa.array([b.payload_sha256 for b in back]),
                    pa.array([b.tail_crc32 for b in back], pa.int64()), pa.array([len(m) for m in media], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media]), pa.array([b.feature for b in back]),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
