"""Byte-level BPE encoding and decoding by a rank queue.

Every pre-token is encoded on its own.  Its bytes form a linked list; each
adjacent pair that the rank table can merge is put, by its position, into the
bucket of its merge rank.  A two-level bitmap marks the non-empty buckets, so
find-first-set gives the lowest rank in two steps, whatever the length of the
pre-token; entries whose pair has gone meanwhile are skipped when met.  Cost is
O(n log n) for n bytes, where rescanning for the best pair is O(n^2).

Pieces between spaces are memoised, since most of a text consists of few words; that
holds for patterns that let a token begin with one space (``SPACED``), and any other
pattern has its texts encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Memo, arrow_rows

SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_GROUP = 8  # bits of a rank that index within one word of the lower bitmap
_MASK = (1 << _GROUP) - 1


class BytePairCodec:
    """Encoder and decoder for a rank table (bytes -> rank, which is also the id)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.bytes_of = {rank: token for token, rank in ranks.items()}

    @classmethod
    def load(cls, path: str, pattern: str) -> BytePairCodec:
        with open(path, "rb") as f:
            return cls({base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}, pattern)

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        nxt = list(range(1, n + 1))
        prv = list(range(-1, n))
        pair_rank = [-1] * n  # rank of the pair that starts at a position, -1 if none or gone
        buckets: dict[int, list[int]] = {}
        low: dict[int, int] = {}
        high = 0
        get = ranks.get
        for i in range(n - 1):
            r = get(piece[i : i + 2])
            if r is not None:
                pair_rank[i] = r
                if r in buckets:
                    buckets[r].append(i)  # ascending, so still a heap
                else:
                    buckets[r] = [i]
                    g = r >> _GROUP
                    low[g] = low.get(g, 0) | 1 << (r & _MASK)
                    high |= 1 << g
        while high:
            g = (high & -high).bit_length() - 1
            word = low[g]
            r = g << _GROUP | (word & -word).bit_length() - 1
            bucket = buckets[r]
            i = heappop(bucket)
            if not bucket:
                del buckets[r]
                low[g] = word = word & (word - 1)
                if not word:
                    high &= high - 1
            if pair_rank[i] != r:
                continue  # stale: the pair was merged away or has grown
            j = nxt[i]
            pair_rank[j] = -1
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
            for left, right in ((i, k), (prv[i], i)):
                if left < 0 or right >= n:
                    if left >= 0:
                        pair_rank[left] = -1
                    continue
                s = get(piece[left : nxt[right]])
                if s is None:
                    pair_rank[left] = -1
                    continue
                pair_rank[left] = s
                if s in buckets:
                    heappush(buckets[s], left)
                else:
                    buckets[s] = [left]
                    g = s >> _GROUP
                    low[g] = low.get(g, 0) | 1 << (s & _MASK)
                    high |= 1 << g
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : nxt[i]]])
            i = nxt[i]
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, each match of the pattern encoded separately."""
        return [i for m in self.pattern.findall(text) for i in self.encode_piece(m.encode("utf-8", "replace"))]

    def decode(self, ids: list[int]) -> bytes:
        """The bytes that the ids stand for; an unknown id raises KeyError."""
        return b"".join([self.bytes_of[i] for i in ids])


class _Digests:
    """Per piece: decimal ids joined by spaces, their number, the bytes decoded from them."""

    def __init__(self, codec: BytePairCodec):
        self.codec = codec
        self.tokens: dict[str, list[int]] = {}

    def __call__(self, pieces: list[str]) -> list[tuple[str, int, bytes]]:
        codec, known, out = self.codec, self.tokens, []
        for piece in pieces:
            ids: list[int] = []
            for m in codec.pattern.findall(piece):
                got = known.get(m)
                if got is None:
                    got = codec.encode_piece(m.encode("utf-8", "replace"))
                    if len(m) <= 48 and len(known) < 1 << 19:
                        known[m] = got
                ids += got
            out.append((" ".join(map(str, ids)), len(ids), codec.decode(ids)))
        return out


@lru_cache(maxsize=2)
def _worker_memo(path: str, pattern: str) -> Memo:
    return Memo(_Digests(BytePairCodec.load(path, pattern)), whole_if=lambda t: pattern != SPACED)


class _Ids:
    """Per piece its ids as little-endian int32 bytes, which keep small in a memo."""

    def __init__(self, codec: BytePairCodec, limit: int):
        self.codec, self.limit = codec, limit
        self.known: dict[str, bytes] = {}

    def __call__(self, pieces: list[str]) -> list[bytes]:
        codec, known, out = self.codec, self.known, []
        for piece in pieces:
            parts = []
            for m in codec.pattern.findall(piece):
                got = known.get(m)
                if got is None:
                    got = np.array(codec.encode_piece(m.encode("utf-8", "replace")), "<i4").tobytes()
                    if len(m) <= 48 and len(known) < self.limit:
                        known[m] = got
                parts.append(got)
            out.append(b"".join(parts))
        return out


@lru_cache(maxsize=2)
def _worker_ids(path: str, pattern: str) -> Memo:
    return Memo(_Ids(BytePairCodec.load(path, pattern), 1 << 16), limit=1 << 16, whole_if=lambda t: pattern != SPACED)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """All columns of ``docs`` (``out`` replaced if present) plus ``out``: array<int> of token ids.

    A null text counts as empty and gives an empty array.  Rows are neither
    dropped nor merged, so repeated rows stay.  One narrow pass, no shuffle.
    """
    kept = [c for c in docs.columns if c != out]
    schema = T.StructType([f for f in docs.schema.fields if f.name != out] + [T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _worker_ids(ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = [b"".join(memo.whole(t)) if t else b"" for t in part.column(part.schema.get_field_index(text)).to_pylist()]
                ends = np.concatenate(([0], np.cumsum([len(r) // 4 for r in raw]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), "<i4")))
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), ids], names=[*kept, out])

    return docs.select(*kept, *([text] if text == out else [])).mapInArrow(run, schema)


def token_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of ``docs(doc_id, text)``.

    Encodes each whole text and decodes the ids again.  Null text: as the empty
    text (no ids; both digests are of the empty string).  A null doc_id is kept.
    Repeated rows give repeated results; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _worker_memo(ranks_path, pattern)
        for rows in arrow_rows(batches, "doc_id", "text"):
            out: tuple[list, list, list, list] = ([], [], [], [])
            for doc_id, text in rows:
                parts = [p for p in memo.whole(text) if p[1]] if text else []
                out[0].append(doc_id)
                out[1].append(sum([p[1] for p in parts]))
                out[2].append(hashlib.sha256(" ".join([p[0] for p in parts]).encode()).hexdigest())
                out[3].append(hashlib.sha256(b"".join([p[2] for p in parts])).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
