"""Token-id files: one concatenated id array with Elias-Fano document boundaries.

Layout of a shard (all little-endian)::

    magic "LOOMEF01"
    ids            n_tokens x (u16 if every id of the vocabulary fits, else u32)
    Elias-Fano     end offset of each document within the shard
    Elias-Fano     document ids, less the smallest
    footer         struct _FOOTER, magic again

A non-decreasing sequence of n values below u takes about 2 + log2(u / n) bits a
value: the low bits are packed, the high bits are unary-coded in a bit vector
with a position sample every ``SAMPLE`` ones, by which ``select`` finds any one
value without reading the others.  No 64-bit offset table is kept anywhere.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, new_path

MAGIC = b"LOOMEF01"
SAMPLE = 256
_HEAD = struct.Struct("<QQIIII")  # n, universe, low bits, bytes of low, bytes of high, samples
#: n_docs, n_tokens, bytes an id, documents without id, smallest id, place of ends, place of doc ids
_FOOTER = struct.Struct("<QQIQqQQ")
#: About as much text (and 16 bytes a document beside) as a shard holds at most, unless one document is longer.
SHARD_BYTES = 128 << 20


class EliasFano:
    """A non-decreasing sequence of integers from 0 on, with random access."""

    def __init__(self, n: int, universe: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.universe, self.low_bits, self.low, self.high, self.samples = n, universe, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n, universe = len(v), int(v[-1]) + 1 if len(v) else 0
        bits = max(0, (universe // n).bit_length() - 1) if n else 0
        upper = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n, dtype=np.int64)
        high = np.zeros(int(upper[-1]) // 8 + 1 if n else 0, dtype=np.uint8)
        np.bitwise_or.at(high, upper >> 3, (1 << (upper & 7)).astype(np.uint8))
        planes = ((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        return cls(n, universe, bits, np.packbits(planes.ravel(), bitorder="little"), high, upper[::SAMPLE].astype(np.uint32))

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, at >> 3
        word = int(self.high[byte]) >> (at & 7) << (at & 7)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        pos = byte * 8 + (word & -word).bit_length() - 1
        value, first = pos - i << self.low_bits, i * self.low_bits
        for b in range(self.low_bits):
            value |= (int(self.low[(first + b) >> 3]) >> ((first + b) & 7) & 1) << b
        return value

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n].astype(np.int64)
        out = ones - np.arange(self.n) << self.low_bits
        if self.low_bits:
            planes = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little").reshape(self.n, self.low_bits)
            out = out + planes.astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))
        return out

    def to_bytes(self) -> bytes:
        head = _HEAD.pack(self.n, self.universe, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, universe, bits, a, b, c = _HEAD.unpack_from(raw)
        at = _HEAD.size
        return cls(n, universe, bits, np.frombuffer(raw, np.uint8, a, at), np.frombuffer(raw, np.uint8, b, at + a), np.frombuffer(raw, "<u4", c, at + a + b))


class ShardWriter:
    """Streams one shard; the id array never stays in memory."""

    def __init__(self, out, id_bytes: int):
        self.out, self.kind, self.ends, self.doc_ids, self.nulls, self.total = out, f"<u{id_bytes}", [], [], 0, 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.out.write(ids.astype(self.kind).tobytes())
        self.total += len(ids)
        self.ends.append(self.total)
        if doc_id is None:
            self.nulls += 1
        else:
            self.doc_ids.append(doc_id)

    def close(self) -> None:
        size = int(self.kind[-1])
        least = self.doc_ids[0] if self.doc_ids else 0
        ends = EliasFano.of(np.array(self.ends, dtype=np.int64)).to_bytes()
        doc_ids = EliasFano.of(np.array([d - least for d in self.doc_ids], dtype=np.uint64)).to_bytes()
        first = len(MAGIC) + self.total * size
        self.out.write(ends + doc_ids)
        self.out.write(_FOOTER.pack(len(self.ends), self.total, size, self.nulls, least, first, first + len(ends)) + MAGIC)


class ShardReader:
    """Random access to a shard's documents."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail = source.read_at(_FOOTER.size + len(MAGIC), size - _FOOTER.size - len(MAGIC))
        if tail[-len(MAGIC) :] != MAGIC or source.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError("not a token-id shard")
        self.n_docs, self.n_tokens, self.id_bytes, self.nulls, self.least, ends, doc_ids = _FOOTER.unpack_from(tail)
        self.ends = EliasFano.from_bytes(source.read_at(doc_ids - ends, ends))
        self.doc_ids = EliasFano.from_bytes(source.read_at(size - len(tail) - doc_ids, doc_ids))

    def start(self, i: int) -> int:
        return self.ends.select(i - 1) if i else 0

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.least + self.doc_ids.select(i - self.nulls)

    def ids(self, start: int, stop: int) -> np.ndarray:
        raw = self.source.read_at((stop - start) * self.id_bytes, len(MAGIC) + start * self.id_bytes)
        return np.frombuffer(raw, f"<u{self.id_bytes}")

    def document(self, i: int) -> np.ndarray:
        return self.ids(self.start(i), self.ends.select(i))


@lru_cache(maxsize=2)
def _worker_memo(path: str) -> tuple[Memo, int]:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    added = [t.content for t in library.get_added_tokens_decoder().values() if t.content]
    marks = re.compile("|".join(map(re.escape, added))) if added else None

    def encode(pieces: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype="<u4").tobytes() for x in library.encode_batch_fast(pieces, add_special_tokens=False)]

    # A text that spells out an added token goes to the library as it is.
    return Memo(encode, limit=7 << 17, whole_if=lambda t: marks is not None and marks.search(t) is not None), library.get_vocab_size(with_added_tokens=True)


def shard_count(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> int:
    """How many shards documents take: as many as their counted bytes fill, and no fewer than the shuffle has partitions."""
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16)).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 0, shard_bytes: int = SHARD_BYTES) -> list[tuple[str, int, int]]:
    """Writes ``docs(doc_id, text)`` to shards in ``folder``; returns (file, documents, tokens) in order.

    Documents stand in ascending doc_id, first those without one; equal doc_ids
    by text.  A null text counts as empty, so it holds ``end_id`` alone.  The
    return value holds one row per shard, never one per document.

    Each task writes to a name of its own and renames it when complete, so lost
    executors and repeated attempts leave no half-written shard behind; what
    attempts that died have left under their own names is deleted at the end.
    The number of shards follows the bytes of all texts, which are counted first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        memo, vocabulary = _worker_memo(tokenizer_path)
        end = np.array([end_id], dtype="<u4").tobytes()
        name, writer, n = f"shard-{TaskContext.get().partitionId():09d}.ids", None, 0
        fs, base = pafs.FileSystem.from_uri(folder)
        part = f"{base}/_{name}.{uuid.uuid4().hex}"
        for batch in batches:
            for doc_id, text in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(part)
                    writer = ShardWriter(out, 2 if max(vocabulary, end_id + 1) <= 1 << 16 else 4)
                raw = b"".join(memo.whole(text)) if text else b""
                writer.add(doc_id, np.frombuffer(raw + end, dtype="<u4"))
                n += 1
        if writer is not None:
            writer.close()
            out.close()
            fs.move(part, f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([writer.total], pa.int64())], names=["file", "docs", "tokens"])

    parts = shard_count(docs, shard_bytes)
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    shards = sorted(map(tuple, ordered.mapInArrow(run, "file string, docs long, tokens long").collect()))
    _delete_parts(docs.sparkSession, folder)
    return shards


def _delete_parts(spark: SparkSession, folder: str) -> None:
    """Deletes the unfinished files of attempts that died; those of an attempt still at work fail with it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(path) if fs.exists(path) else []:
        if status.getPath().getName().startswith("_shard-"):
            fs.delete(status.getPath(), False)


def read_token_files(spark: SparkSession, folder: str, shards: list[tuple[str, int, int]], block: int = 1 << 20) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each stored document, from the files.

    ``start`` counts the ids of all documents before it, over all shards.  Files
    are read in blocks of about ``block`` ids, their boundaries and doc_ids by
    select.  No shards: an empty table.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not shards:
        return spark.createDataFrame([], schema)
    before, rows = 0, []
    for file, _, tokens in shards:
        rows.append((file, before))
        before += tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, first in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                with fs.open_input_file(f"{base}/{file}") as source:
                    shard = ShardReader(source)
                    start = i = 0
                    while i < shard.n_docs:
                        ends: list[int] = []
                        while i + len(ends) < shard.n_docs and (not ends or ends[-1] - start < block):
                            ends.append(shard.ends.select(i + len(ends)))
                        raw = memoryview(shard.ids(start, ends[-1]).astype("<u4").tobytes())
                        starts = [start, *ends[:-1]]
                        crcs = [zlib.crc32(raw[(a - start) * 4 : (b - start) * 4]) for a, b in zip(starts, ends, strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([shard.doc_id(i + k) for k in range(len(ends))], pa.int64()), pa.array([first + x for x in starts], pa.int64()), pa.array([b - a for a, b in zip(starts, ends, strict=True)], pa.int64()), pa.array(crcs, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )
                        i, start = i + len(ends), ends[-1]

    listed = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "file string, first long")
    return listed.mapInArrow(run, schema)


def stored_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Writes the documents to token-id files in the work folder and reads them back."""
    spark = docs.sparkSession
    folder = new_path(spark, "token-ids")
    return read_token_files(spark, folder, write_token_files(docs, tokenizer_path, folder, end_id))
