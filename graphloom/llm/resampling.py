"""Importance resampling towards a target distribution over a stored count matrix.

Every text becomes a sparse row of counts over ``buckets`` hash buckets; rows are
stored as CSR blocks (row pointers, column indices, counts) in a Parquet table.
The column sums of the documents' and the target's matrix are the two
distributions, their smoothed log ratio in thousandths is the gain of a bucket,
and the product of the matrix with the vector of gains is the weight of each
document.  Gumbel noise from a hash of the doc_id turns the highest scores into
a draw without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ByKey, Written, numbered, spaced_slices
from .quality import kth_largest

#: Bytes of words: digits, a-z and all of non-ASCII; A-Z are lower-cased, everything else parts words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BLOCK = "doc_ids array<long>, n_words array<long>, n_features array<long>, indptr array<long>, indices array<int>, counts array<long>"
_BLOCK_DOCS, _BLOCK_ENTRIES = 500, 1 << 18
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
_NAMES = [c.split()[0] for c in _BLOCK.split(", ")]


@dataclass(frozen=True)
class Resampling:
    """``max_n``: longest run of words that is a feature; ``percent`` of the documents with
    at least ``least_words`` words are drawn; ``seed`` goes into the noise."""

    max_n: int = 1
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 10
    seed: int = 2024


PRODUCTION = Resampling()


def bucket_counts(text: bytes | None, max_n: int, bucket: ByKey) -> tuple[int, Counter]:
    """Number of words of a whole text, and how often each bucket's features occur in it.

    Long texts are read in slices that overlap by max_n - 1 words.
    """
    counts: Counter = Counter()
    n, before = 0, []
    for words in spaced_slices((text or b"").translate(_FOLD)):
        counts.update(map(bucket.__getitem__, words))
        n += len(words)
        if max_n > 1:
            run = before + words
            for size in range(2, max_n + 1):
                first = max(0, len(before) - size + 1)
                counts.update(bucket[b" ".join(run[i : i + size])] for i in range(first, len(run) - size + 1))
            before = run[1 - max_n :]
    return n, counts


def count_matrix(docs: DataFrame, id_column: str | None, spec: Resampling) -> DataFrame:
    """The CSR blocks of ``docs``: doc_ids, n_words, n_features, indptr, indices, counts; a block has 500 documents at most."""

    def block(rows: list[tuple]) -> pa.RecordBatch:
        indptr = np.cumsum([0, *(len(c) for _, _, c in rows)])
        entries = [sorted(c.items()) for _, _, c in rows]
        columns = [
            [r[0] for r in rows],
            [r[1] for r in rows],
            [sum(r[2].values()) for r in rows],
            indptr.tolist(),
            [b for e in entries for b, _ in e],
            [k for e in entries for _, k in e],
        ]
        return pa.RecordBatch.from_arrays([pa.array([c], pa.list_(t)) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = ByKey(lambda feature: zlib.crc32(feature) % spec.buckets)
        rows, held = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                n, counts = bucket_counts(batch.column(1)[i].as_py(), spec.max_n, bucket)
                rows.append((batch.column(0)[i].as_py(), n, counts))
                held += len(counts)
                if len(rows) >= _BLOCK_DOCS or held >= _BLOCK_ENTRIES:
                    yield block(rows)
                    rows, held = [], 0
        if rows:
            yield block(rows)

    doc_id = F.col(id_column).cast("long") if id_column else F.lit(None).cast("long")
    return docs.select(doc_id.alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, _BLOCK)


def column_sums(matrix: DataFrame, buckets: int) -> np.ndarray:
    """Occurrences of each bucket's features in the whole matrix; a task adds up its blocks before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(total, batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy())
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["bucket", "n"])

    sums = matrix.select("indices", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) of each of the B buckets."""
    b = len(raw)
    all_raw, all_target = float(raw.sum() + b), float(target.sum() + b)
    return np.array([math.floor(1000 * math.log(((t + 1.0) * all_raw) / ((s + 1.0) * all_target))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(matrix: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: each row of the matrix times the vector of gains."""
    shared = matrix.sparkSession.sparkContext.broadcast(gains)  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, words, features, indptr, indices, counts = (batch.column(k)[i].values for k in range(6))
                products = np.concatenate(([0], np.cumsum(shared.value[indices.to_numpy()] * counts.to_numpy())))
                at = indptr.to_numpy()
                yield pa.RecordBatch.from_arrays([ids, words, features, pa.array(products[at[1:]] - products[at[:-1]])], names=["doc_id", "n_words", "n_features", "weight"])

    return matrix.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def _noise(seed: int) -> F.Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, spec: Resampling = PRODUCTION) -> DataFrame:
    """doc_id, n_features, weight, score, rank for each row of ``docs(doc_id, text)``, drawn to look like ``target(text)``.

    A null or empty text has no features and weight 0; it takes part in no draw, as
    no text under ``least_words`` does, and gets a score all the same.  rank counts
    the drawn rows from 1 by falling score, then doc_id (null last), weight and
    n_features; it is null for the others.  Repeated rows are rows of their own.
    An empty target leaves only its smoothing; an empty ``docs`` gives no rows.
    Other columns are ignored.
    """
    out = Written(docs.sparkSession, "resampling")
    aims = out.table(count_matrix(target, None, spec), "target")
    matrix = out.table(count_matrix(docs, "doc_id", spec), "matrix")
    gains = bucket_gains(column_sums(matrix, spec.buckets), column_sums(aims, spec.buckets))
    scored = out.table(weighed(matrix, gains).withColumn("score", F.col("weight") + _noise(spec.seed)), "scores")
    out.drop(aims, matrix)
    able = scored.filter(F.col("n_words") >= spec.least_words)
    k = spec.percent * able.count() // 100
    least = kth_largest(able, "score", k)
    high = (F.col("n_words") >= spec.least_words) & (F.col("score") >= F.lit(least))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features").desc()]
    drawn = numbered(scored.filter(high), order, out).withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    rest = scored.filter(~high).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def oracle_sql(spec: Resampling = PRODUCTION) -> str:
    """The same rows in DuckDB, with the checksum spelt out bit by bit (runs of one word)."""
    assert spec.max_n == 1
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
with step as (select list_transform(range(256), lambda n: list_reduce(list_prepend(n::bigint, range(8)), lambda c, i: case when c % 2 = 1 then xor(3988292384, c // 2) else c // 2 end)) as t),
d as (select row_number() over () as row, doc_id, {words} as w from documents),
b as (select {words} as w from benchmark),
vocabulary as (select distinct unnest(w) as word from (select w from d union all select w from b)),
bytes as (select word, list_transform(range(length(hex(word)) // 2), lambda i: 16 * (instr('0123456789ABCDEF', substr(hex(word), 2 * i + 1, 1)) - 1) + instr('0123456789ABCDEF', substr(hex(word), 2 * i + 2, 1)) - 1) as codes from vocabulary),
hashed as (select word, xor(list_reduce(list_prepend(4294967295::bigint, codes), lambda c, v: xor(t[(xor(c, v::bigint) % 256)::int + 1], c // 256)), 4294967295) % {spec.buckets} as bucket from bytes, step),
of_docs as (select row, bucket from (select row, unnest(w) as word from d) join hashed using (word)),
of_target as (select bucket from (select unnest(w) as word from b) join hashed using (word)),
s as (select bucket, count(*) as s from of_docs group by bucket),
t as (select bucket, count(*) as t from of_target group by bucket),
gains as (
  select bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::double * ((select count(*) from of_docs) + {spec.buckets})::double) / ((s + 1)::double * ((select count(*) from of_target) + {spec.buckets})::double)))::bigint as gain
  from s left join t using (bucket)),
weights as (select row, count(*) as n_features, sum(gain)::bigint as weight from of_docs join gains using (bucket) group by row),
h as (select row, list_reduce(list_prepend(0::bigint, list_transform(range(8), lambda i: (instr('0123456789abcdef', substr(sha256('{spec.seed}:' || doc_id), i + 1, 1)) - 1)::bigint)), lambda a, v: a * 16 + v) as h from d),
scored as (
  select doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score
  from d join h using (row) left join weights using (row)),
ordered as (select *, row_number() over (partition by n_features >= {spec.least_words} order by score desc, doc_id) as place, (select count(*) from scored where n_features >= {spec.least_words}) as n from scored)
select doc_id, n_features, weight, score, case when n_features >= {spec.least_words} and place <= {spec.percent} * n // 100 then place end as rank from ordered
"""
