"""Quality selection by importance resampling.

Two generative models of hashed n-grams (single tokens and pairs of neighbours,
``BUCKETS`` hash buckets) are estimated: one of target text, from documents
labelled as good, and one of raw text, from all documents, its counts scaled to
the size of the target's so that adding one smooths both alike.  A document's log weight is the sum over its n-grams of the log ratio of the two.
Adding independent Gumbel noise to the log weights and taking the k largest
draws k documents without replacement in proportion to their weights.

k is the number of documents that look like the target: those whose log weight
reaches a level.  A quarter of the labelled documents sets it and takes no part in
the model: the level that all but ``1 - keep`` of the good ones reach, lowered half
way to the median of the bad ones, though by ``MARGIN`` at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Written, gives_back
from .neardup import _BYTE, _mix, _powers

BUCKETS = 1 << 16
MARGIN = 16.0
_NOISE = "__loom_noise"

_KIND = np.ones(256, np.uint8)  # 0 space, 1 word, 2 other signs
_KIND[:128] = 2
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), 95]] = 1
_KIND[[32, *range(9, 14)]] = 0
_AGAIN = np.uint64(0x5851F42D4C957F2D)


@dataclass(frozen=True)
class Selection:
    """``labelled``: bound on the labelled rows used (about as many, drawn by a hash of
    doc_id); ``keep``: share of the labelled good ones that should look like the target."""

    labelled: int = 20_000
    keep: float = 0.998
    seed: int = 1


def ngram_buckets(text: str | None) -> np.ndarray:
    """The bucket of every n-gram of the whole text: runs of letters, digits and signs,
    A-Z lower-cased, then pairs; a pair of equal tokens is one and the same event."""
    if not text:
        return np.zeros(0, np.int64)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    kind = np.concatenate(([0], _KIND[raw], [0]))
    edge = np.flatnonzero(kind[1:] != kind[:-1])
    if not len(edge):
        return np.zeros(0, np.int64)
    power, inverse = _powers(len(raw) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * power[: len(raw)])))
    starts, ends = edge[:-1], edge[1:]
    real = kind[starts + 1] != 0
    starts, ends = starts[real], ends[real]
    one = _mix((sums[ends] - sums[starts]) * inverse[starts])
    two = np.where(one[:-1] == one[1:], _AGAIN, _mix(one[:-1] * np.uint64(0xD6E8FEB86659FD93) + one[1:]))
    return (np.concatenate((one, two)) >> np.uint64(48)).astype(np.int64)


def log_weight(ratios: np.ndarray, text: str | None) -> tuple[float, int]:
    """Log weight (the sum of the log ratios of its n-grams) and number of n-grams of a whole text."""
    buckets = ngram_buckets(text)
    return float(ratios[buckets].sum()), len(buckets)


def labelled_sample(labels: DataFrame, selection: Selection) -> dict[int, int]:
    """doc_id -> quality of about ``selection.labelled`` rows; the lowest quality of a doc_id counts."""
    rows = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = rows.count()
    unit = (F.xxhash64(F.lit(23), "doc_id") % (1 << 20) + (1 << 20)) / (1 << 21)
    if n > selection.labelled:
        rows = rows.filter(unit < selection.labelled / n)
    t = rows.toArrow()
    return dict(zip(t.column("doc_id").to_pylist(), t.column("quality").to_pylist(), strict=True))


def calibrates(doc_id: int) -> bool:
    """Whether a labelled document sets the level (a quarter of them) instead of the model."""
    return (doc_id * 2654435761 >> 7) % 4 == 0


def log_ratios(docs: DataFrame, good: frozenset[int]) -> np.ndarray:
    """The log ratio of target to raw model of each bucket; counts cover all documents."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at in range(0, len(ids), 200):
                buckets = [ngram_buckets(t) for t in batch.column(1).slice(at, 200).to_pylist()]
                raw += np.bincount(np.concatenate(buckets), minlength=BUCKETS)
                mine = [b for i, b in zip(ids[at : at + 200], buckets, strict=True) if i in good]
                if mine:
                    target += np.bincount(np.concatenate(mine), minlength=BUCKETS)
        hit = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(raw[hit]), pa.array(target[hit])], names=["bucket", "raw", "target"])

    counts = docs.select("doc_id", "text").mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    model = {}
    for kind in ("raw", "target"):
        model[kind] = np.zeros(BUCKETS)
        model[kind][counts.column("bucket").to_numpy()] = counts.column(kind).to_numpy()
    expected = model["raw"] * (model["target"].sum() / max(1, model["raw"].sum()))
    return np.log((model["target"] + 1) / (expected + 1))


def _noise(seed: int) -> F.Column:
    """Gumbel noise from a hash of the doc_id."""
    unit = (F.xxhash64(F.lit(seed), F.lit("gumbel"), "doc_id") % (1 << 40) + (1 << 40) + 0.5) / (1 << 41)
    return -F.log(-F.log(unit))


def kth_largest(values: DataFrame, column: str, k: int, collect: int = 20_000) -> float:
    """The exact k-th largest value, by histograms ever finer; no sort, no more than ``collect`` values collected."""
    lo, hi, n = values.agg(F.min(column), F.max(column), F.count(column)).first()
    if k <= 0 or not n:
        return float("inf")
    if k >= n:
        return lo
    bins, above = 2048, 0
    while True:
        inside = values.filter(F.col(column).between(lo, hi))
        if n <= collect or lo == hi:
            break
        width = (hi - lo) / bins
        slot = F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1))
        found = {r["s"]: r for r in inside.groupBy(slot.alias("s")).agg(F.count("*").alias("c"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()}
        for s in sorted(found, reverse=True):
            if above + found[s]["c"] >= k:
                lo, hi, n = found[s]["lo"], found[s]["hi"], found[s]["c"]
                break
            above += found[s]["c"]
    if lo == hi:
        return lo
    return sorted((r[0] for r in inside.select(column).collect()), reverse=True)[k - above - 1]


def _scored(docs: DataFrame, ratios: np.ndarray, sample: dict[int, int], seed: int) -> DataFrame:
    """doc_id, n_grams, log_weight, score (with noise), label (of those that calibrate) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast((ratios, sample))

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, known = shared.value
        for batch in batches:
            found = [log_weight(r, t.as_py()) for t in batch.column(1)]
            weight = np.array([w for w, _ in found])
            ids = batch.column(0)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([n for _, n in found], pa.int64()), pa.array(weight), pa.array(weight + batch.column(2).to_numpy()), pa.array([known.get(i) if i is not None and calibrates(i) else None for i in ids.to_pylist()], pa.int32())],
                names=["doc_id", "n_grams", "log_weight", "score", "label"],
            )

    return docs.select("doc_id", "text", _noise(seed).alias(_NOISE)).mapInArrow(run, "doc_id long, n_grams long, log_weight double, score double, label int")


def _fitted(docs: DataFrame, labels: DataFrame, selection: Selection) -> tuple[np.ndarray, dict[int, int], DataFrame, float]:
    """Log ratios, labelled sample, scored rows and the least score that is selected."""
    sample = labelled_sample(labels, selection)
    ratios = log_ratios(docs, frozenset(d for d, q in sample.items() if q > 0 and not calibrates(d)))
    scored = Written(docs.sparkSession, "quality").table(_scored(docs, ratios, sample, selection.seed), "scores")
    judged = scored.filter("label is not null and n_grams > 0").select("label", "log_weight").collect()
    good, bad = (sorted(w for q, w in judged if (q > 0) == side) for side in (True, False))
    if not good:
        return ratios, sample, scored, float("-inf")
    level = good[int((1 - selection.keep) * len(good))]
    if bad and bad[len(bad) // 2] < level:
        level = max((level + bad[len(bad) // 2]) / 2, level - MARGIN)
    k = scored.filter(F.col("log_weight") >= level).count()
    return ratios, sample, scored, kth_largest(scored, "score", k)


def select_quality(docs: DataFrame, labels: DataFrame, selection: Selection = Selection()) -> DataFrame:  # noqa: B008
    """doc_id, n_grams, log_weight, score, kept for each row of ``docs(doc_id, text)``.

    A null or blank text has no n-gram and log weight 0.  Rows that tie with the
    last one selected are selected too, so repeated rows share their fate.  With
    no labelled good document nothing is rejected.  A row without doc_id takes
    part like any other.  Other columns are ignored.
    """
    _, _, scored, least = _fitted(docs, labels, selection)
    return scored.select("doc_id", "n_grams", "log_weight", "score", (F.col("score") >= least).alias("kept"))


def keep_quality(docs: DataFrame, labels: DataFrame, selection: Selection = Selection()) -> DataFrame:  # noqa: B008
    """The rows of ``docs`` that are selected, with all their columns.

    Texts are scored once more where they lie instead of being shuffled or stored.
    """
    ratios, _, _, least = _fitted(docs, labels, selection)
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    columns = docs.columns
    at = columns.index("text")

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = np.array([log_weight(shared.value, t.as_py())[0] for t in batch.column(at)])
            kept = batch.filter(pa.array(weight + batch.column(len(columns)).to_numpy() >= least, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(i) for i in range(len(columns))], names=columns)

    return docs.select("*", _noise(selection.seed).alias(_NOISE)).mapInArrow(run, T.StructType(docs.schema.fields))
