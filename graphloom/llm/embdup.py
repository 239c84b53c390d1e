"""Near-duplicate embeddings: p-stable hashing in several tables, then exact cosines.

A vector, scaled to length 1, is projected on Gaussian directions; each
projection is shifted and cut into cells of ``WIDTH``.  ``CELLS`` cells make a
bucket, and there are ``TABLES`` independent tables.  Two vectors whose cosine is
0.93 are 0.374 apart and share a cell with a chance of 0.80, so they meet in some
bucket with a chance above 0.98, and more similar ones sooner; see the tests for
the recall measured against brute force.

Only vectors that share a bucket are compared, in double precision, and a linked
pair counts in the first table where it meets, so that no pair is ever listed.
Equal vectors count as one with a multiplicity.  Buckets of over ``BLOCK``
vectors are compared block by block, so no task holds more than two blocks, and
within two blocks ``TILE`` rows at a time.  A bucket of n vectors is dealt out
n / BLOCK times.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from .common import Written

TABLES = 48
CELLS = 10
WIDTH = 1.5
BLOCK = 2048
TILE = 512


@lru_cache(maxsize=8)
def _directions(dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([4711, dim])
    return rng.standard_normal((dim, TABLES * CELLS)), rng.uniform(0, WIDTH, TABLES * CELLS), rng.integers(1, 1 << 31, (TABLES, CELLS)) | 1


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, in double precision, without overflow on the way."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def bucket_codes(x: np.ndarray) -> np.ndarray:
    """For each unit row an int32 code of its cells in each table."""
    a, shift, mult = _directions(x.shape[1])
    cells = np.floor((x @ a + shift) / WIDTH).astype(np.int64).reshape(len(x), TABLES, CELLS)
    mixed = (cells * mult).sum(2) * 0x9E3779B1
    return (mixed ^ mixed >> 17).astype(np.uint32).view(np.int32)


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.flatten() if hasattr(column, "flatten") else column.values
    return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _codes(classes: DataFrame) -> DataFrame:
    """Adds the codes of each class; batches are cut by vector size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            for size in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                codes = bucket_codes(unit(_vectors(part.column(2))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(codes), pa.list_(pa.int32()))], names=["rep", "codes"])

    return classes.select("rep", "dim", "vec").mapInArrow(run, "rep long, codes array<int>")


def _spread(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the lowest row that it is connected to."""
    n = len(linked)
    label = np.arange(n)
    while True:
        near = [np.where(linked[at : at + TILE], label[None, :], n).min(1) for at in range(0, n, TILE)]
        lower = np.minimum(label, np.concatenate(near))
        lower = np.minimum(lower, lower[lower])
        if (lower == label).all():
            return label
        label = lower


def _compare(rows: dict[str, np.ndarray], table: int, cross: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Within one group: how many vectors each row links to here, and whom it is joined to."""
    x, codes, side, n = rows["unit"], rows["codes"], rows["side"], len(rows["rep"])
    linked = np.zeros((n, n), bool)
    for at in range(0, n, TILE):
        tile = np.triu(x[at : at + TILE] @ x[at:].T >= least, 1)
        if cross:
            tile &= side[at : at + TILE, None] != side[None, at:]
        a, b = np.nonzero(tile)
        for k in range(0, len(a), 1 << 16):
            i, j = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
            tile[i, j] = (codes[at + i] == codes[at + j]).argmax(1) == table
        linked[at : at + TILE, at:] = tile
    linked |= linked.T
    counts = np.concatenate([linked[at : at + TILE] @ rows["mult"] for at in range(0, n, TILE)])
    return counts, _spread(linked) if n > 2 else np.where(linked.any(1), 0, np.arange(n))


def _links(members: DataFrame, least: float) -> DataFrame:
    """rep, n, other: what each group adds to a class's links, and a joined class if any.

    ``members`` must be dealt out and sorted by (grp, sub); a group may go on over batches.
    """

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, sub = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (sub[1:] != sub[:-1])) + 1
            if held and (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) != (int(key[0]), int(sub[0])):
                yield pa.Table.from_batches(held)
                held = []
            if not len(cuts):
                held.append(batch)
                continue
            yield pa.Table.from_batches([*held, batch.slice(0, int(cuts[0]))])
            if len(cuts) > 1:
                yield pa.Table.from_batches([batch.slice(int(cuts[0]), int(cuts[-1] - cuts[0]))])
            held = [batch.slice(int(cuts[-1]))]
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches):
            t = t.combine_chunks()
            key, sub = t.column("grp").to_numpy(), t.column("sub").to_numpy()
            ends = np.append(np.flatnonzero((key[1:] != key[:-1]) | (sub[1:] != sub[:-1])) + 1, len(key))
            all_rows = {c: t.column(c).to_numpy() for c in ("rep", "mult", "side", "tab", "blocks")}
            all_rows["unit"], all_rows["codes"] = unit(_vectors(t.column("vec").chunk(0))), np.array(t.column("codes").chunk(0).flatten()).reshape(len(key), -1)
            reps, counts, others, start = [], [], [], 0
            for end in ends:
                if end - start > 1:
                    rows = {k: v[start:end] for k, v in all_rows.items()}
                    cross = bool(sub[start] // rows["blocks"][0] != sub[start] % rows["blocks"][0])
                    n, to = _compare(rows, int(rows["tab"][0]), cross, least)
                    hit = np.flatnonzero(n)
                    reps.append(rows["rep"][hit])
                    counts.append(n[hit])
                    others.append(rows["rep"][to[hit]])
                start = end
            if reps:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (reps, counts, others)], names=["rep", "n", "other"])

    return members.select("grp", "sub", "rep", "mult", "side", "tab", "blocks", "vec", "codes").mapInArrow(run, "rep long, n long, other long")


def similar_vectors(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors(vec_id, embedding, label)``.

    Rows with equal labels (not null) and a cosine of ``least`` or more are
    linked.  n_links: other rows linked directly; component_id: smallest vec_id
    reachable, itself included; kept: component_id is its own.  A vector that is
    null, empty, zero or holds a null, NaN or infinite component, one without
    label and one without vec_id link with nothing (0 links; kept true), and
    vectors of different lengths never link.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    out = Written(spark, "embdup")
    element = vectors.schema["embedding"].dataType
    if not isinstance(element, T.ArrayType):
        raise TypeError("embedding must be an array")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    sound = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine, F.lit(False))
    prints = [F.when(sound, F.xxhash64(F.lit(s), "label", "embedding")).alias(f"f{s}") for s in (1, 2)]
    rows = vectors.select("vec_id", "label", "embedding", *prints)
    found = rows.filter("f1 is not null").groupBy("f1", "f2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.first("label").alias("label"), F.first("embedding").alias("vec"))
    classes = out.table(found.withColumn("dim", F.size("vec")), "classes")

    codes = out.table(_codes(classes), "codes")
    keyed = classes.select("rep", "label", "dim").join(codes, "rep").select("rep", "label", "dim", F.posexplode("codes").alias("tab", "code"))
    keyed = keyed.select("rep", "tab", F.xxhash64("label", "dim", "tab", "code").alias("grp"))
    sizes = keyed.groupBy("grp").agg(F.count("*").alias("size")).filter("size > 1")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = keyed.join(sizes, "grp").select("grp", "tab", "rep", blocks.alias("blocks"), F.pmod(F.xxhash64(F.lit(3), "rep"), blocks).cast("int").alias("side"))
    dealt = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
    dealt = dealt.select("grp", "tab", "rep", "blocks", "side", (F.least("side", "b") * F.col("blocks") + F.greatest("side", "b")).alias("sub"))
    full = dealt.join(classes.select("rep", "mult", "vec").join(codes, "rep"), "rep")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    members = full.repartition(parts, "grp", "sub").sortWithinPartitions("grp", "sub")
    links = out.table(_links(members, least), "links")

    counts = links.groupBy("rep").agg(F.sum("n").alias("n"))
    comp = connected_components(links.select(F.col("rep").alias("u"), F.col("other").alias("v")), out.table, out.drop)
    named = classes.select("f1", "f2", "rep", "mult").join(counts, "rep", "left").join(comp, F.col("rep") == F.col("node"), "left")
    named = named.select("f1", "f2", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    joined = rows.select("vec_id", "f1", "f2").join(named, ["f1", "f2"], "left")
    own = F.coalesce("component", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(own == F.col("vec_id"), F.lit(True)).alias("kept"))
