"""Shared helpers: the work folder, written intermediates, memoised word encoding."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own_dir: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one if it is unset and Spark runs on one machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="loom-work-"))
    return f"file://{_own_dir[0]}"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}"


class Written:
    """Tables that an operator has cut its lineage at; drop() removes those no longer needed."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.tag = spark, tag

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = new_path(self.spark, f"{self.tag}-{name}")
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._loom_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = getattr(t, "_loom_path", None)
            if path:
                hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


#: A space behind white space, and before white space or the end: only there can a token run across a space.
_INNER_SPACE = re.compile(r"\s (?:\s|\Z)")


def space_pieces(text: str) -> list[str] | None:
    """The text cut before each space (the space left out), if no token of the usual
    byte-level pre-tokenisation (words with one space before them, runs of white space)
    can run across those places; else None."""
    if _INNER_SPACE.search(text):
        return None
    return text.split(" ")


class Memo:
    """A bounded map from short pieces to their encoding: what it holds never changes a result.

    ``whole_if`` says of which texts no piece can be encoded on its own.
    """

    def __init__(self, encode: Callable[[list[str]], list], limit: int = 1 << 19, longest: int = 64, whole_if: Callable[[str], bool] = lambda t: False):
        self.encode, self.limit, self.longest, self.whole_if = encode, limit, longest, whole_if
        self.first: dict[str, object] = {}
        self.later: dict[str, object] = {}

    def whole(self, text: str) -> list:
        pieces = None if self.whole_if(text) else space_pieces(text)
        if pieces is None:
            return self.encode([text])
        got = list(map(self.later.get, pieces))
        got[0] = self.first.get(pieces[0])
        if None in got:
            gaps = [i for i, x in enumerate(got) if x is None]
            fresh: dict[tuple[bool, str], object] = {}
            for i in gaps:
                fresh.setdefault((i == 0, pieces[i]), None)
            keys = list(fresh)
            for key, value in zip(keys, self.encode([p if first else " " + p for first, p in keys]), strict=True):
                fresh[key] = value
                into = self.first if key[0] else self.later
                if len(key[1]) <= self.longest and len(into) < self.limit:
                    into[key[1]] = value
            for i in gaps:
                got[i] = fresh[i == 0, pieces[i]]
        return got


def arrow_rows(batches: Iterator, *columns: str, most: int = 500) -> Iterator[list[tuple]]:
    """The rows of Arrow batches as tuples of Python values, at most so many at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            part = batch.slice(at, most)
            yield list(zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in columns), strict=True))


class ByKey(dict):
    """A bounded map that computes what it does not hold; holding never changes a result."""

    def __init__(self, compute: Callable, limit: int = 1 << 19, longest: int = 64):
        super().__init__()
        self.compute, self.limit, self.longest = compute, limit, longest

    def __missing__(self, key):
        value = self.compute(key)
        if len(self) < self.limit and len(key) <= self.longest:
            self[key] = value
        return value


def spaced_slices(raw: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of bytes parted by spaces, slice after slice of about ``size`` bytes, so that a very long text needs little memory."""
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + size)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end + 1


def numbered(df: DataFrame, order: list, out: Written) -> DataFrame:
    """The rows with their place from 1 in the total order as ``rank``: written in ranges of that order, numbered
    within each and moved on by the sizes of the ranges before, so that no task holds more than a range."""
    part = "__loom_range"
    ranges = out.table(df.orderBy(*order).withColumn(part, F.spark_partition_id()), "ranges")
    sizes = sorted((r[0], r[1]) for r in ranges.groupBy(part).count().collect())  # one row a range
    before, starts = 0, []
    for p, n in sizes:
        starts.append((p, before))
        before += n
    offsets = df.sparkSession.createDataFrame(starts, f"{part} int, __loom_before long")
    place = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return ranges.withColumn("rank", place).join(F.broadcast(offsets), part).withColumn("rank", (F.col("rank") + F.col("__loom_before")).cast("long")).drop(part, "__loom_before")


def gives_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same function of a task, which hands the memory it has freed back to the system when it ends: Spark keeps
    Python workers for later tasks, and what they hold is missing in other stages of an executor."""

    @functools.wraps(run)
    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
            if trim is not None:
                trim(0)

    return task
