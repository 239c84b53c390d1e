"""Node writes from a stream, merged into a table of current nodes.

Each batch is merged with what is stored by the same last-write-wins rule as in a
whole scan, and written beside it under the batch's number; a pointer file is
swapped last, so a batch that is replayed after a failure gives the same table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def merged(current: DataFrame | None, batch: DataFrame, fields: list[str]) -> DataFrame:
    """(id, fields, seq_<field>): of each field the last value that is not null, and its sequence number."""
    latest = [F.max(F.when(F.col(f).isNotNull(), F.struct(F.col("seq").alias("q"), F.col(f).alias("v")))).alias(f) for f in fields]
    new = batch.groupBy("id").agg(*latest)
    if current is not None:
        old = current.select("id", *(F.when(F.col(f).isNotNull(), F.struct(F.col(f"seq_{f}").alias("q"), F.col(f).alias("v"))).alias(f) for f in fields))
        new = old.unionByName(new).groupBy("id").agg(*(F.max(f).alias(f) for f in fields))
    return new.select("id", *(F.col(f"{f}.v").alias(f) for f in fields), *(F.col(f"{f}.q").alias(f"seq_{f}") for f in fields))


class NodeTable:
    """The current nodes as numbered Parquet tables in one folder."""

    def __init__(self, spark: SparkSession, folder: str, fields: list[str]):
        self.spark, self.folder, self.fields = spark, folder.rstrip("/"), fields

    def _path(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the complete tables."""
        p, fs = self._path("")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(self._path(f"{n}/_SUCCESS")[0]))

    def read(self, before: int | None = None) -> DataFrame | None:
        """The last table, or the last one before a batch."""
        found = [v for v in self.versions() if before is None or v < before]
        return self.spark.read.parquet(f"{self.folder}/v{found[-1]}") if found else None

    def apply(self, batch: DataFrame, number: int) -> None:
        """Merges a batch; a number that was written before is written again from the same state."""
        merged(self.read(before=number), batch, self.fields).write.mode("overwrite").parquet(f"{self.folder}/v{number}")

    def follow(self, writes: DataFrame, checkpoint: str, configure: Callable = lambda w: w) -> StreamingQuery:
        """Starts a query that merges a stream of (id, fields, seq)."""
        return configure(writes.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)).start()
