"""The shared work folder and tables that cut a plan's lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one where it is unset and Spark runs on one machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="loom-work-"))
    return f"file://{_own[0]}"


def cut(df: DataFrame, *by: str) -> DataFrame:
    """The same rows read back from a written table, in folders by some columns if any are named, so that loops keep short plans and lost executors cost little."""
    path = f"{work_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df = df.select(*(c for c in df.columns if c not in by), *by) if by else df  # as they are read, also if there are no rows and so no folders
    df.write.partitionBy(*by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._loom_path = path  # type: ignore[attr-defined]
    return out


def written(df: DataFrame) -> DataFrame:
    """The table itself if cut() has written it, else what cut() makes of it."""
    return df if getattr(df, "_loom_path", None) else cut(df)


def drop(*tables: DataFrame) -> None:
    """Removes tables that cut() has written and that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_loom_path", None):
            hadoop = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def dealt(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """The same rows in parts of about ``rows``, for work on rows that costs far more than reading them: a small file is one part, however long its rows take."""
    spark = df.sparkSession
    most = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = min(most, -(-df.count() // rows))
    return df.repartition(parts) if parts > df.rdd.getNumPartitions() else df
