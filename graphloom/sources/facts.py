"""Facts of source files kept between scans: only files that changed are read into facts again.

The store is a folder of two tables.  ``facts`` holds what batches of files gave,
``batches`` which file (by a digest of path, content and the kind of facts) was done in
which batch.  A batch's rows are written before its files are entered, so what a
lost job left behind belongs to no file and is never read; files without any fact
are entered like others.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions import lex
from .work import cut

#: Goes into the digest: facts of another version are not taken over.
VERSION = 1
_FACTS = "key string, batch string, path string, fact string, ordinal int, name string, value string"


def digest(path: F.Column, content: F.Column, architecture: bool) -> F.Column:
    return F.sha2(F.concat(F.lit(f"{VERSION}:{int(architecture)}:"), path, F.lit("\n"), content), 256)


def kept_facts(files: DataFrame, store: str, architecture: bool = False) -> tuple[DataFrame, int]:
    """The facts of ``files(path, content)`` as lex.facts() gives them, and how many files were lexed for it.

    Files without content give none.  Two scans at once may both lex a file; the batch
    that sorts first counts, so no fact comes twice.
    """
    spark = files.sparkSession
    keyed = cut(files.filter("path is not null and content is not null").select(digest(F.col("path"), F.col("content"), architecture).alias("key"), "path", "content").dropDuplicates(["key"]))

    def table(name: str, schema: str) -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(f"{store}/{name}")
        except AnalysisException:  # nothing is stored yet
            return spark.createDataFrame([], schema)

    done = table("batches", "key string, batch string")
    fresh = cut(keyed.join(done.select("key").distinct(), "key", "left_anti"))
    n = fresh.count()
    if n:
        batch = uuid.uuid4().hex
        keys = fresh.select("path", "key")
        made = lex.facts(fresh.select("path", "content"), architecture).join(keys, "path").withColumn("batch", F.lit(batch))
        made.select("key", "batch", "path", "fact", "ordinal", "name", "value").write.mode("append").parquet(f"{store}/facts")
        fresh.select("key", F.lit(batch).alias("batch")).write.mode("append").parquet(f"{store}/batches")
        done = table("batches", "key string, batch string")
    wanted = done.join(keyed.select("key"), "key", "left_semi").groupBy("key").agg(F.min("batch").alias("batch"))
    return table("facts", _FACTS).join(wanted, ["key", "batch"]).select("path", "fact", "ordinal", "name", "value"), n
