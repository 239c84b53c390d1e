"""Source trees and JSON documents as DataFrames, and their sinks."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Larger files are passed over and reported.
MOST_BYTES = 2 * 1024 * 1024
IGNORED = ["node_modules", ".git", "bin", "obj", "dist", "build", "coverage"]
TESTS = r"\.(test|spec)\.[^./]+\z|(\A|/)(__tests__|tests)/"


def scan(spark: SparkSession, root: str, extensions: list[str], ignored: list[str] | None = None) -> DataFrame:
    """path (below root), size, content of the files with one of the extensions.

    Folders with an ignored name are left out; content is null for files of more than MOST_BYTES.
    """
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*{" + ",".join(extensions) + "}").load(base)
    path = F.regexp_replace(F.regexp_replace("path", r"\A[a-z]+:/+", "/"), r"\A.*?" + _quoted(_plain(base)) + "/", "")
    named = files.select(path.alias("path"), F.col("length").alias("size"), F.when(F.col("length") <= MOST_BYTES, F.decode("content", "UTF-8")).alias("content"))
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    return named.filter(~F.arrays_overlap(folders, F.array(*map(F.lit, IGNORED if ignored is None else ignored))))


def _plain(path: str) -> str:
    return "/" + path.split(":", 1)[-1].lstrip("/") if ":" in path.split("/")[0] else path


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def is_test(path: Column) -> Column:
    return path.rlike(TESTS)


def skipped(files: DataFrame) -> DataFrame:
    """path, size of files that were too large to read."""
    return files.filter("content is null").select("path", "size")


def kinds(files: DataFrame, roots: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """kind, path, is_test for each named root (folder, extensions); a file may be of several kinds."""
    out = None
    for kind, (folder, extensions) in sorted(roots.items()):
        fits = F.lit(False)
        for e in extensions:
            fits = fits | F.col("path").endswith(e)
        one = files.filter(F.col("path").startswith(folder.rstrip("/") + "/") & fits).select(F.lit(kind).alias("kind"), "path", is_test(F.col("path")).alias("is_test"))
        out = one if out is None else out.union(one)
    if out is None:
        raise ValueError("no kinds")
    return out


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of graph documents in JSON (one document to a file)."""
    node = "id string, label string, type string, layer string, module string, path string"
    edge = "id string, `from` string, `to` string, type string, label string, confidence string, source string, evidence string"
    docs = spark.read.schema(f"nodes array<struct<{_fields(node)}>>, edges array<struct<{_fields(edge)}>>").json(path, multiLine=True)
    nodes = docs.select(F.explode("nodes").alias("n")).select("n.*")
    edges = docs.select(F.explode("edges").alias("e")).select("e.*").withColumnsRenamed({"from": "src", "to": "dst"})
    return nodes, edges


def _fields(ddl: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (part.strip().split(" ") for part in ddl.split(",")))


def write_json(path: str, value: object, force: bool = False) -> None:
    """One document, complete or not at all; an existing file is kept unless forced."""
    if os.path.exists(path) and not force:
        raise FileExistsError(path)
    handle, part = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(value, f, ensure_ascii=False, indent=2)
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, path)
    except BaseException:
        os.unlink(part)
        raise


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Nodes and edges as Parquet, each by Spark's committer."""
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").parquet(f"{folder}/edges")
