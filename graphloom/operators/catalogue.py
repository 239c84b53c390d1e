"""Stored subgraphs in a shared folder: which are sound, lookup by uid, and deletion of all revisions at once.

A stored subgraph is one file ``*.submap.json``, here one row ``(file, text)``.  Deletions are tables beside the
folder, each naming the files that it hides; the rename that puts such a table in its place makes a deletion
effective as a whole, so a driver that dies between two steps leaves all revisions or none.  On stores where a
folder cannot be renamed in one step (object stores without a rename) this does not hold.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..plans.documents import ACCESS, submap_uid
from ..sources.work import cut, dealt, drop

# What a document must hold, in the order in which it is checked, and the codes that callers match.
KIND = "code-map/submap"
UID = r"\Asha256:[a-f0-9]{64}\z"
RECORDS = [("source", "SUBMAP_SOURCE_MISSING"), ("selection", "SUBMAP_SELECTION_MISSING"), ("access", "SUBMAP_ACCESS_MISSING"), ("catalog", "SUBMAP_CATALOG_MISSING"), ("statistics", "SUBMAP_STATISTICS_MISSING"), ("metadata", "SUBMAP_METADATA_MISSING")]
ARRAYS = [("nodes", "SUBMAP_INVALID_NODES"), ("edges", "SUBMAP_INVALID_EDGES"), ("findings", "SUBMAP_INVALID_FINDINGS"), ("orphanNodeIds", "SUBMAP_INVALID_ORPHANS"), ("boundaries", "SUBMAP_INVALID_BOUNDARIES"), ("warnings", "SUBMAP_INVALID_WARNINGS")]


class Removed(NamedTuple):
    id: str
    deleted: int
    version: str


def _at(tree: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(tree, f"$.{path}", kind)


def _is(tree: Column, path: str, kind: str) -> Column:
    """Whether there is a value of a kind of JSON: OBJECT, ARRAY, STRING or NUMBER."""
    named = F.schema_of_variant(_at(tree, path))
    fits = named.rlike(r"\A(BIGINT|DOUBLE|FLOAT|DECIMAL)") if kind == "NUMBER" else named.startswith(kind)
    return F.coalesce(fits, F.lit(False))


def _text(tree: Column, path: str) -> Column:
    return F.when(_is(tree, path, "STRING"), _at(tree, path, "string"))


def _list(tree: Column, path: str) -> Column:
    return F.coalesce(F.when(_is(tree, path, "ARRAY"), _at(tree, path, "array<variant>")), F.array().cast("array<variant>"))


def _strings(tree: Column, path: str) -> Column:
    """The members of a list; null for those that are no strings."""
    return F.transform(_list(tree, path), lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))


def _lacks(known: Column, wanted: Column) -> Column:
    return F.size(F.array_except(wanted, known)) > 0


def _whole(tree: Column, path: str, least: int) -> Column:
    value = _at(tree, path, "double")
    return F.coalesce(_is(tree, path, "NUMBER") & (value == F.floor(value)) & (value >= least), F.lit(False))


def _shape_codes(tree: Column) -> Column:
    parent = F.coalesce(F.is_variant_null(_at(tree, "parentUid")), F.lit(True)) | F.coalesce(_text(tree, "parentUid").rlike(UID), F.lit(False))
    objects = [(~_is(tree, name, "OBJECT"), code) for name, code in RECORDS]
    lists = [(~_is(tree, name, "ARRAY"), code) for name, code in ARRAYS]
    return _codes(
        (~F.coalesce(_text(tree, "kind") == KIND, F.lit(False)), "SUBMAP_INVALID_KIND"),
        (~(_whole(tree, "schemaVersion", 1) & (_at(tree, "schemaVersion", "double") == 1)), "SUBMAP_SCHEMA_INCOMPATIBLE"),
        (F.coalesce(F.trim(_text(tree, "id")) == "", F.lit(True)), "SUBMAP_INVALID_ID"),
        (~_whole(tree, "revision", 1), "SUBMAP_INVALID_REVISION"),
        (~parent, "SUBMAP_INVALID_PARENT_UID"),
        (F.try_to_timestamp(_text(tree, "createdAt")).isNull(), "SUBMAP_INVALID_CREATED_AT"),
        *objects,
        *lists,
        (_is(tree, "selection", "OBJECT") & ~_is(tree, "selection.resolvedSeedNodeIds", "ARRAY"), "SUBMAP_INVALID_RESOLVED_SEEDS"),
    )


def _codes(*checks: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*(F.when(F.coalesce(wrong, F.lit(False)), F.lit(code)) for wrong, code in checks)))


def _content_codes(tree: Column) -> Column:
    """What contradicts itself in a document of the right shape, each code once, in the order of the checks."""
    ids = lambda items: F.transform(items, lambda x: F.nullif(_text(x, "id"), F.lit("")))
    nodes, edges = ids(_list(tree, "nodes")), ids(_list(tree, "edges"))
    known, edge_ids = F.array_compact(nodes), F.array_compact(edges)
    repeated = lambda c: F.size(c) > F.size(F.array_distinct(c))
    record = lambda x: F.schema_of_variant(x).startswith("OBJECT")
    items, found, bounds = (F.filter(_list(tree, p), record) for p in ("edges", "findings", "boundaries"))
    end = lambda name: F.transform(items, lambda x: F.nullif(_text(x, name), F.lit("")))
    ends = F.transform(F.arrays_zip(end("from").alias("a"), end("to").alias("b")), lambda x: F.when(x["a"].isNotNull() & x["b"].isNotNull(), F.array(x["a"], x["b"])))
    sound = F.filter(bounds, lambda x: _is(x, "outsideNode", "OBJECT"))
    levels, before = [], F.array().cast("array<string>")
    for level in ACCESS:
        named = _strings(tree, f"access.{level}")
        levels.append((~_is(tree, f"access.{level}", "ARRAY"), "SUBMAP_ACCESS_INVALID"))
        levels.append((_lacks(known, named), "SUBMAP_ACCESS_NODE_MISSING"))
        levels.append((repeated(named) | (F.size(F.array_intersect(before, named)) > 0), "SUBMAP_ACCESS_CONFLICT"))
        before = F.concat(before, named)
    counts = {p: F.size(_list(tree, p)) for p in ("nodes", "edges", "findings", "boundaries")} | {level: F.size(_list(tree, f"access.{level}")) for level in ACCESS}
    miscounted = F.lit(False)
    for name, n in counts.items():
        miscounted = miscounted | ~F.coalesce(_is(tree, f"statistics.{name}", "NUMBER") & (_at(tree, f"statistics.{name}", "double") == n), F.lit(False))
    orphans = _strings(tree, "orphanNodeIds")
    codes = _codes(
        (F.exists(nodes, F.isnull), "SUBMAP_INVALID_NODE_ID"),
        (repeated(known), "SUBMAP_DUPLICATE_NODE_ID"),
        (F.exists(edges, F.isnull), "SUBMAP_INVALID_EDGE_ID"),
        (repeated(edge_ids), "SUBMAP_DUPLICATE_EDGE_ID"),
        (F.exists(ends, F.isnull), "SUBMAP_INVALID_EDGE_ENDPOINT"),
        (_lacks(known, F.flatten(F.array_compact(ends))), "SUBMAP_EDGE_ENDPOINT_MISSING"),
        (~F.coalesce(_text(tree, "access.default").isin(*ACCESS), F.lit(False)), "SUBMAP_ACCESS_DEFAULT_INVALID"),
        *levels,
        (_lacks(before, known), "SUBMAP_ACCESS_UNCLASSIFIED"),
        (F.size(found) < F.size(_list(tree, "findings")), "SUBMAP_INVALID_FINDING"),
        (_lacks(known, F.filter(F.transform(found, lambda x: _at(x, "nodeId", "string")), lambda i: i != "")), "SUBMAP_FINDING_NODE_MISSING"),
        (F.exists(orphans, F.isnull), "SUBMAP_INVALID_ORPHAN_NODE_ID"),
        (_lacks(known, F.array_compact(orphans)), "SUBMAP_ORPHAN_NODE_MISSING"),
        (F.size(sound) < F.size(_list(tree, "boundaries")), "SUBMAP_INVALID_BOUNDARY"),
        (_lacks(known, F.transform(sound, lambda x: _text(x, "insideNodeId"))), "SUBMAP_BOUNDARY_NODE_MISSING"),
        (F.arrays_overlap(edge_ids, F.array_compact(F.transform(sound, lambda x: _text(x, "edgeId")))), "SUBMAP_BOUNDARY_EDGE_INCLUDED"),
        (F.arrays_overlap(known, F.array_compact(F.transform(sound, lambda x: _text(x, "outsideNode.id")))), "SUBMAP_BOUNDARY_OUTSIDE_INCLUDED"),
        (_lacks(known, _strings(tree, "selection.resolvedSeedNodeIds")), "SUBMAP_SEED_NODE_MISSING"),
        (miscounted, "SUBMAP_STATISTICS_MISMATCH"),
    )
    return F.array_distinct(codes)


@F.pandas_udf(StringType())
def _computed_uid(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else submap_uid(json.loads(t)))


def judged(texts: DataFrame) -> DataFrame:
    """file, id, name, uid, revision, parent_uid, created_at, project, kind, n_nodes, n_edges, status, issues of ``(file, text)``.

    ``issues`` are the codes of all that is wrong, each once: a text that is no JSON, null or
    empty has SUBMAP_INVALID_JSON alone, a document of the wrong shape its faults of shape, else
    those of content, uid and digest.  Invalid files have the id ``invalid:<file>``, their file as
    name and nulls beside.  Repeated rows stay; a null file is an invalid row of the empty name.
    Names that stand twice in an object make it unreadable.
    """
    parsed = texts.select(F.coalesce("file", F.lit("")).alias("file"), "text", F.try_parse_json("text").alias("tree"))
    tree = F.col("tree")
    shaped = parsed.withColumn("shape", F.when(tree.isNull(), F.array(F.lit("SUBMAP_INVALID_JSON"))).when(~F.schema_of_variant(tree).startswith("OBJECT"), F.array(F.lit("SUBMAP_INVALID_DOCUMENT"))).otherwise(_shape_codes(tree)))
    right = F.size("shape") == 0
    computed = shaped.withColumn("computed", _computed_uid(F.when(right, F.col("text"))))
    digest = F.coalesce(_text(tree, "source.graphDigest").rlike(UID), F.lit(False))
    last = _codes((~F.coalesce(_text(tree, "uid") == F.col("computed"), F.lit(False)), "SUBMAP_UID_MISMATCH"), (~digest, "SUBMAP_SOURCE_DIGEST_MISSING"))
    whole = computed.withColumn("issues", F.when(right, F.concat(_content_codes(tree), last)).otherwise(F.col("shape")))
    valid = F.size("issues") == 0
    kept = lambda c, name: F.when(valid, c).alias(name)
    count = lambda p: F.size(_list(tree, p)).cast("long")
    return whole.select(
        "file", F.when(valid, _text(tree, "id")).otherwise(F.concat(F.lit("invalid:"), "file")).alias("id"),
        F.when(valid, F.coalesce(_at(tree, "metadata.name", "string"), _text(tree, "id"))).otherwise(F.col("file")).alias("name"),
        kept(_text(tree, "uid"), "uid"), kept(_at(tree, "revision", "long"), "revision"), kept(_text(tree, "parentUid"), "parent_uid"), kept(_text(tree, "createdAt"), "created_at"),
        kept(_at(tree, "source.projectName", "string"), "project"), kept(F.coalesce(_at(tree, "metadata.kind", "string"), F.lit("selection")), "kind"),
        kept(count("nodes"), "n_nodes"), kept(count("edges"), "n_edges"), F.when(valid, "valid").otherwise("invalid").alias("status"), "issues",
    )


def catalogue(texts: DataFrame) -> DataFrame:
    """All stored subgraphs, by name as people order names, the newest revision first, then by file.

    Judging costs far more than reading, so texts are dealt over all tasks and judged once, before they are ordered.
    """
    return cut(judged(dealt(texts, 1_000))).orderBy(F.collate("name", "UNICODE"), F.coalesce("revision", F.lit(0)).desc(), "file")


def by_uid(texts: DataFrame, uid: str) -> DataFrame:
    """file, text of the valid subgraph with the uid, at most one row (the first file); ValueError for what is no uid.

    Only texts that hold the uid are parsed.
    """
    if not re.fullmatch(r"sha256:[a-f0-9]{64}", uid):
        raise ValueError("a uid is sha256: and 64 hex digits")
    near = texts.filter(F.contains("text", F.lit(uid)))
    files = judged(near).filter((F.col("status") == "valid") & (F.col("uid") == uid)).select(F.min("file").alias("file"))
    return near.join(files, "file").select("file", "text").limit(1)


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def _moved(spark: SparkSession, old: str, new: str) -> None:
    fs, start = _fs(spark, old)
    _, end = _fs(spark, new)
    fs.mkdirs(end.getParent())
    if not fs.rename(start, end):
        raise OSError(f"cannot rename {old} to {new}")


def _gone(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def _deletions(folder: str) -> str:
    return folder.rstrip("/") + ".deleted"


def _hidden(spark: SparkSession, folder: str) -> DataFrame:
    base = _deletions(folder)
    versions = [s.getPath().toString() for s in _fs(spark, base)[0].listStatus(_fs(spark, base)[1])] if _exists(spark, base) else []
    # Hidden names start with an underscore: tables that are not in their place yet, or no more.
    kept = [v for v in versions if not v.rpartition("/")[2].startswith("_")]
    return spark.read.schema("file string").parquet(*kept) if kept else spark.createDataFrame([], "file string")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """file, text of the stored subgraphs of a folder that no deletion hides; a folder that is not there holds none."""
    if not _exists(spark, folder):
        return spark.createDataFrame([], "file string, text string")
    read = spark.read.option("pathGlobFilter", "*.submap.json").text(folder, wholetext=True)
    named = read.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    return named.join(_hidden(spark, folder).distinct(), "file", "left_anti")


def remove(spark: SparkSession, folder: str, uid: str) -> Removed:
    """Deletes every valid revision of the subgraph with the uid, all or none; LookupError if there is none.

    Files that are not valid stay.  Until purge() the files are hidden only, and restore() brings them back.
    """
    stored = texts(spark, folder)
    target = by_uid(stored, uid)
    row = judged(target).select("id").first()
    if row is None:
        raise LookupError("no stored submap has this uid")
    revisions = cut(judged(stored).filter((F.col("status") == "valid") & (F.col("id") == row["id"])).select("file"))
    version = uuid.uuid4().hex
    part = f"{_deletions(folder)}/_{version}"
    revisions.write.parquet(part)
    n = revisions.count()
    _moved(spark, part, f"{_deletions(folder)}/{version}")
    drop(revisions)
    return Removed(row["id"], n, version)


def restore(spark: SparkSession, folder: str, version: str) -> None:
    """Takes a deletion back, as a whole; LookupError if it is not there (any more)."""
    place, aside = f"{_deletions(folder)}/{version}", f"{_deletions(folder)}/_{version}"
    if version.startswith("_") or "/" in version or not version or not _exists(spark, place):
        raise LookupError("no such deletion")
    _moved(spark, place, aside)
    _gone(spark, aside)


def purge(spark: SparkSession, folder: str) -> int:
    """Deletes the hidden files themselves, in tasks; returns their number.  A purge that breaks off can be repeated."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as pafs

        system, base = pafs.FileSystem.from_uri(where)
        for batch in batches:
            for file in batch["file"]:
                if system.get_file_info(f"{base}/{file}").type != pafs.FileType.NotFound:
                    system.delete_file(f"{base}/{file}")
            yield batch

    fs, path = _fs(spark, folder)
    where = fs.makeQualified(path).toString().replace("file:/", "file:///").replace("file://///", "file:///")
    base = _deletions(folder)
    versions = [s.getPath().getName() for s in fs.listStatus(_fs(spark, base)[1])] if _exists(spark, base) else []
    n = _hidden(spark, folder).distinct().mapInPandas(run, "file string").count()
    for version in versions:
        _gone(spark, f"{base}/{version}")
    return n
