"""Registered query over stored subgraphs: a document for each customer, in eight forms, most of them with a fault."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalogue
from .cgraph import table
from .sources import _query

DOCUMENT = (
    '{"access":{"default":"readable","editable":["c<c>"],"external":[],"forbidden":[],"generated":[],"readable":["n<n>"]},"boundaries":[],"catalog":{},"edges":[{"from":"c<c>","id":"e<c>","to":"<to>"}],"findings":[],'
    '"id":"map<k>","kind":"code-map/submap","metadata":{"name":"Map <k>"},"nodes":[{"id":"c<c>"},{"id":"n<n>"}],"orphanNodeIds":[],"parentUid":null,"revision":<r>,"schemaVersion":1,'
    '"selection":{"resolvedSeedNodeIds":["c<c>"]},"source":{"graphDigest":"sha256:' + "ab" * 32 + '","graphVersion":1,"projectName":"p"}}'
)
HEAD = '{"uid":"sha256:<uid>","createdAt":"2024-01-02T03:04:05.678Z","statistics":{"nodes":<count>,"edges":1,"findings":0,"boundaries":0,"editable":1,"readable":1,"external":0,"forbidden":0,"generated":0},"warnings":[],'


def stored_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, text of every document."""
    c = F.col("c_custkey")
    form = c % 8
    values = {"c": c, "n": F.col("c_nationkey"), "k": c % 100, "r": F.when(form == 6, 0).otherwise(F.floor(c / 100) + 1), "to": F.when(form == 4, "zz").otherwise(F.concat(F.lit("n"), F.col("c_nationkey")))}
    document, head = F.lit(DOCUMENT), F.lit(HEAD)
    for name, value in values.items():
        document = F.replace(document, F.lit(f"<{name}>"), value.cast("string"))
    uid = F.when(form == 5, F.repeat(F.lit("0"), F.lit(64))).otherwise(F.sha2("document", 256))
    head = F.replace(F.replace(head, F.lit("<uid>"), uid), F.lit("<count>"), F.when(form == 7, "3").otherwise("2"))
    text = F.concat(head, F.substring("document", 2, 1 << 20))
    named = table(spark, sf_dir, "customer").withColumn("document", document)
    return named.select(F.concat(F.lit("f"), c.cast("string"), F.lit(".submap.json")).alias("file"), F.when(form == 3, F.substring(text, 1, 300)).otherwise(text).alias("text"))


def _written(document: str) -> str:
    """The document's text as SQL."""
    parts = {"<c>": "c_custkey", "<n>": "c_nationkey", "<k>": "c_custkey % 100", "<r>": "c_custkey // 100 + 1", "<to>": "concat('n', c_nationkey)"}
    out = f"'{document}'"
    for name, value in parts.items():
        out = out.replace(name, f"', {value}, '")
    return f"concat({out})"


@_query(f"""SELECT concat('f', c_custkey, '.submap.json') AS file, CASE WHEN form < 3 THEN concat('map', c_custkey % 100) ELSE concat('invalid:f', c_custkey, '.submap.json') END AS id,
CASE WHEN form < 3 THEN concat('Map ', c_custkey % 100) ELSE concat('f', c_custkey, '.submap.json') END AS name, CASE WHEN form < 3 THEN concat('sha256:', sha256({_written(DOCUMENT)})) END AS uid,
CASE WHEN form < 3 THEN CAST(c_custkey // 100 + 1 AS BIGINT) ELSE 0 END AS revision, CASE WHEN form < 3 THEN CAST(2 AS BIGINT) ELSE 0 END AS n_nodes, CASE WHEN form < 3 THEN 'valid' ELSE 'invalid' END AS status,
CASE form WHEN 3 THEN 'SUBMAP_INVALID_JSON' WHEN 4 THEN 'SUBMAP_EDGE_ENDPOINT_MISSING' WHEN 5 THEN 'SUBMAP_UID_MISMATCH' WHEN 6 THEN 'SUBMAP_INVALID_REVISION' WHEN 7 THEN 'SUBMAP_STATISTICS_MISMATCH' ELSE '' END AS issues
FROM (SELECT *, c_custkey % 8 AS form FROM customer) x""")
def stored_submaps(spark, sf_dir):
    """Which stored documents are sound, and what is wrong with the others."""
    number = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return catalogue.catalogue(stored_texts(spark, sf_dir)).select("file", "id", "name", "uid", number("revision"), number("n_nodes"), "status", F.array_join("issues", ",").alias("issues"))
