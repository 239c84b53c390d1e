"""Writing to a graph as aggregations: node upserts, first-wins edges, admission of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULTS = {"type": "unknown", "layer": "unknown", "module": "shared"}


def upsert_nodes(writes: DataFrame, fields: list[str], seq: str = "seq") -> DataFrame:
    """One row for each id: of every field the last value that is not null.

    ``type`` and ``layer`` default to unknown, ``module`` to shared, ``label`` to the id.
    """
    last = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col(seq))).alias(f) for f in fields]
    out = writes.groupBy("id").agg(*last)
    for f in fields:
        default = F.col("id") if f == "label" else F.lit(DEFAULTS[f]) if f in DEFAULTS else None
        if default is not None:
            out = out.withColumn(f, F.coalesce(f, default.cast(out.schema[f].dataType)))
    return out


def first_edges(writes: DataFrame, seq: str = "seq") -> DataFrame:
    """Of all writes of an edge (src, type, dst) the first; empty and self edges are refused."""
    sound = writes.filter("src is not null and dst is not null and src <> '' and dst <> '' and src <> dst")
    rest = [c for c in writes.columns if c not in ("src", "dst", "type", seq)]
    first = sound.groupBy("src", "type", "dst").agg(F.min_by(F.struct(*(rest or ["src"])), seq).alias("f"))
    return first.select(F.concat_ws("::", "src", "type", "dst").alias("id"), "src", "dst", "type", *(F.col(f"f.{c}") for c in rest))


def admitted_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, end, missing) for each end of an edge that is no node."""
    ids = nodes.select(F.col("id").alias("missing"))
    ends = edges.select("id", F.explode(F.array(F.struct(F.lit("from").alias("end"), F.col("src").alias("missing")), F.struct(F.lit("to").alias("end"), F.col("dst").alias("missing")))).alias("x")).select("id", "x.end", "x.missing")
    return ends.join(ids, "missing", "left_anti").select("id", "end", "missing")


def validation_issues(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(code, subject) of everything wrong with a graph document; nothing fails fast."""
    issue = lambda df, code, c: df.select(F.lit(code).alias("code"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("subject"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    found = [issue(nodes.filter(blank(c)), f"NODE_{c.upper()}_EMPTY", "id") for c in ("id", "label", "type", "layer", "module")]
    found += [issue(edges.filter(blank(c)), f"EDGE_{c.upper()}_EMPTY", "id") for c in ("id", "src", "dst", "type")]
    found += [issue(df.groupBy("id").count().filter("count > 1"), f"{name}_DUPLICATE", "id") for df, name in ((nodes, "NODE"), (edges, "EDGE"))]
    found.append(issue(edges.filter("src = dst"), "EDGE_SELF", "id"))
    found.append(issue(edges.filter(F.col("id") != F.concat_ws("::", "src", "type", "dst")), "EDGE_ID", "id"))
    found.append(issue(dangling_edges(edges, nodes), "EDGE_ENDPOINT_MISSING", "missing"))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out
