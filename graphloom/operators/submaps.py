"""Bounded subgraphs as stored documents: whether they are sound, fit the graph, and what changed between two."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.work import cut
from .traverse import LEVELS, access_changes, changes


@dataclass(frozen=True)
class Stored:
    """A stored subgraph as tables.

    nodes(id, ..), edges(id, src, dst, ..), findings(id, node_id, ..), boundaries(edge_id,
    inside_id, outside_id), access(id, level), orphans(id), seeds(id), statistics(field, value).
    """

    nodes: DataFrame
    edges: DataFrame
    findings: DataFrame
    boundaries: DataFrame
    access: DataFrame
    orphans: DataFrame
    seeds: DataFrame
    statistics: DataFrame
    default_access: str = "readable"


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c) == "", F.lit(True))


def _issue(df: DataFrame, code: str, subject: str | None, detail: str | None) -> DataFrame:
    text = lambda c: F.lit(None).cast("string") if c is None else F.col(c).cast("string")
    return df.select(F.lit(code).alias("code"), text(subject).alias("subject"), text(detail).alias("detail"))


def _repeats(df: DataFrame, code: str) -> DataFrame:
    """An issue for each occurrence of an id after its first."""
    more = df.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    return _issue(more.select("id", F.explode(F.sequence(F.lit(2), F.col("n")))), code, "id", None)


def content_issues(s: Stored) -> DataFrame:
    """code, subject, detail of everything that contradicts itself in a stored subgraph.

    Ids that are null or empty are invalid and name nothing; each repeated occurrence of
    an id is an issue.  Edges, findings, orphans, seeds, boundaries and access name nodes
    that must be there; a boundary's edge and outer node must not.  Each node has one
    access level; levels that are unknown count for nothing.  Statistics must be the counts.
    All references are looked up in one join with the node ids.
    """
    nodes, edges = s.nodes.filter(~_blank("id")), s.edges.filter(~_blank("id"))
    ids = cut(nodes.select(F.col("id").alias("ref")).distinct())
    joined = s.edges.filter(~_blank("src") & ~_blank("dst"))
    levels = s.access.filter(F.col("level").isin(*LEVELS))
    outer = s.boundaries.filter(F.col("outside_id").isNotNull())
    refs = lambda df, code, subject, ref: _issue(df, code, subject, ref).withColumn("ref", F.col("detail"))
    # The codes that callers match.
    needed = [
        refs(joined.select("id", F.explode(F.array_distinct(F.array("src", "dst"))).alias("end")), "SUBMAP_EDGE_ENDPOINT_MISSING", "id", "end"),
        refs(s.findings.filter(~_blank("node_id")), "SUBMAP_FINDING_NODE_MISSING", "id", "node_id"),
        refs(s.orphans.filter("id is not null"), "SUBMAP_ORPHAN_NODE_MISSING", "id", "id"),
        refs(s.seeds, "SUBMAP_SEED_NODE_MISSING", "id", "id"),
        refs(outer, "SUBMAP_BOUNDARY_NODE_MISSING", "edge_id", "inside_id"),
        refs(levels, "SUBMAP_ACCESS_NODE_MISSING", "level", "id"),
    ]
    missing = reduce(DataFrame.union, needed).join(ids, "ref", "left_anti").select("code", "subject", "detail")
    ends = missing.filter("code = 'SUBMAP_EDGE_ENDPOINT_MISSING'").groupBy("code", "subject").agg(F.min("detail").alias("detail"))
    expected = [("nodes", s.nodes), ("edges", s.edges), ("findings", s.findings), ("boundaries", s.boundaries)]
    counts = reduce(DataFrame.union, [df.agg(F.lit(k).alias("field"), F.count("*").alias("expected")) for k, df in expected])
    given = levels.groupBy(F.col("level").alias("field")).agg(F.count("*").alias("n"))
    fields = levels.sparkSession.createDataFrame([(level,) for level in LEVELS], "field string")
    counts = counts.union(fields.join(given, "field", "left").select("field", F.coalesce("n", F.lit(0))))
    wrong = counts.join(s.statistics.select("field", F.col("value").alias("actual")), "field", "left").filter("not (actual <=> expected)")
    found = [
        _issue(s.nodes.filter(_blank("id")), "SUBMAP_INVALID_NODE_ID", None, None),
        _issue(s.edges.filter(_blank("id")), "SUBMAP_INVALID_EDGE_ID", None, None),
        _repeats(nodes, "SUBMAP_DUPLICATE_NODE_ID"),
        _repeats(edges, "SUBMAP_DUPLICATE_EDGE_ID"),
        _issue(s.edges.filter(_blank("src") | _blank("dst")), "SUBMAP_INVALID_EDGE_ENDPOINT", "id", None),
        ends,
        missing.filter("code <> 'SUBMAP_EDGE_ENDPOINT_MISSING'"),
        _issue(s.orphans.filter("id is null"), "SUBMAP_INVALID_ORPHAN_NODE_ID", None, None),
        _issue(s.boundaries.filter("outside_id is null"), "SUBMAP_INVALID_BOUNDARY", "edge_id", None),
        _issue(outer.join(ids.select(F.col("ref").alias("outside_id")), "outside_id", "left_semi"), "SUBMAP_BOUNDARY_OUTSIDE_INCLUDED", "edge_id", "outside_id"),
        _issue(outer.join(edges.select(F.col("id").alias("edge_id")).distinct(), "edge_id", "left_semi"), "SUBMAP_BOUNDARY_EDGE_INCLUDED", "edge_id", None),
        _repeats(levels, "SUBMAP_ACCESS_CONFLICT"),
        _issue(ids.join(levels.select(F.col("id").alias("ref")), "ref", "left_anti"), "SUBMAP_ACCESS_UNCLASSIFIED", "ref", None),
        _issue(wrong, "SUBMAP_STATISTICS_MISMATCH", "field", "expected"),
    ]
    if s.default_access not in LEVELS:
        found.append(_issue(fields.limit(1), "SUBMAP_ACCESS_DEFAULT_INVALID", None, None))
    return reduce(DataFrame.union, found)


def against_graph(s: Stored, nodes: DataFrame, edges: DataFrame, stored_digest: str | None = None, graph_digest: str | None = None) -> DataFrame:
    """severity, code, subject: stored items that the graph has no more (error) or has otherwise (warning).

    Items are compared over all the columns that both sides have, nulls equal.  With
    digests, an error if they differ.
    """

    def compared(kind: str, mine: DataFrame, theirs: DataFrame) -> DataFrame:
        same = [c for c in mine.columns if c in theirs.columns]
        value = lambda df, name: df.select("id", F.struct(*same).alias(name))
        both = value(mine, "a").join(value(theirs, "b").withColumn("there", F.lit(True)), "id", "left").filter("there is null or not (a <=> b)")
        gone = F.col("there").isNull()
        code = F.concat(F.lit(f"SUBMAP_SOURCE_{kind}_"), F.when(gone, "MISSING").otherwise("CHANGED"))
        return both.select(F.when(gone, "error").otherwise("warning").alias("severity"), code.alias("code"), F.col("id").alias("subject"))

    out = compared("NODE", s.nodes, nodes).union(compared("EDGE", s.edges, edges))
    if stored_digest != graph_digest:
        out = out.union(nodes.sparkSession.createDataFrame([("error", "SUBMAP_GRAPH_DIGEST_MISMATCH", stored_digest)], out.schema))
    return out


def finding_keys(findings: DataFrame) -> DataFrame:
    """id: rule, node, path, line and message of each finding, as one key."""
    part = lambda c, none: F.coalesce(F.col(c).cast("string"), F.lit(none)) if c in findings.columns else F.lit(none)
    return findings.select(F.concat_ws("::", part("rule_id", ""), part("node_id", ""), part("path", ""), part("line", "0"), part("message", "")).alias("id"))


def difference(before: Stored, after: Stored) -> DataFrame:
    """part, change, key: nodes, edges and findings added and removed, and nodes whose access changed (from>to)."""
    parts = [("node", before.nodes, after.nodes), ("edge", before.edges, after.edges), ("finding", finding_keys(before.findings), finding_keys(after.findings))]
    found = [changes(a, b).select(F.lit(k).alias("part"), "change", F.col("id").alias("key")) for k, a, b in parts]
    one = lambda s: s.access.filter(F.col("level").isin(*LEVELS)).groupBy("id").agg(F.max_by("level", F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))).alias("level"))
    moved = access_changes(one(before), one(after))
    step = F.concat(F.coalesce("previous", F.lit("")), F.lit(">"), F.coalesce("current", F.lit("")))
    return reduce(DataFrame.union, found).union(moved.select(F.lit("access"), step, "id"))


def difference_summary(before: Stored, after: Stored) -> DataFrame:
    """One row: counts of each change, boundaries before and after, deltas of the perimeter, and whether anything changed."""
    n = lambda name, where: F.count_if(F.expr(where)).alias(name)
    counted = [n(f"{p}s_{c}", f"part = '{p}' and change = '{c}'") for p in ("node", "edge", "finding") for c in ("added", "removed")]
    edge = lambda df, when: df.select(F.lit("boundary"), F.lit(when), F.col("edge_id"))
    rows = difference(before, after).union(edge(before.boundaries, "before")).union(edge(after.boundaries, "after"))
    bounds = [n(f"boundaries_{when}", f"part = 'boundary' and change = '{when}'") for when in ("before", "after")]
    total = rows.agg(*counted, n("access_changes", "part = 'access'"), *bounds, F.coalesce(F.bool_or(F.col("part") != "boundary"), F.lit(False)).alias("changed"))
    return total.select("*", (F.col("nodes_added") - F.col("nodes_removed")).alias("node_delta"), (F.col("edges_added") - F.col("edges_removed")).alias("edge_delta"))


def inspected(s: Stored) -> DataFrame:
    """module, n_nodes of a stored subgraph, modules in order; nodes without a module are left out."""
    return s.nodes.filter(~_blank("module")).groupBy("module").agg(F.count("*").alias("n_nodes")).orderBy("module")


def same_selection(left: DataFrame, right: DataFrame) -> bool:
    """Whether two selections hold the same ids."""
    return changes(left, right).first() is None


def merged_paths(first: Column, second: Column) -> Column:
    """Two ways, one after the other, each id where it stands first."""
    return F.array_distinct(F.concat(first, second))
