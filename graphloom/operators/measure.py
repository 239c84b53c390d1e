"""Orphans, quality, coverage, module roll-ups, reports: aggregations over a graph."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clamp, round_half_up

#: Node kinds that are scored, those that tests should cover, and relations between modules.
SCORED = ["component", "main-component", "subcomponent", "page", "route", "hook", "service", "repository", "controller", "query", "command", "handler"]
COVERABLE = ["route", "page", "main-component", "component", "subcomponent", "hook", "service", "repository", "store", "front-file"]
MODULE_EDGES = ["imports", "lazy-imports", "calls-api", "sends", "handled-by", "depends-on"]


def is_entry(entry_paths: list[str], suffixes: list[str]) -> Column:
    """Nodes that need no caller: configured paths, backend suffixes, tables."""
    out = (F.col("type") == "table") | F.coalesce(F.col("path").isin(entry_paths), F.lit(False))
    for s in suffixes:
        out = out | F.coalesce(F.col("path").endswith(s), F.lit(False))
    return out


def orphans(nodes: DataFrame, edges: DataFrame, entry_paths: list[str], suffixes: list[str]) -> DataFrame:
    """Nodes of the kinds that should be used, without any incoming edge, that are no entry points."""
    kinds = nodes.filter(F.col("type").isin([*SCORED, "entity", "table"]) & ~is_entry(entry_paths, suffixes))
    return kinds.join(edges.select(F.col("dst").alias("id")), "id", "left_anti").select("id", "label", "type", "module", "path")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree of every node."""
    both = edges.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(edges.select("src", F.lit(0), F.lit(1)))
    counts = both.groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    return nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("i", F.lit(0)).alias("in_degree"), F.coalesce("o", F.lit(0)).alias("out_degree"))


def quality_evidence(nodes: DataFrame, edges: DataFrame, folder: str, entry_paths: list[str], suffixes: list[str]) -> DataFrame:
    """What quality is judged by, for the scored kinds; relations to entities and tables don't count.

    ``folder`` is a path fragment in which {module} stands for the node's module.
    """
    plain = nodes.filter(~F.col("type").isin("entity", "table")).select("id", "module")
    end = lambda a, b: plain.select(F.col("id").alias(a), F.col("module").alias(b))
    kept = edges.select("src", "dst").join(end("src", "src_module"), "src").join(end("dst", "dst_module"), "dst")
    side = lambda a, b, out: F.struct(F.col(a).alias("id"), F.col(f"{a}_module").alias("own"), F.col(f"{b}_module").alias("other"), F.lit(out).alias("out"))
    related = kept.select(F.inline(F.array(side("dst", "src", 0), side("src", "dst", 1))))  # a union would join twice
    away = F.col("own") != F.col("other")
    counts = related.groupBy("id").agg(
        F.count_if(~away).alias("internal"), F.count_if(away).alias("external"), F.count_if(F.col("out") == 1).alias("outgoing"), F.count_if(F.col("out") == 0).alias("incoming"),
        F.count_distinct(F.when(away & (F.col("out") == 1) & (F.col("other") != "shared"), F.col("other"))).alias("external_modules"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    inside = F.coalesce(F.contains(F.col("path"), F.replace(F.lit(folder), F.lit("{module}"), F.col("module"))), F.lit(False))
    scored = nodes.filter(F.col("type").isin(SCORED)).select("id", inside.alias("in_folder"), is_entry(entry_paths, suffixes).alias("entry_point"))
    return scored.join(counts, "id", "left").select("id", *(zero(c) for c in ("internal", "external", "outgoing", "incoming", "external_modules")), "in_folder", "entry_point")


def quality_scores(evidence: DataFrame) -> DataFrame:
    """id, cohesion, coupling, score (1 to 10) from evidence."""
    c = F.col
    related = c("internal") + c("external")
    ratio = F.when(related > 0, round_half_up(3 * c("internal") / F.greatest(related, F.lit(1)))).otherwise(0)
    cohesion = clamp(6 + ratio + c("in_folder").cast("int") - F.when(c("outgoing") > 12, 2).when(c("outgoing") > 8, 1).otherwise(0) - F.when((c("incoming") == 0) & ~c("entry_point"), 1).otherwise(0))
    base = 10 - F.greatest(F.lit(0), c("outgoing") - 4) - 2 * c("external_modules") - F.when((c("external") > c("internal")) & (c("external") > 2), 1).otherwise(0)
    coupling = clamp(F.when(c("outgoing") == 0, F.least(F.lit(10), base + 1)).otherwise(base))
    both = evidence.select("id", cohesion.cast("long").alias("cohesion"), coupling.cast("long").alias("coupling"))
    return both.withColumn("score", round_half_up((c("cohesion") + c("coupling") + F.least("cohesion", "coupling")) / 3).cast("long"))


def internal_rollup(scores: DataFrame, children: DataFrame) -> DataFrame:
    """Parents' scores with their internal components': (parent, score, n_children, worst, children).

    The mean counts the parent's own score, if it has one, and all children's;
    children are listed by score, then label.
    """
    named = children.join(scores.select(F.col("id").alias("child"), F.col("score").alias("s")), "child")
    rolled = named.groupBy("parent").agg(F.sum("s").alias("total"), F.count("*").alias("n_children"), F.min(F.struct("s", "label")).alias("w"), F.array_sort(F.collect_list(F.struct("s", "label"))).alias("all"))
    own = rolled.join(scores.select(F.col("id").alias("parent"), F.col("score").alias("own")), "parent", "left")
    n = F.col("n_children") + F.col("own").isNotNull().cast("int")
    score = round_half_up((F.col("total") + F.coalesce("own", F.lit(0))) / n).cast("long")
    return own.select("parent", score.alias("score"), "n_children", F.concat(F.col("w.label"), F.lit(" "), F.col("w.s").cast("string"), F.lit("/10")).alias("worst"), F.array_join(F.transform("all", lambda x: x.label), ",").alias("children"))


def module_nodes(nodes: DataFrame, findings: DataFrame, front: str = "front/", back: str = "back/") -> DataFrame:
    """module, n_nodes, n_front, n_back, n_findings."""
    found = findings.groupBy(F.col("node_id").alias("id")).count()
    at = lambda p: F.count_if(F.coalesce(F.col("path").startswith(p), F.lit(False)))
    return nodes.join(found, "id", "left").groupBy("module").agg(F.count("*").alias("n_nodes"), at(front).alias("n_front"), at(back).alias("n_back"), F.coalesce(F.sum("count"), F.lit(0)).alias("n_findings"))


def module_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """src_module, dst_module, n_edges, types: relations between modules; shared imports are left out."""
    end = lambda a, b: nodes.select(F.col("id").alias(a), F.col("module").alias(b))
    kept = edges.filter(F.col("type").isin(MODULE_EDGES)).join(end("src", "src_module"), "src").join(end("dst", "dst_module"), "dst").filter("src_module <> dst_module")
    kept = kept.filter(~(F.col("type").isin("imports", "depends-on") & ((F.col("src_module") == "shared") | (F.col("dst_module") == "shared"))))
    return kept.groupBy("src_module", "dst_module").agg(F.count("*").alias("n_edges"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))


def module_degrees(between: DataFrame) -> DataFrame:
    """module, n_relations: how many module relations touch it."""
    return between.select(F.explode(F.array("src_module", "dst_module")).alias("module")).groupBy("module").agg(F.count("*").alias("n_relations"))


def module_stats(nodes: DataFrame, orphaned: DataFrame, covered: DataFrame, findings: DataFrame, scores: DataFrame, review_below: int = 6) -> DataFrame:
    """module, n_nodes, n_orphans, n_uncovered, n_review, n_findings, finding_rules, quality_sum, quality_count; ``scores`` has a row an id."""
    # What is known of a node is added up by id first and joined once: numbers only, so neither tables of wide rows nor a sort for each fact meet in a task.
    none, one = F.lit(None).cast("long"), F.lit(1).cast("long")
    facts = {"orphan": orphaned, "covered": covered, "found": findings.select(F.col("node_id").alias("id")), "score": scores}
    told = None
    for name, of in facts.items():
        value = F.col("score").cast("long") if name == "score" else one
        part = of.select("id", *((value if c == name else none).alias(c) for c in facts))
        told = part if told is None else told.union(part)
    told = told.groupBy("id").agg(F.max("orphan").alias("orphan"), F.max("covered").alias("covered"), F.sum("found").alias("found"), F.max("score").alias("score"))
    coverable = F.col("type").isin(COVERABLE) & F.col("path").isNotNull()
    full = nodes.select("id", "module", coverable.alias("coverable")).join(told, "id", "left")
    base = full.groupBy("module").agg(
        F.count("*").alias("n_nodes"), F.count("orphan").alias("n_orphans"), F.count_if(F.col("coverable") & F.col("covered").isNull()).alias("n_uncovered"), F.count_if(F.coalesce(F.col("score") < review_below, F.lit(False))).alias("n_review"),
        F.coalesce(F.sum("found"), F.lit(0)).alias("n_findings"), F.coalesce(F.sum("score"), F.lit(0)).alias("quality_sum"), F.count("score").alias("quality_count"),
    )
    rules = findings.join(nodes.select(F.col("id").alias("node_id"), "module"), "node_id").groupBy("module", "rule_id").count()
    rules = rules.groupBy("module").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "rule_id", F.col("count").cast("string")))), ";").alias("finding_rules"))
    return base.join(rules, "module", "left").withColumn("finding_rules", F.coalesce("finding_rules", F.lit("")))


def coverage_by_source(sources: DataFrame, tests: DataFrame) -> DataFrame:
    """source, tests (sorted, distinct), n_cases from ``tests(test, source, cases)``, for sources that exist.

    A test has one number of cases, the largest that is given for it, and counts once for each source.
    """
    cases = tests.groupBy("test").agg(F.max("cases").alias("cases"))
    pairs = tests.select("test", "source").distinct().join(sources.select("source").distinct(), "source", "left_semi")
    return pairs.join(cases, "test").groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("test")), ",").alias("tests"), F.sum("cases").alias("n_cases"))


def unique_bindings(bindings: DataFrame) -> DataFrame:
    """name, value of the names that are bound to one value only."""
    return bindings.groupBy("name").agg(F.count_distinct("value").alias("n"), F.min("value").alias("value")).filter("n = 1").select("name", "value")


def latest_revisions(revisions: DataFrame) -> DataFrame:
    """Of each id the row with the highest revision, and how many there are."""
    w = W.partitionBy("id")
    ranked = revisions.withColumn("rn", F.row_number().over(w.orderBy(F.col("revision").desc()))).withColumn("n_revisions", F.count("*").over(w))
    return ranked.filter("rn = 1").drop("rn")


def digest(lines: DataFrame) -> DataFrame:
    """One row: SHA-256 over a set of lines, in two levels so that no task sorts them all.

    Lines fall into 256 buckets by the first two digits of their own hash, whatever
    their number, so equal sets have equal digests; a bucket's lines stream through its
    hash in order, and the digests of the buckets, in order, are hashed again.
    """
    keyed = lines.filter("line is not null").select(F.substring(F.sha2("line", 256), 1, 2).alias("b"), "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, hashlib.sha256()
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now]), pa.array([sha.hexdigest()])], names=["b", "d"])
        for batch in batches:
            for b, rows in groupby(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), itemgetter(0)):
                text = "\n".join(line for _, line in rows)
                if b != now:
                    if now is not None:
                        yield done()
                    now, sha = b, hashlib.sha256()
                else:
                    text = "\n" + text
                sha.update(text.encode())
        if now is not None:
            yield done()

    buckets = keyed.repartition("b").sortWithinPartitions("b", "line").mapInArrow(run, "b string, d string")
    return buckets.agg(F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: F.concat(x.b, F.lit(" "), x.d)), "\n"), 256)).alias("digest"))
