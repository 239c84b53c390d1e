"""Findings as people read them: the three views of a collection, filters, and what stands on each node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VIEWS = ("all", "active", "suppressed")
SEVERITIES = ["error", "warning"]


def _rank(severity: Column) -> Column:
    return F.when(severity == "error", 0).when(severity == "warning", 1).otherwise(2)


def _order() -> list[Column]:
    """Severity, path (none: empty), line (none: 0), rule; then the id, so that ties have one order."""
    return [_rank(F.col("severity")), F.coalesce("path", F.lit("")), F.coalesce("line", F.lit(0)), F.col("rule_id"), F.col("id")]


def view(findings: DataFrame, which: str = "all") -> DataFrame:
    """All findings, those that count, or those that a suppression takes away, in order; a null ``suppressed`` counts as false.

    The order is a range sort, so no task holds more than a range of it.
    """
    if which not in VIEWS:
        raise ValueError(f"a view is one of {', '.join(VIEWS)}")
    away = F.coalesce(F.col("suppressed"), F.lit(False))
    kept = findings if which == "all" else findings.filter(away if which == "suppressed" else ~away)
    return kept.orderBy(*_order())


def filtered(findings: DataFrame, nodes: DataFrame | None = None, severity: str | None = None, rule: str | None = None, module: str | None = None) -> DataFrame:
    """Findings of one severity, rule and module, each of them if given; a finding is of its node's module.

    With a module, findings without a node that is known are left out; repeated node rows change nothing.
    """
    out = findings
    if severity is not None:
        out = out.filter(F.col("severity") == severity)
    if rule is not None:
        out = out.filter(F.col("rule_id") == rule)
    if module is not None:
        if nodes is None:
            raise ValueError("the module of a finding is looked up in nodes")
        out = out.join(nodes.filter(F.col("module") == module).select(F.col("id").alias("node_id")), "node_id", "left_semi").select(*findings.columns)
    return out


def attached(nodes: DataFrame, findings: DataFrame) -> DataFrame:
    """Every node with what was found on it: n_findings, n_errors, n_warnings, worst severity, rules, first finding's id.

    A finding without a node, or of one that is not there, is left out.  Findings are summed up by node
    before the shuffle (of rules the names are kept, once), so a node that holds a third of all findings is one
    row; the findings themselves are ``on_nodes``.  Nodes without findings have counts of 0 and no rules.
    """
    found = findings.filter("node_id is not null").groupBy("node_id").agg(
        F.count("*").alias("n_findings"),
        F.count_if(F.col("severity") == "error").alias("n_errors"),
        F.count_if(F.col("severity") == "warning").alias("n_warnings"),
        F.min_by("severity", _rank(F.col("severity"))).alias("worst"),
        F.array_sort(F.collect_set("rule_id")).alias("rules"),
        F.min(F.struct(*(c.alias(f"k{i}") for i, c in enumerate(_order())))).getField("k4").alias("first_id"),
    )
    taken = ["n_findings", "n_errors", "n_warnings", "worst", "rules", "first_id"]
    own = [c for c in nodes.columns if c not in taken]
    joined = nodes.select(*own).join(found, F.col("id") == F.col("node_id"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select(*own, *map(zero, taken[:3]), "worst", F.coalesce("rules", F.array().cast("array<string>")).alias("rules"), "first_id")


def on_nodes(nodes: DataFrame, findings: DataFrame) -> DataFrame:
    """The findings whose node is there, each as often as it stands."""
    return findings.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi").select(*findings.columns)
