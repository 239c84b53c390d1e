"""Registered queries over findings: what stands on the nodes, and the views of a collection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import findings, rules
from . import cgraph
from .queries import _SUPPRESSED_SQL, SUPPRESSIONS, query


@query(" SELECT n.id, COALESCE(k.n_findings, 0) AS n_findings, COALESCE(n_errors, 0) AS n_errors, COALESCE(n_warnings, 0) AS n_warnings, COALESCE(worst, '') AS worst, COALESCE(rules, '') AS rules, COALESCE(first_id, '') AS first_id FROM n LEFT JOIN (SELECT node_id, COUNT(*) AS n_findings, COUNT(*) FILTER (severity = 'error') AS n_errors, COUNT(*) FILTER (severity = 'warning') AS n_warnings, MIN(severity) AS worst, string_agg(rule_id, ',' ORDER BY rule_id) AS rules, arg_min(id, severity) AS first_id FROM fi GROUP BY node_id) k ON k.node_id = n.id")
def node_findings(spark, sf_dir):
    """Every node with the number, the worst and the rules of its findings."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    all_nodes = findings.attached(cgraph.nodes(spark, sf_dir), cgraph.findings(spark, sf_dir))
    return all_nodes.select("id", "n_findings", "n_errors", "n_warnings", text("worst"), F.array_join("rules", ",").alias("rules"), text("first_id"))


@query(_SUPPRESSED_SQL + " SELECT 'active' AS view, id, severity, path, line, rule_id FROM su WHERE reason IS NULL UNION ALL SELECT 'suppressed', id, severity, path, line, rule_id FROM su WHERE reason IS NOT NULL UNION ALL SELECT 'all', id, severity, path, line, rule_id FROM su")
def finding_views(spark, sf_dir):
    """The three views of the findings after suppression."""
    judged = rules.suppressed(cgraph.findings(spark, sf_dir), SUPPRESSIONS)
    one = lambda which: findings.view(judged, which).select(F.lit(which).alias("view"), "id", "severity", "path", "line", "rule_id")
    return one("all").union(one("active")).union(one("suppressed"))


@query(" SELECT fi.* FROM fi JOIN n ON n.id = fi.node_id WHERE fi.severity = 'warning' AND fi.rule_id = 'size.large' AND n.module = 'Brand#13'")
def findings_filtered(spark, sf_dir):
    """Findings of one severity, rule and module."""
    return findings.filtered(cgraph.findings(spark, sf_dir), cgraph.nodes(spark, sf_dir), "warning", "size.large", "Brand#13")
