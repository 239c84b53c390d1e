"""Registered queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import layout, measure, merge, rules, trace, traverse
from ..operators.components import connected_components
from ..sources.work import cut
from . import cgraph
from .cgraph import GRAPH_SQL, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

ENTRY_PATHS = ["front/geo/ASIA"]
SUFFIXES = ["Program.cs"]
FOLDER = "front/features/{module}/"
SUPPRESSIONS = [{"rule": "size.large", "path": "back/repositories/Brand#1*/**", "reason": "legacy"}, {"path": "back/**/STANDARD/*", "reason": "generated", "expires": "2999-12-31"}, {"rule": "type.economy", "reason": "planned"}, {"rule": "size.large"}]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with SQL over the graph's tables n, e and fi."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {'RECURSIVE ' if 'RECURSIVE' in sql else ''}{GRAPH_SQL}" + sql.replace("RECURSIVE", "")
        return f

    return add


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return cgraph.nodes(spark, sf_dir), cgraph.edges(spark, sf_dir)


# Model and merge


@query(" SELECT * FROM n")
def graph_nodes(spark, sf_dir):
    return cgraph.nodes(spark, sf_dir)


@query(" SELECT * FROM e")
def graph_edges(spark, sf_dir):
    return cgraph.edges(spark, sf_dir)


@query(" SELECT * FROM fi")
def graph_findings(spark, sf_dir):
    return cgraph.findings(spark, sf_dir)


@query("""SELECT 1""")
def node_upsert_last_wins(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    writes = ev.select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("id"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("label"), F.when(F.col("value") > 50, F.lit("heavy")).alias("type"), F.col("event_id").alias("seq"))
    return merge.upsert_nodes(writes, ["label", "type"])


ORACLE_SQL["node_upsert_last_wins"] = """WITH w AS (SELECT concat('user:', user_id) AS id, CASE WHEN event_type <> 'error' THEN event_type END AS label, CASE WHEN value > 50 THEN 'heavy' END AS type, event_id AS seq FROM events)
SELECT id, COALESCE(arg_max(label, seq) FILTER (WHERE label IS NOT NULL), id) AS label, COALESCE(arg_max(type, seq) FILTER (WHERE type IS NOT NULL), 'unknown') AS type FROM w GROUP BY id"""


@query("SELECT 1")
def edge_first_wins(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    writes = li.select(F.concat(F.lit("s"), (F.col("l_suppkey") % 40).cast("string")).alias("src"), F.concat(F.lit("s"), (F.col("l_partkey") % 40).cast("string")).alias("dst"), F.col("l_returnflag").alias("type"), F.col("l_linestatus").alias("evidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return merge.first_edges(writes)


ORACLE_SQL["edge_first_wins"] = """WITH w AS (SELECT concat('s', l_suppkey % 40) AS src, concat('s', l_partkey % 40) AS dst, l_returnflag AS type, l_linestatus AS evidence, l_orderkey * 10 + l_linenumber AS seq FROM lineitem)
SELECT concat_ws('::', src, type, dst) AS id, src, dst, type, evidence FROM w WHERE src <> dst QUALIFY row_number() OVER (PARTITION BY src, type, dst ORDER BY seq) = 1"""


def _broken(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    n, e = _graph(spark, sf_dir)
    return n.filter("not (type = 'handler' and module in ('NATION_1', 'NATION_2'))").withColumn("label", F.when(F.col("id") == "nation:3", F.lit("")).otherwise(F.col("label"))), e


_BROKEN_SQL = ", bn AS (SELECT id, CASE WHEN id = 'nation:3' THEN '' ELSE label END AS label, type, layer, module, path FROM n WHERE NOT (type = 'handler' AND module IN ('NATION_1', 'NATION_2')))"


@query(_BROKEN_SQL + """ SELECT id, 'from' AS "end", src AS missing FROM e WHERE src NOT IN (SELECT id FROM bn) UNION ALL SELECT id, 'to', dst FROM e WHERE dst NOT IN (SELECT id FROM bn)""")
def dangling_edges(spark, sf_dir):
    n, e = _broken(spark, sf_dir)
    return merge.dangling_edges(e, n)


@query(_BROKEN_SQL + """ SELECT 'NODE_LABEL_EMPTY' AS code, id AS subject FROM bn WHERE label = '' UNION ALL SELECT 'EDGE_ENDPOINT_MISSING', src FROM e WHERE src NOT IN (SELECT id FROM bn) UNION ALL SELECT 'EDGE_ENDPOINT_MISSING', dst FROM e WHERE dst NOT IN (SELECT id FROM bn)""")
def validation_issues(spark, sf_dir):
    return merge.validation_issues(*_broken(spark, sf_dir))


@query(_BROKEN_SQL + " SELECT * FROM e WHERE src IN (SELECT id FROM bn) AND dst IN (SELECT id FROM bn)")
def admitted_edges(spark, sf_dir):
    n, e = _broken(spark, sf_dir)
    return merge.admitted_edges(e, n).select("id", "src", "dst", "type", "confidence")


@query(" SELECT (SELECT COUNT(*) FROM n) AS n_nodes, (SELECT COUNT(*) FROM e) AS n_edges, (SELECT COUNT(DISTINCT type) FROM n) AS n_types, (SELECT COUNT(DISTINCT module) FROM n) AS n_modules, (SELECT COUNT(*) FROM fi) AS n_findings")
def graph_stats(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    a = n.agg(F.count("*").alias("n_nodes"), F.count_distinct("type").alias("n_types"), F.count_distinct("module").alias("n_modules"))
    one = lambda df, c: df.agg(F.count("*").alias(c)).withColumn("k", F.lit(1))
    return a.withColumn("k", F.lit(1)).join(one(e, "n_edges"), "k").join(one(cgraph.findings(spark, sf_dir), "n_findings"), "k").select("n_nodes", "n_edges", "n_types", "n_modules", "n_findings")


@query(" SELECT type, COUNT(*) AS n FROM n GROUP BY type")
def type_histogram(spark, sf_dir):
    return cgraph.nodes(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"))


# Orphans, quality, modules

_ENTRY_SQL = "(type = 'table' OR COALESCE(path IN ('front/geo/ASIA'), FALSE) OR COALESCE(suffix(path, 'Program.cs'), FALSE))"
_SCORED_SQL = "('" + "','".join(measure.SCORED) + "')"
_ORPHANS_SQL = f", orph AS (SELECT id, label, type, module, path FROM n WHERE (type IN {_SCORED_SQL} OR type IN ('entity', 'table')) AND NOT {_ENTRY_SQL} AND id NOT IN (SELECT dst FROM e))"


@query(_ORPHANS_SQL + " SELECT * FROM orph")
def orphans(spark, sf_dir):
    return measure.orphans(*_graph(spark, sf_dir), ENTRY_PATHS, SUFFIXES)


@query(" SELECT id, (SELECT COUNT(*) FROM e WHERE dst = n.id) AS in_degree, (SELECT COUNT(*) FROM e WHERE src = n.id) AS out_degree FROM n")
def in_out_degree(spark, sf_dir):
    return measure.degrees(*_graph(spark, sf_dir))


_EVIDENCE_SQL = f""", k AS (SELECT e.src, e.dst, a.module AS sm, b.module AS dm FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst WHERE a.type NOT IN ('entity', 'table') AND b.type NOT IN ('entity', 'table')),
r AS (SELECT dst AS id, dm AS own, sm AS other, 0 AS o FROM k UNION ALL SELECT src, sm, dm, 1 FROM k),
c AS (SELECT id, COUNT(*) FILTER (own = other) AS internal, COUNT(*) FILTER (own <> other) AS external, COUNT(*) FILTER (o = 1) AS outgoing, COUNT(*) FILTER (o = 0) AS incoming, COUNT(DISTINCT CASE WHEN own <> other AND o = 1 AND other <> 'shared' THEN other END) AS external_modules FROM r GROUP BY id),
ev AS (SELECT n.id, COALESCE(internal, 0) AS internal, COALESCE(external, 0) AS external, COALESCE(outgoing, 0) AS outgoing, COALESCE(incoming, 0) AS incoming, COALESCE(external_modules, 0) AS external_modules,
  COALESCE(contains(path, replace('{FOLDER}', '{{module}}', module)), FALSE) AS in_folder, {_ENTRY_SQL} AS entry_point FROM n LEFT JOIN c USING (id) WHERE type IN {_SCORED_SQL})"""
_SCORES_SQL = _EVIDENCE_SQL + """, s1 AS (SELECT id, CAST(least(10, greatest(1, 6 + CASE WHEN internal + external > 0 THEN floor(3.0 * internal / (internal + external) + 0.5) ELSE 0 END + CAST(in_folder AS INT) - CASE WHEN outgoing > 12 THEN 2 WHEN outgoing > 8 THEN 1 ELSE 0 END - CASE WHEN incoming = 0 AND NOT entry_point THEN 1 ELSE 0 END)) AS BIGINT) AS cohesion,
  10 - greatest(0, outgoing - 4) - 2 * external_modules - CASE WHEN external > internal AND external > 2 THEN 1 ELSE 0 END AS base, outgoing FROM ev),
s2 AS (SELECT id, cohesion, CAST(least(10, greatest(1, CASE WHEN outgoing = 0 THEN least(10, base + 1) ELSE base END)) AS BIGINT) AS coupling FROM s1),
sc AS (SELECT id, cohesion, coupling, CAST(floor((cohesion + coupling + least(cohesion, coupling)) / 3.0 + 0.5) AS BIGINT) AS score FROM s2)"""


def _evidence(spark, sf_dir) -> DataFrame:
    return measure.quality_evidence(*_graph(spark, sf_dir), FOLDER, ENTRY_PATHS, SUFFIXES)


@query(_EVIDENCE_SQL + " SELECT * FROM ev")
def quality_evidence(spark, sf_dir):
    return _evidence(spark, sf_dir)


@query(_SCORES_SQL + " SELECT * FROM sc")
def quality_scores(spark, sf_dir):
    return measure.quality_scores(_evidence(spark, sf_dir))


@query(_SCORES_SQL + " SELECT CASE WHEN score >= 9.5 THEN 'excellent' WHEN score >= 8.5 THEN 'very-good' WHEN score >= 7.5 THEN 'good' WHEN score >= 6.5 THEN 'fair' WHEN score >= 5 THEN 'low' ELSE 'critical' END AS health, COUNT(*) AS n FROM sc GROUP BY 1")
def health_buckets(spark, sf_dir):
    return measure.quality_scores(_evidence(spark, sf_dir)).groupBy(fx.health_key(F.col("score")).alias("health")).agg(F.count("*").alias("n"))


@query(_SCORES_SQL + """, ch AS (SELECT src AS parent, dst AS child, b.label, sc.score AS s FROM e JOIN n b ON b.id = dst JOIN sc ON sc.id = dst WHERE e.type = 'imports' AND b.type = 'component'),
g AS (SELECT parent, SUM(s) AS total, COUNT(*) AS n_children, first(concat(label, ' ', s, '/10') ORDER BY s, label) AS worst, string_agg(label, ',' ORDER BY s, label) AS children FROM ch GROUP BY parent)
SELECT parent, CAST(floor((total + COALESCE(score, 0)) / (n_children + CASE WHEN score IS NULL THEN 0 ELSE 1 END)::DOUBLE + 0.5) AS BIGINT) AS score, n_children, worst, children FROM g LEFT JOIN sc ON sc.id = parent""")
def internal_rollup(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    kids = e.filter("type = 'imports'").join(n.filter("type = 'component'").select(F.col("id").alias("dst"), "label"), "dst").select(F.col("src").alias("parent"), F.col("dst").alias("child"), "label")
    return measure.internal_rollup(measure.quality_scores(_evidence(spark, sf_dir)), kids)


@query(" SELECT module, COUNT(*) AS n_nodes, COUNT(*) FILTER (COALESCE(starts_with(path, 'front/'), FALSE)) AS n_front, COUNT(*) FILTER (COALESCE(starts_with(path, 'back/'), FALSE)) AS n_back, CAST(COALESCE(SUM((SELECT COUNT(*) FROM fi WHERE node_id = n.id)), 0) AS BIGINT) AS n_findings FROM n GROUP BY module")
def module_graph_nodes(spark, sf_dir):
    return measure.module_nodes(cgraph.nodes(spark, sf_dir), cgraph.findings(spark, sf_dir))


_MODULE_EDGES_SQL = f""", me AS (SELECT a.module AS src_module, b.module AS dst_module, COUNT(*) AS n_edges, string_agg(DISTINCT e.type, ',' ORDER BY e.type) AS types FROM e JOIN n a ON a.id = src JOIN n b ON b.id = dst
WHERE e.type IN ({", ".join(repr(x) for x in measure.MODULE_EDGES)}) AND a.module <> b.module AND NOT (e.type IN ('imports', 'depends-on') AND (a.module = 'shared' OR b.module = 'shared')) GROUP BY ALL)"""


@query(_MODULE_EDGES_SQL + " SELECT * FROM me")
def module_graph_edges(spark, sf_dir):
    return measure.module_edges(*_graph(spark, sf_dir))


@query(_MODULE_EDGES_SQL + " SELECT module, COUNT(*) AS n_relations FROM (SELECT src_module AS module FROM me UNION ALL SELECT dst_module FROM me) GROUP BY module")
def module_external_degree(spark, sf_dir):
    return measure.module_degrees(measure.module_edges(*_graph(spark, sf_dir)))


_COVERED_SQL = ", cov AS (SELECT concat('customer:', c_custkey) AS id FROM customer WHERE c_acctbal > 0)"
_STATS_SQL = _ORPHANS_SQL + _SCORES_SQL + _COVERED_SQL + f""", ms AS (SELECT module, COUNT(*) AS n_nodes, COUNT(o.id) AS n_orphans, COUNT(*) FILTER (n.type IN ({", ".join(repr(x) for x in measure.COVERABLE)}) AND n.path IS NOT NULL AND cov.id IS NULL) AS n_uncovered, COUNT(*) FILTER (score < 6) AS n_review,
  CAST(COALESCE(SUM(fc.c), 0) AS BIGINT) AS n_findings, CAST(COALESCE(SUM(score), 0) AS BIGINT) AS quality_sum, COUNT(score) AS quality_count
  FROM n LEFT JOIN (SELECT id FROM orph) o USING (id) LEFT JOIN cov USING (id) LEFT JOIN (SELECT node_id AS id, COUNT(*) AS c FROM fi GROUP BY 1) fc USING (id) LEFT JOIN sc USING (id) GROUP BY module),
fr AS (SELECT module, string_agg(concat(rule_id, '=', c), ';' ORDER BY concat(rule_id, '=', c)) AS finding_rules FROM (SELECT n.module, rule_id, COUNT(*) AS c FROM fi JOIN n ON n.id = node_id GROUP BY ALL) GROUP BY module)"""


def _covered(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"))


@query(_STATS_SQL + " SELECT ms.*, COALESCE(finding_rules, '') AS finding_rules FROM ms LEFT JOIN fr USING (module)")
def module_stats(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    return measure.module_stats(n, measure.orphans(n, e, ENTRY_PATHS, SUFFIXES), _covered(spark, sf_dir), cgraph.findings(spark, sf_dir), measure.quality_scores(_evidence(spark, sf_dir)))


@query(_STATS_SQL + " SELECT CAST(SUM(n_nodes) AS BIGINT) AS n_nodes, COUNT(*) AS n_modules, CAST(SUM(n_orphans) AS BIGINT) AS n_orphans, CAST(SUM(n_uncovered) AS BIGINT) AS n_uncovered, CAST(SUM(n_findings) AS BIGINT) AS n_findings, floor(10.0 * SUM(quality_sum) / SUM(quality_count) + 0.5) / 10 AS quality FROM ms")
def report_summary(spark, sf_dir):
    return module_stats(spark, sf_dir).agg(*(F.sum(c).alias(c) for c in ("n_nodes",)), F.count("*").alias("n_modules"), *(F.sum(c).alias(c) for c in ("n_orphans", "n_uncovered", "n_findings")), (fx.round_half_up(10.0 * F.sum("quality_sum") / F.sum("quality_count")) / 10).alias("quality"))


@query(_STATS_SQL + " SELECT module, n_nodes, n_orphans, n_uncovered, (SELECT COUNT(*) FROM e JOIN n a ON a.id = src JOIN n b ON b.id = dst WHERE (a.module = ms.module) <> (b.module = ms.module)) AS n_crossing FROM ms WHERE module = 'shared'")
def module_detail(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    one = module_stats(spark, sf_dir).filter("module = 'shared'").select("module", "n_nodes", "n_orphans", "n_uncovered")
    end = lambda c: n.select(F.col("id").alias(c), (F.col("module") == "shared").alias(f"in_{c}"))
    crossing = e.join(end("src"), "src").join(end("dst"), "dst").filter("in_src <> in_dst").agg(F.count("*").alias("n_crossing")).withColumn("module", F.lit("shared"))
    return one.join(crossing, "module")


@query(" SELECT src AS id, COUNT(*) AS n_managed FROM e WHERE type = 'queries-table' OR type = 'depends-on' GROUP BY src")
def managed_counts(spark, sf_dir):
    return cgraph.edges(spark, sf_dir).filter(F.col("type").isin("queries-table", "depends-on")).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_managed"))


# Submaps


def _hops_sql(seeds: str, step: str, depth: int, name: str = "bfs") -> str:
    return f"RECURSIVE, {name}(id, depth) AS ({seeds} UNION SELECT {step} AND depth < {depth}), {name}_m AS (SELECT id, MIN(depth) AS depth FROM {name} GROUP BY id)"


_OUT = "e.dst, depth + 1 FROM bfs JOIN e ON e.src = bfs.id WHERE TRUE"


@query(" SELECT id FROM n WHERE id = 'nation:3' OR COALESCE(regexp_matches(path, '^back/handlers/[^/]*/Supplier.*[0-9]$'), FALSE) OR (module IN ('ASIA') AND type IN ('page'))")
def submap_seeds(spark, sf_dir):
    n = cgraph.nodes(spark, sf_dir)
    base = traverse.Selector(node_ids=("nation:3",), modules=("ASIA",), types=("page",)).ids(n)
    return base.union(n.filter(F.coalesce(F.col("path").rlike(r"\Aback/handlers/[^/]*/Supplier.*[0-9]\z"), F.lit(False))).select("id")).distinct()


@query(_hops_sql("SELECT 'nation:3', 0", _OUT, 3) + " SELECT id, depth FROM bfs_m")
def submap_bfs_out(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    return traverse.hops(n.filter("id = 'nation:3'"), traverse.adjacency(e, "outgoing"), 3)


@query(_hops_sql("SELECT id, 0 FROM n WHERE id = 'table:Brand#11'", "e.src, depth + 1 FROM bfs JOIN e ON e.dst = bfs.id WHERE TRUE", 3) + " SELECT id, depth FROM bfs_m")
def submap_bfs_in(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    return traverse.hops(n.filter("id = 'table:Brand#11'"), traverse.adjacency(e, "incoming"), 3)


@query(_hops_sql("SELECT 'supplier:1', 0", "a.b, depth + 1 FROM bfs JOIN (SELECT src AS a, dst AS b FROM e UNION ALL SELECT dst, src FROM e) a ON a.a = bfs.id WHERE TRUE", 2) + " SELECT id, depth FROM bfs_m")
def submap_bfs_both(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    return traverse.hops(n.filter("id = 'supplier:1'"), traverse.adjacency(e, "both"), 2)


@query(_hops_sql("SELECT 'nation:3', 0", "e.dst, depth + 1 FROM bfs JOIN e ON e.src = bfs.id JOIN n ON n.id = e.dst WHERE n.type <> 'handler'", 5) + " SELECT id, depth FROM bfs_m")
def submap_excluded(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    return traverse.hops(n.filter("id = 'nation:3'"), traverse.adjacency(e, "outgoing"), 5, excluded=n.filter("type = 'handler'"))


@query(_hops_sql("SELECT 'nation:3', 0", "e.dst, depth + 1 FROM bfs JOIN n s ON s.id = bfs.id JOIN e ON e.src = bfs.id WHERE s.type <> 'handler'", 5) + " SELECT id, depth FROM bfs_m")
def submap_forbidden(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    return traverse.hops(n.filter("id = 'nation:3'"), traverse.adjacency(e, "outgoing"), 5, blocked=n.filter("type = 'handler'"))


@query(_hops_sql("SELECT 'nation:3', 0", _OUT + " AND e.type IN ('imports', 'calls-api')", 6) + " SELECT id, depth FROM bfs_m")
def submap_edge_types(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    t = traverse.Traversal("outgoing", 6, ("imports", "calls-api"))
    return traverse.hops(n.filter("id = 'nation:3'"), traverse.adjacency(traverse.allowed(e, t), "outgoing"), 6)


def _submap(spark, sf_dir, depth: int = 2, graph: tuple[DataFrame, DataFrame] | None = None) -> traverse.Submap:
    S = traverse.Selector
    request = traverse.Request(S(node_ids=("nation:3",)), S(paths=("front/features/*/BUILDING/**",)), traverse.Traversal("outgoing", depth), {"editable": S(types=("component",)), "forbidden": S(paths=("api/F/*",)), "external": S(types=("page",))})
    return traverse.create(*(graph or _graph(spark, sf_dir)), request)


def _two_submaps(spark, sf_dir) -> tuple[traverse.Submap, traverse.Submap]:
    """Those of depth 1 and 2, over one written graph."""
    graph = tuple(map(cut, _graph(spark, sf_dir)))
    return _submap(spark, sf_dir, 1, graph), _submap(spark, sf_dir, 2, graph)


def _submap_sql(depth: int, name: str = "sm") -> str:
    return f""", {name}_b(id, depth) AS (SELECT 'nation:3', 0 UNION SELECT e.dst, depth + 1 FROM {name}_b JOIN n s ON s.id = {name}_b.id JOIN e ON e.src = s.id JOIN n ON n.id = e.dst
WHERE NOT COALESCE(regexp_full_match(s.path, 'api/F/[^/]*'), FALSE) AND NOT COALESCE(regexp_full_match(n.path, 'front/features/[^/]*/BUILDING/.*'), FALSE) AND depth < {depth}),
{name} AS (SELECT * FROM n WHERE id IN (SELECT id FROM {name}_b)), {name}_e AS (SELECT e.* FROM e WHERE src IN (SELECT id FROM {name}_b) AND dst IN (SELECT id FROM {name}_b)),
{name}_a AS (SELECT id, CASE WHEN COALESCE(regexp_full_match(path, 'api/F/[^/]*'), FALSE) THEN 'forbidden' WHEN type = 'component' THEN 'editable' WHEN type = 'page' THEN 'external' ELSE 'readable' END AS level FROM {name}),
{name}_x AS (SELECT e.id AS edge_id, CASE WHEN i.id IS NOT NULL THEN src ELSE dst END AS inside_id, CASE WHEN i.id IS NOT NULL THEN dst ELSE src END AS outside_id, CASE WHEN i.id IS NOT NULL THEN 'outgoing' ELSE 'incoming' END AS direction,
  CASE WHEN COALESCE(regexp_full_match(o.path, 'front/features/[^/]*/BUILDING/.*'), FALSE) THEN 'excluded' ELSE 'depth-limit' END AS reason
  FROM e LEFT JOIN {name} i ON i.id = src LEFT JOIN {name} j ON j.id = dst JOIN n o ON o.id = CASE WHEN i.id IS NOT NULL THEN dst ELSE src END WHERE (i.id IS NULL) <> (j.id IS NULL))"""


@query("RECURSIVE" + _submap_sql(2) + " SELECT * FROM sm")
def submap_nodes(spark, sf_dir):
    return _submap(spark, sf_dir).nodes.select("id", "label", "type", "layer", "module", "path")


@query("RECURSIVE" + _submap_sql(2) + " SELECT * FROM sm_e")
def submap_edges(spark, sf_dir):
    return _submap(spark, sf_dir).edges.select("id", "src", "dst", "type", "confidence")


@query("RECURSIVE" + _submap_sql(2) + " SELECT * FROM sm_x")
def submap_boundaries(spark, sf_dir):
    return _submap(spark, sf_dir).boundaries


@query("RECURSIVE" + _submap_sql(2) + " SELECT * FROM sm_a")
def submap_access(spark, sf_dir):
    return _submap(spark, sf_dir).access


@query("RECURSIVE" + _submap_sql(2) + " SELECT (SELECT COUNT(*) FROM sm) AS n_nodes, (SELECT COUNT(*) FROM sm_e) AS n_edges, (SELECT COUNT(*) FROM sm_x) AS n_boundaries, (SELECT COUNT(*) FROM sm_a WHERE level = 'editable') AS n_editable, (SELECT COUNT(*) FROM sm_a WHERE level = 'forbidden') AS n_forbidden")
def submap_statistics(spark, sf_dir):
    s = _submap(spark, sf_dir)
    one = lambda df, c: df.agg(F.count("*").alias(c)).withColumn("k", F.lit(1))
    a = s.access.agg(F.count_if(F.col("level") == "editable").alias("n_editable"), F.count_if(F.col("level") == "forbidden").alias("n_forbidden")).withColumn("k", F.lit(1))
    return one(s.nodes, "n_nodes").join(one(s.edges, "n_edges"), "k").join(one(s.boundaries, "n_boundaries"), "k").join(a, "k").drop("k")


@query(" SELECT e.* FROM e JOIN n a ON a.id = src JOIN n b ON b.id = dst WHERE a.module IN ('Brand#1', 'Brand#2', 'Brand#3') AND b.module IN ('Brand#1', 'Brand#2', 'Brand#3')")
def induced_subgraph(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    return traverse.induced(e, n.filter(F.col("module").isin("Brand#1", "Brand#2", "Brand#3"))).select("id", "src", "dst", "type", "confidence")


@query(" SELECT DISTINCT id FROM (SELECT 'supplier:2' AS id UNION ALL SELECT dst FROM e WHERE src = 'supplier:2' UNION ALL SELECT src FROM e WHERE dst = 'supplier:2')")
def focus_set(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    return traverse.hops(n.filter("id = 'supplier:2'"), traverse.adjacency(e, "both"), 1).select("id")


@query("RECURSIVE" + _submap_sql(1, "sa") + _submap_sql(2, "sb") + " SELECT 'added' AS change, id FROM sb WHERE id NOT IN (SELECT id FROM sa) UNION ALL SELECT 'removed', id FROM sa WHERE id NOT IN (SELECT id FROM sb)")
def submap_diff_nodes(spark, sf_dir):
    before, after = _two_submaps(spark, sf_dir)
    return traverse.changes(before.nodes, after.nodes)


@query("RECURSIVE" + _submap_sql(1, "sa") + _submap_sql(2, "sb") + " SELECT 'added' AS change, id FROM sb_e WHERE id NOT IN (SELECT id FROM sa_e) UNION ALL SELECT 'removed', id FROM sa_e WHERE id NOT IN (SELECT id FROM sb_e)")
def submap_diff_edges(spark, sf_dir):
    before, after = _two_submaps(spark, sf_dir)
    return traverse.changes(before.edges, after.edges)


@query("RECURSIVE" + _submap_sql(1, "sa") + _submap_sql(2, "sb") + " SELECT id, a.level AS previous, b.level AS current FROM sa_a a FULL JOIN sb_a b USING (id) WHERE a.level IS DISTINCT FROM b.level")
def submap_diff_access(spark, sf_dir):
    before, after = _two_submaps(spark, sf_dir)
    return traverse.access_changes(before.access, after.access)


@query("RECURSIVE" + _submap_sql(2) + " SELECT id, id NOT IN (SELECT id FROM n WHERE type = 'endpoint' AND path LIKE 'api/O/%') AS available FROM sm")
def submap_availability(spark, sf_dir):
    n = cgraph.nodes(spark, sf_dir)
    return traverse.availability(_submap(spark, sf_dir).nodes, n.filter("not (type = 'endpoint' and path like 'api/O/%')"))


@query(" SELECT id FROM (SELECT id FROM n WHERE module = 'Brand#1' UNION ALL SELECT id FROM n WHERE type = 'table') GROUP BY id HAVING COUNT(*) = 1")
def selection_toggle(spark, sf_dir):
    n = cgraph.nodes(spark, sf_dir)
    return traverse.combined(n.filter("module = 'Brand#1'"), n.filter("type = 'table'"), "toggle")


# Traces

_TRACE_SQL = """, te AS (SELECT e.id, e.src, e.dst, e.type, e.confidence, a.type AS src_type, b.type AS dst_type FROM e JOIN n a ON a.id = src JOIN n b ON b.id = dst
WHERE e.type IN ('imports', 'lazy-imports', 'calls-api', 'sends', 'handled-by', 'depends-on', 'uses-entity', 'queries-table', 'maps-to-table') AND a.type <> 'controller' AND b.type <> 'controller'
AND NOT (a.type = 'data-context' AND (e.type = 'uses-entity' AND b.type = 'entity' OR e.type = 'queries-table' AND b.type = 'table')) AND NOT (e.type = 'queries-table' AND a.type IN ('handler', 'service') AND e.src IN (SELECT src FROM e WHERE type = 'depends-on')))"""


@query(_TRACE_SQL + " SELECT * FROM te")
def trace_edges_policy(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    return trace.trace_edges(e, n)


@query(""" SELECT id, CASE WHEN type = 'route' THEN CASE WHEN path = 'front/geo/ASIA' THEN 'route-root' ELSE 'route' END WHEN type = 'page' THEN 'page' WHEN type = 'component' THEN 'component' WHEN type = 'endpoint' THEN 'endpoint' WHEN type = 'handler' THEN 'handler'
WHEN type = 'repository' THEN 'back-repository' WHEN type = 'table' THEN 'table' END AS stage, CASE type WHEN 'route' THEN CASE WHEN path = 'front/geo/ASIA' THEN 0 ELSE 1 END WHEN 'page' THEN 2 WHEN 'component' THEN 4 WHEN 'endpoint' THEN 9 WHEN 'handler' THEN 11 WHEN 'repository' THEN 13 WHEN 'table' THEN 15 END AS rank FROM n""")
def trace_stage(spark, sf_dir):
    name = trace.stage(F.col("type"), F.col("layer"), F.col("path"), tuple(ENTRY_PATHS))
    return cgraph.nodes(spark, sf_dir).select("id", name.alias("stage")).withColumn("rank", trace.stage_rank(F.col("stage")).cast("int"))


@query(_hops_sql("SELECT id, 0 FROM n WHERE type = 'page'", _OUT, 28) + " SELECT id, depth FROM bfs_m")
def reachable_bounded(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    return trace.reachable(e, n.filter("type = 'page'"))


@query(_hops_sql("SELECT id, 0 FROM n WHERE module = 'NATION_7'", _OUT, 28, "bfs") + """, st(id) AS (SELECT id FROM n WHERE type = 'table' UNION SELECT e.src FROM st JOIN e ON e.dst = st.id), bk(id) AS (SELECT id FROM n WHERE module = 'NATION_7' UNION SELECT e.src FROM bk JOIN e ON e.dst = bk.id), og(id) AS (SELECT id FROM n WHERE type = 'route' UNION SELECT e.dst FROM og JOIN e ON e.src = og.id)
SELECT id FROM bfs_m WHERE id IN (SELECT id FROM st) UNION SELECT id FROM bk WHERE id IN (SELECT id FROM og)""")
def trace_all_nodes(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    return trace.all_trace_nodes(e, n.filter("module = 'NATION_7'"), n.filter("type = 'route'"), n.filter("type = 'table'"))


@query("RECURSIVE" + _TRACE_SQL + """, w AS (SELECT src, dst, 1.0 + CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 3 END + CASE WHEN type = 'queries-table' THEN CASE WHEN src_type = 'repository' THEN 2 ELSE 8 END WHEN type = 'uses-entity' THEN CASE WHEN src_type = 'repository' THEN 0 ELSE 4 END ELSE 0 END AS weight FROM te),
d(id, cost) AS (SELECT 'nation:3', CAST(0 AS DOUBLE) UNION SELECT w.dst, cost + weight FROM d JOIN w ON w.src = d.id) SELECT id, MIN(cost) AS cost FROM d GROUP BY id""")
def shortest_trace_cost(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    weighted = trace.trace_edges(e, n).withColumn("weight", trace.edge_weight())
    return trace.cheapest(weighted, n.filter("id = 'nation:3'")).select("id", "cost")


@query("RECURSIVE" + _TRACE_SQL + """, w AS (SELECT src, te.dst, greatest(0.25, 1.0 + CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 3 END + CASE WHEN te.type = 'queries-table' THEN 2 ELSE 0 END - CASE WHEN b.type IN ('endpoint', 'handler', 'repository', 'table') AND contains(lower(concat(b.label, ' ', COALESCE(b.path, ''))), 'nation') THEN 0.75 ELSE 0 END) AS weight FROM te JOIN n b ON b.id = te.dst),
d(id, cost) AS (SELECT 'nation:3', CAST(0 AS DOUBLE) UNION SELECT w.dst, cost + weight FROM d JOIN w ON w.src = d.id) SELECT id, MIN(cost) AS cost FROM d GROUP BY id""")
def trace_cost_with_intent(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    return trace.cheapest(trace.weighted_edges(e, n, ["nation"]), n.filter("id = 'nation:3'")).select("id", "cost")


@query("RECURSIVE, " + """up(id) AS (SELECT id FROM n WHERE module = 'NATION_7' UNION SELECT e.src FROM up JOIN e ON e.dst = up.id), dn(id) AS (SELECT id FROM n WHERE module = 'NATION_7' UNION SELECT e.dst FROM dn JOIN e ON e.src = dn.id), st(id) AS (SELECT id FROM n WHERE type IN ('table', 'entity') UNION SELECT e.src FROM st JOIN e ON e.dst = st.id)
SELECT id FROM n WHERE module = 'NATION_7' UNION SELECT up.id FROM up JOIN n USING (id) WHERE n.path LIKE 'front/%' UNION SELECT id FROM dn WHERE id IN (SELECT id FROM st)""")
def module_trace_nodes(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    return trace.module_trace(n, e, "NATION_7")


@query()
def connected_components_of_dependencies(spark, sf_dir):
    links = cgraph.edges(spark, sf_dir).filter("type = 'depends-on'").select(F.col("src").alias("u"), F.col("dst").alias("v"))
    return connected_components(links, cut)


# Classification, endpoints, imports, findings


@query("SELECT 1")
def classify_paths(spark, sf_dir):
    d = _paths(spark, sf_dir)
    both = d.select("path", rules.classify_back(F.col("path")).alias("b"), rules.classify_front(F.col("path")).alias("f"))
    return both.select("path", F.col("b.type").alias("back_type"), F.col("b.layer").alias("back_layer"), F.col("f.type").alias("front_type"), F.col("f.layer").alias("front_layer"))


_FOLDERS = ["Controllers", "Queries", "Handlers", "Entities", "services", "hooks", "lib/schemas", "other"]


def _paths(spark, sf_dir) -> DataFrame:
    folder = F.get(F.array(*map(F.lit, _FOLDERS)), (F.col("doc_id") % 8).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", folder, "lang", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))).alias("path"))


_PATHS_SQL = f"p AS (SELECT doc_id, concat_ws('/', source, list_extract([{', '.join(repr(x) for x in _FOLDERS)}], (doc_id % 8) + 1), lang, concat('doc_', doc_id)) AS path FROM documents)"


def _case_sql(fragments: list[tuple[str, str, str]], i: int) -> str:
    return "CASE " + " ".join(f"WHEN contains(concat('/', path), '{f[0]}') THEN '{f[i]}'" for f in fragments) + " ELSE 'auxiliary' END"


ORACLE_SQL["classify_paths"] = f"WITH {_PATHS_SQL} SELECT path, {_case_sql(rules.BACK_FRAGMENTS, 1)} AS back_type, {_case_sql(rules.BACK_FRAGMENTS, 2)} AS back_layer, {_case_sql(rules.FRONT_FRAGMENTS, 1)} AS front_type, {_case_sql(rules.FRONT_FRAGMENTS, 2)} AS front_layer FROM p"


@query(r""" SELECT id, COALESCE(NULLIF(regexp_extract(path, 'front/features/([^/]+)/', 1), ''), NULLIF(regexp_extract(path, '^back/[^/]+/([^/]+)/', 1), ''), 'shared') AS module_of_path FROM n""")
def module_of_path(spark, sf_dir):
    return cgraph.nodes(spark, sf_dir).select("id", rules.module_of(F.col("path")).alias("module_of_path"))


@query("SELECT 1")
def display_label(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang", F.when(F.col("doc_id") % 3 == 0, "index.ts").otherwise(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".ts")))).alias("path"))
    return d.select("doc_id", fx.display_label(F.col("path")).alias("label"))


ORACLE_SQL["display_label"] = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE concat('doc_', doc_id, '.ts') END AS label FROM documents"


@query("SELECT 1")
def kebab_case(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", fx.kebab(F.concat_ws("", "p_name", F.initcap(F.lower("p_type")), F.lit("_Part"))).alias("kebab"))


ORACLE_SQL["kebab_case"] = r"SELECT p_partkey, lower(regexp_replace(regexp_replace(concat(p_name, upper(p_type[1]), lower(p_type[2:]), '_Part'), '([a-z0-9])([A-Z])', '\1-\2', 'g'), '[\s_]+', '-', 'g')) AS kebab FROM part"


_ROUTES = ["/api/users/{id}", "/api/api/users/:id", "/api//orders//${x}/", "/api/v{version:apiVersion}/orders/:id-no", "/api/Users/:id", "/apix/y?q=1", "api/users", "/web/users"]
_VERBS = ["GET", "POST", "ANY"]


def _endpoints(spark, sf_dir) -> DataFrame:
    """A route for each page, of eight forms, with a resource of its own behind some of them."""
    own = F.when(F.col("page_id") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("/r"), (F.col("page_id") % 40).cast("string")))
    raw = F.concat(F.get(F.array(*map(F.lit, _ROUTES)), (F.col("page_id") % 8).cast("int")), own)
    method = F.get(F.array(*map(F.lit, _VERBS)), (F.col("page_id") % 3).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", fx.normalize_endpoint(raw).alias("url"), method.alias("method"))


#: What each form must become, with and without something behind it, and as an id; from what the operators are to do, not from them.
_ROUTES_SQL = """rt(k, form, bare, named) AS (VALUES (0, '/api/users/{id}', '/api/users/{id}', '/api/users/{}'), (1, '/api/users/:id', '/api/users/:id', '/api/users/{}'), (2, '/api/orders/${x}/', '/api/orders/${x}', '/api/orders/${}/'),
(3, '/api/v1/orders/:id-no', '/api/v1/orders/:id-no', '/api/v1/orders/{}'), (4, '/api/Users/:id', '/api/Users/:id', '/api/Users/{}'), (5, '/apix/y?q=1', '/apix/y?q=1', '/apix/y?q=1'), (6, NULL, NULL, NULL), (7, NULL, NULL, NULL)),
ep AS (SELECT page_id, k, page_id % 5 <> 0 AS longer, CASE WHEN page_id % 5 = 0 OR form IS NULL THEN bare ELSE replace(concat(form, '/r', page_id % 40), '//', '/') END AS url, rtrim(named, '/') AS named, list_extract(['GET', 'POST', 'ANY'], page_id % 3 + 1) AS method FROM pages JOIN rt ON k = page_id % 8)"""


@query("SELECT 1")
def endpoint_normalize(spark, sf_dir):
    return _endpoints(spark, sf_dir).select("page_id", "url", fx.endpoint_id(F.col("url"), F.col("method")).alias("endpoint_id"))


ORACLE_SQL["endpoint_normalize"] = f"WITH {_ROUTES_SQL} SELECT page_id, url, 'endpoint:' || method || ' ' || named || CASE WHEN longer THEN concat('/r', page_id % 40) ELSE '' END AS endpoint_id FROM ep"


def _found_endpoints(spark, sf_dir) -> DataFrame:
    e = _endpoints(spark, sf_dir).filter("url is not null")
    return e.select((F.col("page_id") % 7).cast("string").alias("file"), "url", "method", F.col("page_id").alias("ord"))


@query("SELECT 1")
def endpoint_dedupe(spark, sf_dir):
    return rules.distinct_endpoints(_found_endpoints(spark, sf_dir))


_FOUND_SQL = _ROUTES_SQL + ", fe AS (SELECT CAST(page_id % 7 AS VARCHAR) AS file, url, method, page_id AS ord FROM ep WHERE url IS NOT NULL)"
ORACLE_SQL["endpoint_dedupe"] = f"WITH {_FOUND_SQL} SELECT file, url, method, MIN(ord) AS ord FROM fe a WHERE method <> 'ANY' OR NOT EXISTS (SELECT 1 FROM fe b WHERE b.file = a.file AND b.url = a.url AND b.method <> 'ANY') GROUP BY file, url, method"


@query("SELECT 1")
def endpoint_link(spark, sf_dir):
    named = _endpoints(spark, sf_dir).filter("url is not null").select(F.concat("method", F.lit(" "), "url").alias("id"), "url", "method").distinct()
    of = lambda side: named.select(F.concat(F.lit(side), "id").alias("id"), "url", "method")
    return rules.link_endpoints(of("f "), of("c "))


#: Forms that are the same endpoint have the same key: {id}, :id and ${x} are one, Users is not users.
ORACLE_SQL["endpoint_link"] = f"WITH {_ROUTES_SQL}, x AS (SELECT DISTINCT url, method, concat(CASE k WHEN 0 THEN 'u' WHEN 1 THEN 'u' ELSE CAST(k AS VARCHAR) END, CASE WHEN longer THEN concat('/', page_id % 40) END) AS key FROM ep WHERE url IS NOT NULL) SELECT concat('f ', a.method, ' ', a.url) AS src, concat('c ', b.method, ' ', b.url) AS dst FROM x a JOIN x b ON a.key = b.key AND (a.method = 'ANY' OR a.method = b.method)"


_SPECIFIERS = ["./t{}", "../{}/t{}", "../../src/{}/t{}", "./../{}/./t{}", "@zero/t{}", "lodash/t{}", "./t{}.ts", "./t{}.js"]


@query("SELECT 1")
def import_resolution(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    ending = F.get(F.array(F.lit(".ts"), F.lit("/index.ts"), F.lit(".tsx")), (F.col("doc_id") % 3).cast("int"))
    folder = F.coalesce("source", F.lit("none"))
    files = d.select(F.concat(F.lit("src/"), folder, F.lit("/t"), (F.col("doc_id") % 50).cast("string"), ending).alias("path")).union(d.select(F.concat(F.lit("t"), (F.col("doc_id") % 50).cast("string"), F.lit(".tsx"))))
    target = ((F.col("doc_id") * 7) % 50).cast("string")
    forms = []
    for form in _SPECIFIERS:
        parts = form.split("{}")
        own = [target] if len(parts) == 2 else [folder, target]
        forms.append(F.concat(F.lit(parts[0]), *(x for part, value in zip(parts[1:], own, strict=True) for x in (value, F.lit(part)))))
    file = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("top"), F.col("doc_id").cast("string"), F.lit(".ts"))).otherwise(F.concat(F.lit("src/"), folder, F.lit("/f"), F.col("doc_id").cast("string"), F.lit(".ts")))
    imports = d.select(file.alias("file"), F.get(F.array(*forms), (F.col("doc_id") % 8).cast("int")).alias("specifier"))
    return rules.resolve_imports(imports, files, [("@zero/", "src/src0/"), ("lodash/", "src/src0/")], [".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"])


ORACLE_SQL["import_resolution"] = """WITH q AS (SELECT *, COALESCE(source, 'none') AS s, CAST((doc_id * 7) % 50 AS VARCHAR) AS t FROM documents), f AS (SELECT DISTINCT concat('src/', s, '/t', doc_id % 50, list_extract(['.ts', '/index.ts', '.tsx'], doc_id % 3 + 1)) AS path FROM q UNION SELECT DISTINCT concat('t', doc_id % 50, '.tsx') FROM q),
i AS (SELECT DISTINCT CASE WHEN doc_id % 11 = 0 THEN concat('top', doc_id, '.ts') ELSE concat('src/', s, '/f', doc_id, '.ts') END AS file, doc_id % 8 AS k,
  CASE doc_id % 8 WHEN 0 THEN concat('./t', t) WHEN 1 THEN concat('../', s, '/t', t) WHEN 2 THEN concat('../../src/', s, '/t', t) WHEN 3 THEN concat('./../', s, '/./t', t) WHEN 4 THEN concat('@zero/t', t) WHEN 5 THEN concat('lodash/t', t) WHEN 6 THEN concat('./t', t, '.ts') ELSE concat('./t', t, '.js') END AS specifier,
  CASE WHEN doc_id % 8 = 4 THEN concat('src/src0/t', t) WHEN doc_id % 8 = 5 THEN NULL WHEN doc_id % 11 = 0 THEN CASE doc_id % 8 WHEN 0 THEN concat('t', t) WHEN 1 THEN concat(s, '/t', t) WHEN 2 THEN concat('src/', s, '/t', t) WHEN 3 THEN concat(s, '/t', t) WHEN 6 THEN concat('t', t, '.ts') ELSE concat('t', t, '.js') END
  WHEN doc_id % 8 = 6 THEN concat('src/', s, '/t', t, '.ts') WHEN doc_id % 8 = 7 THEN concat('src/', s, '/t', t, '.js') WHEN doc_id % 8 = 2 THEN concat('src/', s, '/t', t) ELSE concat('src/', s, '/t', t) END AS base FROM q),
c AS (SELECT file, specifier, concat(base, x.ending) AS target, x.ord FROM i, (VALUES (0, '.ts'), (1, '.tsx'), (2, '.js'), (3, '.jsx'), (4, '/index.ts'), (5, '/index.tsx'), (6, '/index.js'), (7, '/index.jsx')) x(ord, ending) WHERE base IS NOT NULL AND k < 6 UNION ALL SELECT file, specifier, base, 0 FROM i WHERE k >= 6)
SELECT file, specifier, c.target, CAST(c.ord AS INT) AS ord FROM c JOIN f ON f.path = c.target QUALIFY row_number() OVER (PARTITION BY file, specifier ORDER BY c.ord) = 1"""


@query("SELECT 1")
def request_lookup(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    wanted = table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("source"), F.get(F.array(*map(F.lit, ["red", "blue", "small", "nothing"])), (F.col("s_suppkey") % 4).cast("int")).alias("name"), F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 25).cast("string")).alias("module"))
    return rules.ranked_lookup(wanted, p.select(F.split("p_name", " ")[0].alias("name"), F.col("p_brand").alias("module"), F.concat_ws("/", "p_brand", F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("path")))


ORACLE_SQL["request_lookup"] = """WITH w AS (SELECT concat('supplier:', s_suppkey) AS source, list_extract(['red', 'blue', 'small', 'nothing'], s_suppkey % 4 + 1) AS name, concat('Brand#', s_suppkey % 25) AS module FROM supplier),
d AS (SELECT split_part(p_name, ' ', 1) AS name, p_brand AS module, concat(p_brand, '/', lpad(CAST(p_partkey AS VARCHAR), 9, '0')) AS path FROM part)
SELECT source, w.name, first(path ORDER BY CASE WHEN d.module = w.module THEN 0 ELSE 1 END, path) AS target, COUNT(*) > 1 AS ambiguous FROM w JOIN d USING (name) GROUP BY source, w.name"""


@query(r""", l AS (SELECT n_nationkey AS k, CASE n_nationkey % 3 WHEN 0 THEN concat('nation:', n_nationkey) ELSE concat('front/geo/', r_name, '/', n_name) END AS _, concat('nation:', n_nationkey) AS src, concat('supplier:', n_nationkey) AS dst, CASE WHEN n_nationkey % 4 = 0 THEN 'publishes' ELSE 'runtime-link' END AS type FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT concat_ws('::', src, type, dst) AS id, src, dst, type, 'manual' AS confidence FROM l WHERE dst IN (SELECT id FROM n)""")
def runtime_links(spark, sf_dir):
    n = cgraph.nodes(spark, sf_dir)
    pages = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    path = F.concat(F.lit("front/geo/"), "r_name", F.lit("/"), "n_name")
    key = F.col("n_nationkey")
    # Ends by id, by path, by path with backslashes and by file: and path; one link leads nowhere.
    named = F.when(key % 3 == 0, F.concat(F.lit("nation:"), key.cast("string"))).when(key % 3 == 1, F.replace(path, F.lit("/"), F.lit("\\"))).otherwise(F.concat(F.lit("file:"), path))
    links = pages.select(named.alias("from"), F.concat(F.lit("supplier:"), key.cast("string")).alias("to"), F.when(key % 4 == 0, "publishes").alias("type")).union(pages.select(F.lit("missing"), F.lit("nation:1"), F.lit(None)))
    return rules.runtime_links(links.withColumn("confidence", F.lit(None).cast("string")), n)


@query("SELECT 1")
def rule_max_lines(spark, sf_dir):
    lines = F.size(F.split("text", "\r?\n"))
    return table(spark, sf_dir, "documents").select("doc_id", lines.alias("n_lines")).filter("n_lines > 20")


ORACLE_SQL["rule_max_lines"] = r"SELECT doc_id, len(regexp_split_to_array(text, '\r?\n')) AS n_lines FROM documents WHERE len(regexp_split_to_array(text, '\r?\n')) > 20"


@query("SELECT 1")
def rule_token_hits(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("at", F.instr("text", "token = ")).filter("at > 0")
    return d.select("doc_id", fx.line_of(F.col("text"), F.col("at")).cast("long").alias("line"), F.size(F.split("text", "token = ")).cast("long").alias("parts"))


ORACLE_SQL["rule_token_hits"] = r"SELECT doc_id, len(text[:strpos(text, 'token = ') - 1]) - len(replace(text[:strpos(text, 'token = ') - 1], chr(10), '')) + 1 AS line, len(string_split(text, 'token = ')) AS parts FROM documents WHERE strpos(text, 'token = ') > 0"

_SUPPRESSED_SQL = r", sn AS (SELECT *, CASE WHEN regexp_full_match(path, 'back/repositories/Brand#1[^/]*/.*') AND rule_id = 'size.large' THEN 1 WHEN regexp_full_match(path, 'back/.*/STANDARD/[^/]*') THEN 2 WHEN rule_id = 'type.economy' THEN 3 END AS s FROM fi), su AS (SELECT * EXCLUDE (s), CASE s WHEN 1 THEN 'legacy' WHEN 2 THEN 'generated' WHEN 3 THEN 'planned' END AS reason, CASE s WHEN 1 THEN 'size.large' WHEN 3 THEN 'type.economy' END AS suppression_rule, CASE s WHEN 1 THEN 'back/repositories/Brand#1*/**' WHEN 2 THEN 'back/**/STANDARD/*' END AS suppression_path, CASE s WHEN 2 THEN '2999-12-31' END AS expires FROM sn)"


@query(_SUPPRESSED_SQL + " SELECT *, reason IS NOT NULL AS suppressed FROM su")
def finding_suppression(spark, sf_dir):
    return rules.suppressed(cgraph.findings(spark, sf_dir), SUPPRESSIONS)


@query(" SELECT id, severity, path, line, rule_id FROM fi ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, path, line, rule_id")
def findings_sorted(spark, sf_dir):
    return cgraph.findings(spark, sf_dir).select("id", "severity", "path", "line", "rule_id").orderBy(*rules.finding_order())


@query(" SELECT CASE WHEN starts_with(path, 'front/') THEN 'front' WHEN starts_with(path, 'back/') THEN 'back' ELSE 'other' END AS scope, severity, COUNT(*) AS n FROM fi GROUP BY ALL")
def findings_by_scope(spark, sf_dir):
    scope = F.when(F.col("path").startswith("front/"), "front").when(F.col("path").startswith("back/"), "back").otherwise("other")
    return cgraph.findings(spark, sf_dir).groupBy(scope.alias("scope"), "severity").agg(F.count("*").alias("n"))


@query(" SELECT n.id, n.module, COUNT(*) AS n FROM n JOIN fi ON fi.node_id = n.id WHERE contains(lower(concat_ws(' ', n.label, n.path, n.id, n.module, n.layer, n.type)), 'ring') GROUP BY ALL")
def findings_search(spark, sf_dir):
    n = cgraph.nodes(spark, sf_dir).filter(F.contains(F.lower(F.concat_ws(" ", "label", "path", "id", "module", "layer", "type")), F.lit("ring")))
    return n.join(cgraph.findings(spark, sf_dir).select("node_id"), F.col("id") == F.col("node_id")).groupBy("id", "module").agg(F.count("*").alias("n"))


@query("SELECT 1")
def coverage_by_source(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("source"))
    lab = table(spark, sf_dir, "labels")
    tests = lab.select(F.concat(F.lit("test_"), (F.col("doc_id") % 9).cast("string")).alias("test"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("source"), (F.col("quality") + 1).alias("cases"))
    return measure.coverage_by_source(d, tests.union(tests.select("test", F.lit("doc_0"), F.lit(1)).distinct()).union(tests.select("test", F.lit("doc_none"), "cases")))


ORACLE_SQL["coverage_by_source"] = """WITH t AS (SELECT concat('test_', doc_id % 9) AS test, concat('doc_', doc_id) AS source, quality + 1 AS cases FROM labels),
u AS (SELECT * FROM t UNION ALL SELECT DISTINCT test, 'doc_0', 1 FROM t UNION ALL SELECT test, 'doc_none', cases FROM t), k AS (SELECT test, MAX(cases) AS cases FROM u GROUP BY test), p AS (SELECT DISTINCT test, source FROM u)
SELECT source, string_agg(test, ',' ORDER BY test) AS tests, CAST(SUM(cases) AS BIGINT) AS n_cases FROM p JOIN k USING (test) WHERE source IN (SELECT concat('doc_', doc_id) FROM documents) GROUP BY source"""


@query("SELECT 1")
def unique_bindings(spark, sf_dir):
    return measure.unique_bindings(table(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" "), F.col("p_size").cast("string")).alias("name"), F.col("p_brand").alias("value")))


ORACLE_SQL["unique_bindings"] = "SELECT concat(p_name, ' ', p_size) AS name, MIN(p_brand) AS value FROM part GROUP BY 1 HAVING COUNT(DISTINCT p_brand) = 1"


@query("SELECT 1")
def latest_revision(spark, sf_dir):
    return measure.latest_revisions(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("revision"), "role"))


ORACLE_SQL["latest_revision"] = "SELECT conv_id AS id, turn AS revision, role, COUNT(*) OVER (PARTITION BY conv_id) AS n_revisions FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1"


@query(r" SELECT id FROM n WHERE regexp_full_match(path, 'front/([^/]*/)*[^/]*#00000001[^/]') OR regexp_full_match(path, 'back/[^/]*/Brand#[^/]/.*')")
def glob_select(spark, sf_dir):
    return traverse.Selector(paths=("front/**/*#00000001?", "back/*/Brand#?/**")).ids(cgraph.nodes(spark, sf_dir))


def _lines(spark, sf_dir) -> DataFrame:
    n, e = _graph(spark, sf_dir)
    line = lambda kind, df, *c: df.select(F.concat(F.lit(kind), F.lit("\x1f"), fx.canonical_line(*c)).alias("line"))
    return line("node", n, "id", "label", "type", "layer", "module", "path").union(line("edge", e, "id", "confidence"))


@query(""", li AS (SELECT concat('node', chr(31), concat_ws(chr(31), '=' || id, '=' || label, '=' || type, '=' || layer, '=' || module, COALESCE('=' || path, '~'))) AS line FROM n UNION ALL SELECT concat('edge', chr(31), concat_ws(chr(31), '=' || id, '=' || confidence)) FROM e),
bk AS (SELECT sha256(line)[1:2] AS b, sha256(string_agg(line, chr(10) ORDER BY line)) AS d FROM li GROUP BY 1) SELECT concat('sha256:', sha256(string_agg(concat(b, ' ', d), chr(10) ORDER BY b))) AS digest FROM bk""")
def graph_digest(spark, sf_dir):
    return measure.digest(_lines(spark, sf_dir))


# Layouts

_ROWS_SQL = ", ro AS (SELECT id, module, layer, row_number() OVER (PARTITION BY module, layer ORDER BY label, id) - 1 AS row, (row_number() OVER (PARTITION BY module, layer ORDER BY label, id) - 1) * 76 AS y FROM n)"
_BANDS_SQL = _ROWS_SQL + ", ba AS (SELECT module, (MAX(row) + 1) * 76 AS height FROM ro GROUP BY module)"


@query(_ROWS_SQL + " SELECT * FROM ro")
def layout_layered_rows(spark, sf_dir):
    return layout.rows(cgraph.nodes(spark, sf_dir))


@query(_BANDS_SQL + " SELECT module, height, CAST(COALESCE(SUM(height) OVER (ORDER BY module ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS top FROM ba")
def module_bands(spark, sf_dir):
    return layout.bands(layout.rows(cgraph.nodes(spark, sf_dir)))


@query(" SELECT id, CASE WHEN id IN (SELECT dst FROM e JOIN n a ON a.id = src JOIN n b ON b.id = dst WHERE a.module = b.module AND a.layer = b.layer) THEN 1 ELSE 0 END AS level FROM n")
def layout_levels(spark, sf_dir):
    return layout.levels(*_graph(spark, sf_dir))


@query(" SELECT module, (row_number() OVER (ORDER BY module) - 1) % 5 * 200 AS x, CAST(floor((row_number() OVER (ORDER BY module) - 1) / 5.0) * 120 AS BIGINT) AS y FROM (SELECT DISTINCT module FROM n)")
def system_grid(spark, sf_dir):
    return layout.grid(cgraph.nodes(spark, sf_dir).select("module").distinct(), "module", 5, 200, 120)


@query(" SELECT id FROM (SELECT id FROM n ORDER BY id LIMIT 400) UNION SELECT id FROM n WHERE type = 'table'")
def render_limit(spark, sf_dir):
    n = cgraph.nodes(spark, sf_dir)
    return layout.limited(n, 400, n.filter("type = 'table'"))


@query(_ROWS_SQL + " SELECT MIN(row * 10.0) AS min_x, MAX(row * 10.0) AS max_x, MIN(CAST(y AS DOUBLE)) AS min_y, MAX(CAST(y AS DOUBLE)) AS max_y, greatest(0.2, least(1.0, least(1600 / greatest(1.0, MAX(row * 10.0) - MIN(row * 10.0)), 900 / greatest(1.0, CAST(MAX(y) - MIN(y) AS DOUBLE))))) AS zoom FROM ro")
def viewport_fit(spark, sf_dir):
    placed = layout.rows(cgraph.nodes(spark, sf_dir)).select((F.col("row") * 10.0).cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return layout.viewport(placed, 1600.0, 900.0)


for _name in [k for k, v in ORACLE_SQL.items() if v.endswith("SELECT 1")]:
    del ORACLE_SQL[_name]
