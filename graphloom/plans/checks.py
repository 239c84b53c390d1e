"""Registered queries: stored subgraphs checked and compared, architecture rules, views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import guardrails, layout, measure, submaps, views
from ..sources.work import cut
from . import cgraph
from .cgraph import table
from .queries import ENTRY_PATHS, FOLDER, ORACLE_SQL, SUFFIXES, _graph, query

# Stored subgraphs: one module's nodes, with faults that the checks must find.


def _stored(spark, sf_dir, module: str = "NATION_7", changed: bool = True) -> submaps.Stored:
    n, e = _graph(spark, sf_dir)
    own = cut(n.filter(F.col("module") == module))
    ids = own.select("id")
    inner = cut(e.join(ids.select(F.col("id").alias("src")), "src", "left_semi").select("id", "src", "dst", "type", "confidence"))
    level = F.when(F.col("type") == "handler", "editable").when(F.col("type") == "component", "readable")
    access = own.select("id", level.alias("level")).filter("level is not null").union(own.filter("type = 'handler'").select("id", F.lit("forbidden")))
    bounds = inner.join(ids.select(F.col("id").alias("dst")), "dst", "left_anti").select(F.col("id").alias("edge_id"), F.col("src").alias("inside_id"), F.col("dst").alias("outside_id"))
    label = F.when(F.col("type") == "component", F.upper("label")).otherwise(F.lower("label")) if changed else F.col("label")
    nodes = own.withColumn("label", label).union(own.filter("type = 'handler'"))
    stats = spark.createDataFrame([("nodes", 0), ("edges", -1), ("findings", 0), ("editable", None)], "field string, value long")
    return submaps.Stored(nodes, inner, cgraph.findings(spark, sf_dir).filter("line = 50"), bounds, access, n.filter("type = 'page'").select("id"), ids.limit(0), stats)


_STORED_SQL = """, own AS (SELECT * FROM n WHERE module = 'NATION_7'), st_n AS (SELECT * FROM own UNION ALL SELECT * FROM own WHERE type = 'handler'), st_e AS (SELECT e.* FROM e WHERE src IN (SELECT id FROM own)),
st_f AS (SELECT * FROM fi WHERE line = 50), st_x AS (SELECT id AS edge_id, src AS inside_id, dst AS outside_id FROM st_e WHERE dst NOT IN (SELECT id FROM own)),
st_a AS (SELECT id, CASE type WHEN 'handler' THEN 'editable' ELSE 'readable' END AS level FROM own WHERE type IN ('handler', 'component') UNION ALL SELECT id, 'forbidden' FROM own WHERE type = 'handler')"""


@query(_STORED_SQL + """, counts AS (SELECT 'nodes' AS field, (SELECT COUNT(*) FROM st_n) AS expected UNION ALL SELECT 'edges', (SELECT COUNT(*) FROM st_e) UNION ALL SELECT 'findings', (SELECT COUNT(*) FROM st_f) UNION ALL SELECT 'boundaries', (SELECT COUNT(*) FROM st_x)
  UNION ALL SELECT level, (SELECT COUNT(*) FROM st_a WHERE st_a.level = l.level) FROM (VALUES ('forbidden'), ('generated'), ('editable'), ('readable'), ('external')) l(level)), given(field, value) AS (VALUES ('nodes', 0), ('edges', -1), ('findings', 0), ('editable', NULL))
SELECT 'SUBMAP_DUPLICATE_NODE_ID' AS code, id AS subject, CAST(NULL AS VARCHAR) AS detail FROM own WHERE type = 'handler'
UNION ALL SELECT 'SUBMAP_EDGE_ENDPOINT_MISSING', id, dst FROM st_e WHERE dst NOT IN (SELECT id FROM own)
UNION ALL SELECT 'SUBMAP_FINDING_NODE_MISSING', id, node_id FROM st_f WHERE node_id NOT IN (SELECT id FROM own)
UNION ALL SELECT 'SUBMAP_ORPHAN_NODE_MISSING', id, id FROM n WHERE type = 'page' AND id NOT IN (SELECT id FROM own)
UNION ALL SELECT 'SUBMAP_BOUNDARY_EDGE_INCLUDED', edge_id, NULL FROM st_x
UNION ALL SELECT 'SUBMAP_ACCESS_CONFLICT', id, NULL FROM own WHERE type = 'handler'
UNION ALL SELECT 'SUBMAP_ACCESS_UNCLASSIFIED', id, NULL FROM own WHERE id NOT IN (SELECT id FROM st_a)
UNION ALL SELECT 'SUBMAP_STATISTICS_MISMATCH', field, CAST(expected AS VARCHAR) FROM counts LEFT JOIN given USING (field) WHERE value IS DISTINCT FROM expected""")
def submap_content_issues(spark, sf_dir):
    return submaps.content_issues(_stored(spark, sf_dir, changed=False))


@query(_STORED_SQL + """, cur AS (SELECT * FROM n WHERE type <> 'endpoint' OR path LIKE 'api/O/%')
SELECT 'error' AS severity, 'SUBMAP_SOURCE_NODE_MISSING' AS code, id AS subject FROM own WHERE id NOT IN (SELECT id FROM cur)
UNION ALL SELECT 'warning', 'SUBMAP_SOURCE_NODE_CHANGED', id FROM own JOIN cur USING (id) WHERE CASE own.type WHEN 'component' THEN upper(own.label) ELSE lower(own.label) END <> own.label
UNION ALL SELECT 'warning', 'SUBMAP_SOURCE_EDGE_CHANGED', id FROM st_e WHERE type = 'handled-by'""")
def submap_against_graph(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    stored = _stored(spark, sf_dir)
    once = submaps.Stored(stored.nodes.dropDuplicates(["id", "label"]).filter("type <> 'handler' or label = lower(label)"), stored.edges, stored.findings, stored.boundaries, stored.access, stored.orphans, stored.seeds, stored.statistics)
    current = e.withColumn("confidence", F.when(F.col("type") == "handled-by", "low").otherwise(F.col("confidence")))
    return submaps.against_graph(once, n.filter("type <> 'endpoint' or path like 'api/O/%'"), current)


_TWO_SQL = """, a_n AS (SELECT * FROM n WHERE module = 'NATION_7'), b_n AS (SELECT * FROM n WHERE module = 'NATION_8'), a_e AS (SELECT * FROM e WHERE src IN (SELECT id FROM a_n)), b_e AS (SELECT * FROM e WHERE src IN (SELECT id FROM b_n)),
d AS (SELECT 'node' AS part, 'added' AS change, id AS key FROM b_n UNION ALL SELECT 'node', 'removed', id FROM a_n UNION ALL SELECT 'edge', 'added', id FROM b_e UNION ALL SELECT 'edge', 'removed', id FROM a_e
UNION ALL SELECT 'access', CASE type WHEN 'handler' THEN 'editable>' ELSE 'readable>' END, id FROM a_n WHERE type IN ('handler', 'component') UNION ALL SELECT 'access', CASE type WHEN 'handler' THEN '>editable' ELSE '>readable' END, id FROM b_n WHERE type IN ('handler', 'component'))"""


@query(_TWO_SQL + " SELECT * FROM d")
def submap_difference(spark, sf_dir):
    return submaps.difference(_stored(spark, sf_dir), _stored(spark, sf_dir, "NATION_8"))


@query(_TWO_SQL + """ SELECT (SELECT COUNT(*) FROM b_n) AS nodes_added, (SELECT COUNT(*) FROM a_n) AS nodes_removed, (SELECT COUNT(*) FROM b_e) AS edges_added, (SELECT COUNT(*) FROM a_e) AS edges_removed, 0 AS findings_added, 0 AS findings_removed,
(SELECT COUNT(*) FROM d WHERE part = 'access') AS access_changes, (SELECT COUNT(*) FROM a_e WHERE dst NOT IN (SELECT id FROM a_n)) AS boundaries_before, (SELECT COUNT(*) FROM b_e WHERE dst NOT IN (SELECT id FROM b_n)) AS boundaries_after, TRUE AS changed,
(SELECT COUNT(*) FROM b_n) - (SELECT COUNT(*) FROM a_n) AS node_delta, (SELECT COUNT(*) FROM b_e) - (SELECT COUNT(*) FROM a_e) AS edge_delta""")
def submap_difference_summary(spark, sf_dir):
    return submaps.difference_summary(_stored(spark, sf_dir), _stored(spark, sf_dir, "NATION_8"))


@query(_STORED_SQL + " SELECT module, COUNT(*) AS n_nodes FROM st_n GROUP BY module")
def submap_inspect(spark, sf_dir):
    return submaps.inspected(_stored(spark, sf_dir))


# Architecture rules over documents seen as source files

_KINDS = ("component", "main-component", "repository", "hook")
_IMPORTS = ("@/features/s1/components/X", "@/features/s2", "@features/s3/public", "@/features/s1/types/a", "react", "./near", "@features/s0/api", "@/shared/pages")
_USINGS = ("Shop.API.Web", "Shop.APIs", "Shop.Application", "System.Linq", "Shop.Infrastructure.Db")
OPTIONS = guardrails.Options(exclude=("/generated/",), allowed_edges=(("source_1", "s0", ()), ("source_2", "s1", ("/components/",))), namespace_prefix="Shop")


def _sources(spark, sf_dir) -> DataFrame:
    d, pick = table(spark, sf_dir, "documents"), lambda values, by: F.get(F.array(*map(F.lit, values)), (by % len(values)).cast("int"))
    i = F.col("doc_id")
    folder = pick(("components/CartMain/index.tsx", "components/Cart.tsx", "generated/Old.jsx", "api/cart.ts"), F.floor(i / 4))
    path = F.concat(F.lit("front/features/"), F.coalesce("source", F.lit("none")), F.lit("/d"), i.cast("string"), F.lit("/"), folder)
    back = F.concat(F.lit("back/"), pick(("Shop.Domain", "Shop.Application", "Shop.API"), i), F.lit("/d"), i.cast("string"), F.lit(".cs"))
    return d.select(path.alias("path"), back.alias("back"), pick(_KINDS, i).alias("type"), pick(_IMPORTS, F.floor(i / 3)).alias("name"), pick(_USINGS, F.floor(i / 2)).alias("using"), (i % 90 + 1).cast("string").alias("line"))


def _list_sql(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_SOURCES_SQL = f"""WITH s AS (SELECT concat('front/features/', COALESCE(source, 'none'), '/d', doc_id, '/', (['components/CartMain/index.tsx', 'components/Cart.tsx', 'generated/Old.jsx', 'api/cart.ts'])[doc_id // 4 % 4 + 1]) AS path, concat('back/', (['Shop.Domain', 'Shop.Application', 'Shop.API'])[doc_id % 3 + 1], '/d', doc_id, '.cs') AS back,
({_list_sql(_KINDS)})[doc_id % 4 + 1] AS type, ({_list_sql(_IMPORTS)})[doc_id // 3 % 8 + 1] AS name, ({_list_sql(_USINGS)})[doc_id // 2 % 5 + 1] AS usi, CAST(doc_id % 90 + 1 AS INTEGER) AS line, COALESCE(source, 'none') AS feature FROM documents) """


@query()
def rule_folder_entry(spark, sf_dir):
    return guardrails.folder_entries(_sources(spark, sf_dir), OPTIONS)


ORACLE_SQL["rule_folder_entry"] = _SOURCES_SQL + "SELECT 'framework.react.component-folder-entry' AS rule_id, path, CAST(1 AS INTEGER) AS line, 'Cart.tsx' AS evidence FROM s WHERE type IN ('component', 'main-component') AND path LIKE '%/Cart.tsx'"


@query()
def rule_thin_view(spark, sf_dir):
    s = _sources(spark, sf_dir)
    return guardrails.thin_views(s, s.select("path", "name", "line"), OPTIONS)


ORACLE_SQL["rule_thin_view"] = _SOURCES_SQL + "SELECT 'architecture.mvvm.thin-view-entry' AS rule_id, path, line, name AS evidence FROM s WHERE type = 'main-component' AND path LIKE '%/CartMain/index.tsx'"


@query()
def rule_hook_naming(spark, sf_dir):
    s = _sources(spark, sf_dir)
    return guardrails.hook_names(s, s.select("path", F.when(F.col("line").cast("int") > 40, "useCartMain").otherwise("useCart").alias("name")), OPTIONS)


ORACLE_SQL["rule_hook_naming"] = _SOURCES_SQL + "SELECT 'architecture.mvvm.viewmodel-hook-naming' AS rule_id, path, CAST(1 AS INTEGER) AS line, 'useCartMain' AS evidence FROM s WHERE type = 'main-component' AND path LIKE '%/CartMain/index.tsx' AND line <= 40"


@query()
def rule_cross_feature(spark, sf_dir):
    return guardrails.cross_features(_sources(spark, sf_dir).select("path", "name", "line"), "front/features/([^/]+)", OPTIONS)


ORACLE_SQL["rule_cross_feature"] = _SOURCES_SQL + """SELECT 'architecture.feature-sliced.no-cross-feature-internals' AS rule_id, path, line, name AS evidence FROM s
WHERE (name = '@/features/s1/components/X' AND feature NOT IN ('s1', 'source_2')) OR (name = '@features/s0/api' AND feature NOT IN ('s0', 'source_1'))"""


@query()
def rule_ui_imports(spark, sf_dir):
    s = _sources(spark, sf_dir)
    return guardrails.ui_imports(s, s.select("path", "name", "line"), OPTIONS)


ORACLE_SQL["rule_ui_imports"] = _SOURCES_SQL + "SELECT 'architecture.layered.no-ui-imports-in-data-adapters' AS rule_id, path, line, name AS evidence FROM s WHERE type = 'repository' AND name IN ('@/features/s1/components/X', 'react', '@/shared/pages')"


@query()
def rule_layer_boundaries(spark, sf_dir):
    s = _sources(spark, sf_dir)
    return guardrails.layer_boundaries(s.select(F.col("back").alias("path"), F.col("using").alias("name"), "line"), OPTIONS)


ORACLE_SQL["rule_layer_boundaries"] = _SOURCES_SQL + """SELECT 'architecture.clean-architecture.layer-boundaries' AS rule_id, back AS path, line, concat('using ', CASE usi WHEN 'Shop.API.Web' THEN 'Shop.API' WHEN 'Shop.Infrastructure.Db' THEN 'Shop.Infrastructure' ELSE usi END) AS evidence FROM s
WHERE (back LIKE 'back/Shop.Domain/%' AND usi IN ('Shop.API.Web', 'Shop.Application', 'Shop.Infrastructure.Db')) OR (back LIKE 'back/Shop.Application/%' AND usi = 'Shop.API.Web')"""


# Views


@query(" SELECT * FROM n WHERE type IN ('component', 'handler', 'table') AND (contains(lower(concat_ws(chr(10), label, path, id, module, layer, type)), 'nation_1') ) AND id IN (SELECT src FROM e UNION SELECT dst FROM e) AND id NOT IN (SELECT node_id FROM fi)")
def nodes_filtered(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    used = e.select(F.col("src").alias("id")).union(e.select("dst"))
    reported = cgraph.findings(spark, sf_dir).select(F.col("node_id").alias("id"))
    return views.filtered(n, views.Filter(types=("component", "handler", "table"), text=" Nation_1 ", hide_auxiliary=True, among=(used,), lacking=(reported,))).select("id", "label", "type", "layer", "module", "path")


@query(" SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY module, layer ORDER BY label, id) - 1 AS row FROM n) WHERE row * 10 + 30 BETWEEN 100 AND 200 AND row * 76 + 28 BETWEEN 700 AND 1000")
def nodes_in_rectangle(spark, sf_dir):
    placed = layout.rows(cgraph.nodes(spark, sf_dir)).select("id", (F.col("row") * 10).alias("x"), "y", F.lit(60).alias("width"), F.lit(56).alias("height"))
    return views.inside_rectangle(placed, 100, 700, 200, 1000)


def _narrated(spark, sf_dir) -> DataFrame:
    n, e = map(cut, _graph(spark, sf_dir))
    seen = measure.quality_evidence(n, e, FOLDER, ENTRY_PATHS, SUFFIXES)
    return views.narratives(n, e, seen.select("id", F.col("internal").alias("internal_relations"), F.col("external").alias("external_relations"), "outgoing", "incoming", F.lit(False).alias("inside_folder")))


@query(""", j AS (SELECT DISTINCT e.src, e.dst, a.module AS sm, b.module AS dm, a.label AS sl, b.label AS dl FROM e JOIN n a ON a.id = src JOIN n b ON b.id = dst), bo AS (SELECT src AS id, dst AS other, sm AS own, dm AS module, dl AS label, TRUE AS o FROM j UNION ALL SELECT dst, src, dm, sm, sl, FALSE FROM j),
x AS (SELECT id, COUNT(DISTINCT module) AS k, string_agg(DISTINCT module, ', ' ORDER BY module) AS names FROM bo WHERE own <> module GROUP BY id), y AS (SELECT id, string_agg(label, ', ' ORDER BY label, other) AS labels FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY label, other) AS r FROM bo WHERE own <> module AND o) WHERE r <= 6 GROUP BY id),
z AS (SELECT id, string_agg(other, ' ' ORDER BY other) AS related FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY other) AS r FROM (SELECT DISTINCT id, other FROM bo)) WHERE r <= 8 GROUP BY id),
p AS (SELECT id FROM n WHERE type NOT IN ('entity', 'table')), c AS (SELECT id, COUNT(*) FILTER (o) AS outgoing, COUNT(*) FILTER (NOT o) AS incoming, COUNT(*) FILTER (own = module) AS internal, COUNT(*) FILTER (own <> module) AS external FROM bo WHERE id IN (SELECT id FROM p) AND other IN (SELECT id FROM p) GROUP BY id)
SELECT q.id, concat(COALESCE(internal, 0), ' relations inside module ', n.module, '; ', COALESCE(external, 0), ' relations outside module; ', COALESCE(outgoing, 0), ' outgoing dependencies; ', COALESCE(incoming, 0), ' detected usages') AS cohesion,
concat(COALESCE(outgoing, 0), ' outgoing dependencies; ', COALESCE(k, 0), ' external modules: ', COALESCE(names, 'none'), COALESCE('; external deps: ' || labels, '')) AS coupling, COALESCE(related, '') AS related
FROM n q JOIN n USING (id) LEFT JOIN c ON c.id = q.id LEFT JOIN x ON x.id = q.id LEFT JOIN y ON y.id = q.id LEFT JOIN z ON z.id = q.id WHERE q.type IN ('route', 'page', 'component', 'handler', 'repository')""")
def quality_narratives(spark, sf_dir):
    return _narrated(spark, sf_dir).withColumn("related", F.array_join("related", " "))


def _parts(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    folder = F.when(k % 3 == 0, F.concat(F.lit("Box"), (k % 40).cast("string"), F.lit("/_inner/Part"), k.cast("string"), F.lit(".tsx"))).otherwise(F.concat(F.lit("Box"), (k % 50).cast("string"), F.lit("/index.tsx")))
    return c.select(F.concat(F.lit("c:"), k.cast("string")).alias("id"), F.lit("component").alias("type"), F.concat(F.lit("m"), F.col("c_nationkey").cast("string")).alias("module"), F.concat(F.lit("front/components/"), folder).alias("path"), k.alias("key"))


@query()
def internal_parents(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    links = parts.filter("key % 7 = 0").select(F.concat(F.lit("c:"), (F.col("key") + 1).cast("string")).alias("src"), F.col("id").alias("dst"))
    return views.internal_parents(parts, links)


ORACLE_SQL["internal_parents"] = """WITH p AS (SELECT concat('c:', c_custkey) AS id, c_custkey AS k, concat('m', c_nationkey) AS module, c_custkey % 3 = 0 AS internal FROM customer), o AS (SELECT * FROM p WHERE NOT internal),
t0 AS (SELECT p.id, (SELECT MIN(o.id) FROM o WHERE o.k % 50 = p.k % 40) AS parent FROM p WHERE internal), t1 AS (SELECT p.id, o.id AS parent FROM p JOIN o ON o.k = p.k + 1 AND o.module = p.module WHERE p.internal AND p.k % 7 = 0),
t2 AS (SELECT module, arg_min(id, (concat('Box', k % 50, '/'), id)) AS parent FROM o GROUP BY module)
SELECT p.id, COALESCE(t0.parent, t1.parent, t2.parent) AS parent, CAST(CASE WHEN t0.parent IS NOT NULL THEN 0 WHEN t1.parent IS NOT NULL THEN 1 WHEN t2.parent IS NOT NULL THEN 2 END AS INTEGER) AS tier FROM p LEFT JOIN t0 ON t0.id = p.id LEFT JOIN t1 ON t1.id = p.id LEFT JOIN t2 ON t2.module = p.module WHERE internal"""


@query()
def domain_order(spark, sf_dir):
    """Nodes of the whole graph in the order of a domain view; without SQL, as components are transitive."""
    n, e = _graph(spark, sf_dir)
    return views.domain_order(n, e.filter("type = 'queries-table'"), cut)
