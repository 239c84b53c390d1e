"""Registered queries over project maps and templates: a map for each customer in eight forms, a list of templates in six."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import projectmaps, templates
from ..sources.work import cut
from .cgraph import table
from .sources import _query

MAPS = [
    '{"schemaVersion":1,"project":{"name":"Shop <c>"},"sourceRoots":{"frontend":"front/src"}}',
    '{"schemaVersion":1,"project":{"name":"N<n>","graphOutput":"out/<c>.json","runtimeLinks":"links.json"},"sourceRoots":{"frontend":"web","backend":"api"},"ignoredDirs":["tmp","n<n>"],"templates":{"enabled":["react","nation.<n>"]},'
    '"imports":{"aliases":[{"prefix":"@/","path":"web"},{"prefix":"~n<n>/","path":"kit"}]},"layers":[{"id":"a","label":"A <n>"}],"modules":{"shared":"core<n>"},"frontend":{"entryPoints":["web/main.ts"]},"rules":{"enabled":["r<n>"],"options":{"max":<n>}}}',
    '{"schemaVersion":2,"project":{"name":""},"sourceRoots":{"frontend":"f","side":"<n>","extra":1}}',
    '{"schemaVersion":1,"project":{"name":"x"},"sourceRoots":{"frontend":"f"},"imports":{"aliases":[{"prefix":"@","path":"p"},{"prefix":" ","n<n>":1}]},"layers":[]}',
    '{"schemaVersion":1,"project":[<c>],"sourceRoots":null,"backend":"<c>"}',
    '{"schemaVersion":1,"project":{"name":"cut <c>',
    '[<c>]',
    '{"schemaVersion":1,"project":{"name":"x"},"sourceRoots":{"frontend":"f"},"rules":{"suppressions":[{"reason":"r"},<n>,{"ruleId":<n>}]},"templates":{"enabled":["a",""]}}',
]


def project_maps_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, text of every customer's map."""
    c = F.col("c_custkey")
    text = F.get(F.array(*map(F.lit, MAPS)), (c % 8).cast("int"))
    for name, value in (("c", c), ("n", F.col("c_nationkey"))):
        text = F.replace(text, F.lit(f"<{name}>"), value.cast("string"))
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("r"), c.cast("string")).alias("repo"), text.alias("text"))


@_query("""SELECT concat('r', c_custkey) AS repo, CASE c_custkey % 8
WHEN 2 THEN 'Only project map schema version 1 is supported.|project.name is required.|sourceRoots contains unknown properties: extra, side.'
WHEN 3 THEN concat('imports.aliases[1].prefix must be a non-empty string.|imports.aliases[1].path must be a non-empty string.|imports.aliases[1] contains unknown properties: n', c_nationkey, '.|layers must contain at least one layer when provided.')
WHEN 4 THEN 'project must be an object.|project.name is required.|sourceRoots must be an object.|sourceRoots.frontend is required.|backend must be an object.'
WHEN 5 THEN 'Project map is no readable JSON.' WHEN 6 THEN 'Project map must be a JSON object.'
WHEN 7 THEN 'templates.enabled must contain only non-empty strings.|rules.suppressions[1] must be an object.|rules.suppressions[2].reason must be a non-empty string.|rules.suppressions[2].ruleId must be a string.'
ELSE '' END AS issues FROM customer""")
def project_map_issues(spark, sf_dir):
    """What is wrong with each project map, in order."""
    return projectmaps.judged(project_maps_text(spark, sf_dir)).select("repo", F.array_join("issues", "|").alias("issues"))


@_query("""SELECT concat('r', c_custkey) AS repo, concat(name, c_nationkey_or_key) AS name, graph_output, runtime_links, f.frontend_root, backend_root, templates, ignored_dirs, aliases, layers, shared_module, entry_points, options, n_infrastructure FROM (
SELECT *, c_custkey % 8 AS form, CASE c_custkey % 8 WHEN 0 THEN c_custkey ELSE c_nationkey END AS c_nationkey_or_key,
CASE c_custkey % 8 WHEN 0 THEN '.code-map/graph.json' ELSE concat('out/', c_custkey, '.json') END AS graph_output,
CASE c_custkey % 8 WHEN 0 THEN 'filesystem,typescript,react,architecture.feature-sliced,architecture.mvvm,http-endpoints,csharp,dotnet-api,architecture.mvc,architecture.clean-architecture,architecture.cqrs,entity-framework,coverage,quality' ELSE concat('react,nation.', c_nationkey) END AS templates,
CASE c_custkey % 8 WHEN 0 THEN 'node_modules,dist,build,coverage,bin,obj,.git' ELSE concat('tmp,n', c_nationkey) END AS ignored_dirs,
CASE c_custkey % 8 WHEN 0 THEN '' ELSE concat('@/=web,~n', c_nationkey, '/=kit') END AS aliases, CASE c_custkey % 8 WHEN 0 THEN '' ELSE concat('a=A ', c_nationkey) END AS layers,
CASE c_custkey % 8 WHEN 0 THEN 'shared' ELSE concat('core', c_nationkey) END AS shared_module, CASE c_custkey % 8 WHEN 0 THEN '{}' ELSE concat('{"max":', c_nationkey, '}') END AS options FROM customer) x
JOIN (VALUES (0, 'Shop ', 'front/src', '', '', '', 36), (1, 'N', 'web', 'api', 'links.json', 'web/main.ts', 36)) f(form, name, frontend_root, backend_root, runtime_links, entry_points, n_infrastructure) USING (form)""")
def project_map_defaults(spark, sf_dir):
    """Each sound project map with what holds where it says nothing."""
    pairs = lambda c, a, b: F.array_join(F.transform(c, lambda x: F.concat_ws("=", x[a], x[b])), ",").alias(c)
    listed = lambda c: F.array_join(c, ",").alias(c)
    plain = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return projectmaps.normalized(project_maps_text(spark, sf_dir)).select(
        "repo", "name", "graph_output", plain("runtime_links"), "frontend_root", plain("backend_root"), listed("templates"), listed("ignored_dirs"), pairs("aliases", "prefix", "path"), pairs("layers", "id", "label"),
        "shared_module", listed("entry_points"), F.col("rules_options").alias("options"), F.size("infrastructure_folders").alias("n_infrastructure"),
    )


REQUIRES = {"base": [], "typescript": ["base"], "react": ["typescript"], "csharp": ["base"], "csharp-api": ["csharp"], "ring.a": ["base", "ring.b"], "ring.b": ["ring.c"], "ring.c": ["ring.b"], "owner": ["missing"]}
WANTED = [["react", "nation.<n>"], ["nation.<n>", "csharp-api", "base", "react"], ["ring.a"], ["nation.<n>", "gone.<c>"], ["base"], ["react", "owner", "ring.a"]]


def _expanded(spark: SparkSession, sf_dir: str) -> templates.Expanded:
    """The customers' lists; a template for each nation requires TypeScript and its region's."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    own = F.concat(F.lit("nation."), F.col("n_nationkey").cast("string"))
    region = F.concat(F.lit("region."), F.col("n_regionkey").cast("string"))
    fixed = spark.createDataFrame([(t, n) for t, n in REQUIRES.items()], "template string, needs array<string>")
    every = fixed.union(nation.select(own, F.array(F.lit("typescript"), region))).union(nation.select(region, F.array(F.lit("base"))).distinct())
    listed = F.get(F.array(*(F.array(*map(F.lit, w)) for w in WANTED)), (F.col("c_custkey") % 6).cast("int"))
    filled = F.transform(listed, lambda t: F.replace(F.replace(t, F.lit("<n>"), F.col("c_nationkey").cast("string")), F.lit("<c>"), F.col("c_custkey").cast("string")))
    maps = customer.select(F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("repo"), filled.alias("templates"))
    return templates.expanded(templates.enabled(maps), every, every.select("template", F.posexplode("needs").alias("pos", "needs")))


@_query("""SELECT concat('r', c_custkey) AS project, CASE c_custkey % 6 WHEN 0 THEN concat('base,typescript,react,region.', n_regionkey, ',nation.', n_nationkey)
WHEN 1 THEN concat('base,typescript,region.', n_regionkey, ',nation.', n_nationkey, ',csharp,csharp-api,react') ELSE 'base' END AS templates FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 6 IN (0, 1, 4)""")
def template_orders(spark, sf_dir):
    """The templates of each project in the order in which they apply, with all that they require."""
    return templates.lists(_expanded(spark, sf_dir).ordered).select("project", F.array_join("templates", ",").alias("templates"))


@_query("""SELECT concat('r', c_custkey) AS project, CASE c_custkey % 6 WHEN 2 THEN 'Template dependency cycle: ring.b -> ring.c -> ring.b' WHEN 3 THEN concat('Unknown template: gone.', c_custkey)
ELSE 'Unknown template: missing required by owner' END AS message FROM customer WHERE c_custkey % 6 IN (2, 3, 5)""")
def template_faults(spark, sf_dir):
    """The first circle or unknown template of each project that has one."""
    return _expanded(spark, sf_dir).faults


@_query("""SELECT concat('r', c_custkey) AS project, id, CASE WHEN id = 'page' AND c_custkey % 4 = 0 THEN concat('Mine ', c_custkey) WHEN id = 'page' AND form = 0 THEN concat('Pages ', c_nationkey) ELSE label END AS label, shape
FROM (SELECT *, c_custkey % 6 AS form FROM customer) c JOIN (VALUES (0, 'root', 'Root', 'wide'), (1, 'root', 'Root', 'wide'), (4, 'root', 'Root', 'wide'), (0, 'page', 'Pages', 'box'), (1, 'page', 'Pages', 'box'), (0, 'hook', 'Hooks', ''), (1, 'hook', 'Hooks', '')) f(form, id, label, shape) USING (form)
UNION ALL SELECT concat('r', c_custkey), 'page', concat('Mine ', c_custkey), '' FROM customer WHERE c_custkey % 6 = 4 AND c_custkey % 4 = 0""")
def effective_layers(spark, sf_dir):
    """The layers of each project: those of its templates, one laid on another, then its own."""
    ordered = cut(_expanded(spark, sf_dir).ordered)
    kind = "template string, section string, pos int, id string, field string, value string"
    fixed = [("base", "layers", 0, "root", "label", "Root"), ("base", "layers", 0, "root", "shape", "wide"), ("react", "layers", 0, "page", "label", "Pages"), ("react", "layers", 0, "page", "shape", "box"), ("react", "layers", 1, "hook", "label", "Hooks")]
    n = F.col("n_nationkey").cast("string")
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation."), n), F.lit("layers"), F.lit(0), F.lit("page"), F.lit("label"), F.concat(F.lit("Pages "), n))
    c = F.col("c_custkey").cast("string")
    own = table(spark, sf_dir, "customer").filter("c_custkey % 4 = 0 AND c_custkey % 6 IN (0, 1, 4)")
    own = own.select(F.concat(F.lit("r"), c).alias("project"), F.lit("layers").alias("section"), F.lit(0).alias("pos"), F.lit("page").alias("id"), F.lit("label").alias("field"), F.concat(F.lit("Mine "), c).alias("value"))
    laid = templates.entries(ordered, spark.createDataFrame(fixed, kind).union(nations), own)
    field = lambda name: F.coalesce(F.max(F.when(F.col("field") == name, F.col("value"))), F.lit("")).alias(name)
    return laid.groupBy("project", "id").agg(field("label"), field("shape"))


@_query("""SELECT concat('r', c_custkey) AS project, path, CASE WHEN path = 'max.lines' AND form = 0 THEN CAST(c_nationkey AS VARCHAR) ELSE value END AS value
FROM (SELECT *, c_custkey % 6 AS form FROM customer) c JOIN (VALUES (0, 'strict', 'true'), (1, 'strict', 'true'), (0, 'max.lines', '200'), (1, 'max.lines', '200'), (0, 'max.depth', '4'), (1, 'max.depth', '4'), (4, 'max', '{}')) f(form, path, value) USING (form)
WHERE NOT (c_custkey % 12 = 0 AND path LIKE 'max.%') UNION ALL SELECT concat('r', c_custkey), 'max', '0' FROM customer WHERE c_custkey % 12 = 0""")
def effective_options(spark, sf_dir):
    """The rule options of each project: objects merged by name, later values in the place of earlier ones."""
    ordered = cut(_expanded(spark, sf_dir).ordered)
    fixed = [("base", ["max"], "{}"), ("typescript", ["strict"], "true"), ("react", ["max", "lines"], "200"), ("react", ["max", "depth"], "4")]
    n = F.col("n_nationkey").cast("string")
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation."), n), F.array(F.lit("max"), F.lit("lines")), n)
    own = table(spark, sf_dir, "customer").filter("c_custkey % 12 = 0").select(F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("project"), F.array(F.lit("max")).alias("path"), F.lit("0").alias("value"))
    laid = templates.options(ordered, spark.createDataFrame(fixed, "template string, path array<string>, value string").union(nations), own)
    return laid.select("project", F.array_join("path", ".").alias("path"), "value")
