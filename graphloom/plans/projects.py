"""Registered queries over repositories: one for each customer, in six forms, with a source file for each order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detection
from ..sources.work import cut
from .cgraph import table
from .sources import _query

FORMS = [
    (0, "front/package.json", '{"name": "@acme/shop-<c>", "dependencies": {"react": "18"}}'),
    (0, "front/tsconfig.json", '{ // "paths": {}\n "compilerOptions": { "paths": { "@/*": ["./src/*"], /* old */ "~lib*": ["src/lib/../kit/*", "x"], "//x": [] , } } }'),
    (0, "front/src/App.tsx", ""),
    (0, "front/src/main.ts", ""),
    (0, "front/src/routes/AppRoutes.tsx", ""),
    (0, "front/src/features/readme.md", ""),
    (0, "back/Shop.Api/Shop.Api.csproj", ""),
    (1, "package.json", '{"devDependencies": {"vue": "3"}}'),
    (1, "src/index.ts", ""),
    (1, "src/routes/other.ts", ""),
    (2, "client/package.json", '{"name": "web_app", "dependencies": {"react-dom": "1"}}'),
    (2, "server/package.json", '{"dependencies": {"express": "4"}}'),
    (2, "client/src/main.tsx", ""),
    (2, "client/src/domains/readme.md", ""),
    (3, "web/package.json", "{broken"),
    (3, "package.json", '{"dependencies": {"@angular/core": "17"}}'),
    (3, "web/tsconfig.json", '{"compilerOptions": {"paths": {"@v": ["../shared/*"]}}}'),
    (3, "web/src/routes/AppRoutes/index.tsx", ""),
    (3, "web/src/views/readme.md", ""),
    (3, "api/cmd/main.go", ""),
    (3, "go.mod", ""),
    (4, "lib/readme.md", ""),
    (5, "package.json", '{"dependencies": {"react": "18", "vue": "3"}, "devDependencies": {"react": ""}}'),
    (5, "requirements.txt", ""),
    (5, "node_modules/x/x.csproj", ""),
    (5, "app/src/index.tsx", ""),
    (5, "app/src/pages/readme.md", ""),
]
SOURCES = ["front/src/features/m<5>/pages/o<o>.tsx", "src/<side>/o<o>.ts", "client/src/domains/d<3>/o<o>.ts", "web/src/views/v<7>/o<o>.ts", "lib/m<o>/a.py", "app/src/pages/p<4>/o<o>.tsx"]


def repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, path, content of every repository."""
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    key, repo = F.col("c").cast("string"), F.concat(F.lit("team/r"), F.col("c").cast("string"))
    forms = F.array(*(F.array(*(F.struct(F.lit(p).alias("path"), F.lit(t).alias("content")) for k, p, t in FORMS if k == form)) for form in range(6)))
    base = customer.select(F.col("c_custkey").alias("c")).select("c", F.explode(F.get(forms, (F.col("c") % 6).cast("int"))).alias("f"))
    base = base.select(repo.alias("repo"), "f.path", F.replace("f.content", F.lit("<c>"), key).alias("content"))
    path = F.get(F.array(*map(F.lit, SOURCES)), (F.col("c") % 6).cast("int"))
    values = {"o": F.col("o"), "side": F.when(F.col("o") % 2 == 0, F.concat(F.lit("m"), F.col("o") % 5)).otherwise("services"), **{str(n): F.col("o") % n for n in (3, 4, 5, 7)}}
    for name, value in values.items():
        path = F.replace(path, F.lit(f"<{name}>"), value.cast("string"))
    return base.union(orders.select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("o")).select(repo, path, F.lit("")))


def _found(spark: SparkSession, sf_dir: str) -> detection.Detected:
    return detection.detect(cut(repositories(spark, sf_dir)))


_MODULES_SQL = """SELECT DISTINCT concat('team/r', o_custkey) AS repo, CASE o_custkey % 6 WHEN 0 THEN concat('m', o_orderkey % 5) WHEN 1 THEN concat('m', o_orderkey % 5) WHEN 2 THEN concat('d', o_orderkey % 3)
WHEN 3 THEN concat('v', o_orderkey % 7) ELSE concat('p', o_orderkey % 4) END AS module FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) AND o_custkey % 6 <> 4 AND (o_custkey % 6 <> 1 OR o_orderkey % 2 = 0)"""
_FORMS_SQL = """(VALUES (0, 'front/src', 'back', 'react', 'dotnet'), (1, 'src', NULL, 'vue', NULL), (2, 'client/src', 'server', 'react', 'node'), (3, 'web/src', 'api', 'angular', 'go'),
(4, 'src', NULL, NULL, NULL), (5, 'app/src', NULL, 'vue', NULL)) f(form, frontend_root, backend_root, frontend_framework, backend_stack)"""


@_query(f"""SELECT concat('team/r', c_custkey) AS repo, frontend_root, backend_root, frontend_framework, backend_stack, COALESCE(n, 0) AS module_count FROM customer JOIN {_FORMS_SQL} ON c_custkey % 6 = form
LEFT JOIN (SELECT repo, COUNT(*) AS n FROM ({_MODULES_SQL}) m GROUP BY repo) k ON k.repo = concat('team/r', c_custkey)""")
def project_summary(spark, sf_dir):
    """Roots, stacks and the number of modules of every repository."""
    return detection.summary(_found(spark, sf_dir))


@_query(f"SELECT repo, module, upper(module) AS label FROM ({_MODULES_SQL}) m")
def project_modules(spark, sf_dir):
    """Modules of every repository: below its feature folder, else the root's folders that are no infrastructure."""
    return _found(spark, sf_dir).modules


@_query(r"""SELECT concat('team/r', c_custkey) AS repo, CASE c_custkey % 6 WHEN 0 THEN concat('Shop ', c_custkey) WHEN 2 THEN 'Web App' ELSE concat('R', c_custkey) END AS name, f.* EXCLUDE (form) FROM customer JOIN (VALUES
(0, '/features/{module}/', '^front/src/features/([^/]+)', '^back/[^/]+/([^/]+)', '^back/[^/]+/Controllers/(.+?)Controller\.cs$', 'front/src/App.tsx,front/src/routes/AppRoutes.tsx', 'filesystem,typescript,react,architecture.feature-sliced,architecture.mvvm,http-endpoints,csharp,dotnet-api,architecture.mvc,architecture.clean-architecture,architecture.cqrs,entity-framework,coverage,quality', 14),
(1, '/features/{module}/', '^src/([^/]+)', NULL, NULL, 'src/index.ts', 'filesystem,typescript,http-endpoints,coverage,quality', 5),
(2, '/domains/{module}/', '^client/src/domains/([^/]+)', NULL, NULL, 'client/src/main.tsx', 'filesystem,typescript,react,architecture.feature-sliced,architecture.mvvm,http-endpoints,coverage,quality', 8),
(3, '/views/{module}/', '^web/src/views/([^/]+)', '^api/[^/]+/([^/]+)', '^api/[^/]+/Controllers/(.+?)Controller\.cs$', 'web/src/routes/AppRoutes/index.tsx', 'filesystem,typescript,http-endpoints,coverage,quality', 5),
(4, '/features/{module}/', '^src/([^/]+)', NULL, NULL, '', 'filesystem,typescript,http-endpoints,coverage,quality', 5),
(5, '/pages/{module}/', '^app/src/pages/([^/]+)', NULL, NULL, 'app/src/index.tsx', 'filesystem,typescript,http-endpoints,coverage,quality', 5)
) f(form, feature_folder_pattern, frontend_feature_pattern, backend_project_pattern, backend_controller_pattern, entry_points, templates, n_layers) ON c_custkey % 6 = form""")
def project_maps(spark, sf_dir):
    """Names, patterns, entry points, templates and layers that follow from each repository's files."""
    listed = lambda c: F.array_join(c, ",").alias(c)
    kept = ["repo", "name", "feature_folder_pattern", "frontend_feature_pattern", "backend_project_pattern", "backend_controller_pattern"]
    return _found(spark, sf_dir).projects.select(*kept, listed("entry_points"), listed("templates"), F.size("layers").alias("n_layers"))


@_query("""SELECT concat('team/r', c_custkey) AS repo, CAST(ord AS BIGINT) AS ord, prefix, path FROM customer JOIN (VALUES (0, 0, '@/', 'front/src'), (0, 1, '~lib/', 'front/src/kit'), (3, 0, '@v/', 'shared')) f(form, ord, prefix, path) ON c_custkey % 6 = form""")
def project_aliases(spark, sf_dir):
    """Import aliases of every repository, from its compiler configuration with comments."""
    return _found(spark, sf_dir).aliases
