"""Registered queries over source files: the driver's tables written out as C# and TypeScript, lexed, and joined again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lex
from ..operators import rules
from ..sources.work import cut
from . import scan
from .cgraph import table
from .queries import ORACLE_SQL, QUERIES, Query

PROJECT = scan.Project(aliases=(("@/", "front/"),))


def _query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _filled(pattern: str, **columns: str) -> Column:
    """The text with a column's value in the place of each <name>."""
    out: Column = F.lit(pattern)
    for name, column in columns.items():
        out = F.replace(out, F.lit(f"<{name}>"), F.col(column).cast("string"))
    return out


def _chosen(key: str, forms: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, forms)), (F.col(key) % len(forms)).cast("int"))


def _files(df: DataFrame, path: str, content: str | Column, **columns: str) -> DataFrame:
    body = F.lit(content) if isinstance(content, str) else content
    for name, column in columns.items():
        body = F.replace(body, F.lit(f"<{name}>"), F.col(column).cast("string"))
    return df.select(_filled(path, **columns).alias("path"), body.alias("content"))


HANDLER_FORMS = [
    "_db.Set<Nation<k>>();", "IRepository<Nation<k>> r = null; Nation<k> n;", "Nation<k> n; _db.Nations<k>.Where(x);", "Nation<k> n = new();", '/* Nation<k> */ var s = "Nations<k>.Nation<k>";',
]


def backend_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: a context and an entity for each nation, a handler for each supplier that uses its nation in one of five ways."""
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    context = "public class N<k>Db : DbContext { public DbSet<Nation<k>> Nations<k> { get; set; } }\n"
    mapping = 'class Nation<k>Map : IEntityTypeConfiguration<Nation<k>> { void C(B b) { b.ToTable("nation_<k>"); } }\n'
    out = _files(nation, "back/Data/N<k>/N<k>Db.cs", context, k="n_nationkey")
    out = out.union(_files(nation, "back/Domain/N<k>/Entities/Nation<k>.cs", "public class Nation<k> { }\n", k="n_nationkey"))
    out = out.union(_files(nation.filter("n_nationkey % 2 = 0"), "back/Data/N<k>/Nation<k>Map.cs", mapping, k="n_nationkey"))
    body = F.concat(F.lit("class S<s>CommandHandler : IRequestHandler<S<s>Command> { void Run() { "), _chosen("s_suppkey", HANDLER_FORMS), F.lit(" } }\n"))
    return out.union(_files(supplier, "back/App/N<k>/Handlers/S<s>CommandHandler.cs", body, k="s_nationkey", s="s_suppkey"))


@_query("""SELECT concat('back/App/N', s_nationkey, '/Handlers/S', s_suppkey, 'CommandHandler.cs') AS path, concat('Nation', s_nationkey) AS entity,
CASE WHEN s_nationkey % 2 = 0 THEN concat('nation_', s_nationkey) ELSE concat('Nations', s_nationkey) END AS "table",
concat(CASE s_suppkey % 5 WHEN 0 THEN 'ORM Set<Nation' WHEN 1 THEN 'repository Nation' WHEN 2 THEN 'DbSet Nations' ELSE 'entity Nation' END, s_nationkey, CASE WHEN s_suppkey % 5 = 0 THEN '>' ELSE '' END) AS reason,
CASE WHEN s_suppkey % 5 < 3 THEN 'high' ELSE 'medium' END AS confidence, s_suppkey % 5 < 3 AS persistent FROM supplier WHERE s_suppkey % 5 < 4""")
def entity_usages(spark, sf_dir):
    """Which entities the handlers use, by their sources."""
    files = cut(backend_files(spark, sf_dir))
    facts = cut(lex.facts(files))
    nodes = cut(scan.refined_nodes(scan.file_nodes(files, PROJECT), facts))
    return scan.entity_usages(facts, nodes, cut(scan.known_entities(facts, nodes)))


@_query("""SELECT * FROM (
SELECT concat('file:back/App/N', s_nationkey, '/Handlers/S', s_suppkey, 'CommandHandler.cs') AS src, concat('entity:Nation', s_nationkey) AS dst, 'uses-entity' AS type, CASE WHEN s_suppkey % 5 < 3 THEN 'high' ELSE 'medium' END AS confidence FROM supplier WHERE s_suppkey % 5 < 4
UNION ALL SELECT concat('file:back/App/N', s_nationkey, '/Handlers/S', s_suppkey, 'CommandHandler.cs'), concat('table:', CASE WHEN s_nationkey % 2 = 0 THEN 'nation_' ELSE 'Nations' END, s_nationkey), 'queries-table', 'high' FROM supplier WHERE s_suppkey % 5 < 3
UNION ALL SELECT concat('file:back/Data/N', n_nationkey, '/N', n_nationkey, 'Db.cs'), concat('entity:Nation', n_nationkey), 'dbset', 'high' FROM nation
UNION ALL SELECT concat('entity:Nation', n_nationkey), concat('table:', CASE WHEN n_nationkey % 2 = 0 THEN 'nation_' ELSE 'Nations' END, n_nationkey), 'maps-to-table', 'high' FROM nation) x""")
def persistence_edges(spark, sf_dir):
    """Edges of the whole graph of these files that lead to entities and tables."""
    files = cut(backend_files(spark, sf_dir))
    graph = scan.graph_of(files, cut(lex.facts(files)), PROJECT)
    return graph.edges.filter("type in ('uses-entity', 'queries-table', 'dbset', 'maps-to-table')").select("src", "dst", "type", "confidence")


SERVICE_FORMS = [
    "import { N<k>_URL as U } from '@/config/n<k>'\nfetch(U)\n", "import { N<k>_URL } from '@/config/n<k>'\npost(`${N<k>_URL}/${id}/<c>`)\n", "import { OTHER } from '@/config/n<k>'\nfetch(OTHER)\nfetch(unknown)\n",
    "import { SHARED } from '@/config/n<k>'\nfetch(SHARED, { method: 'DELETE' })\n",
]


def front_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: addresses for each nation and region, and a service for each customer that calls them through their names."""
    nation, region, customer = (table(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    out = _files(nation, "front/config/n<k>.ts", "export const N<k>_URL = '/api/n/<k>', OTHER = '/api/other/<k>'\n", k="n_nationkey")
    out = out.union(_files(nation, "front/old/n<k>.ts", "export const OTHER = '/api/old/<k>'\nexport const N<k>_URL = '/api/gone'\n", k="n_nationkey"))
    out = out.union(_files(region, "front/shared/r<k>.ts", "export const SHARED = '/api/shared'\n", k="r_regionkey"))
    return out.union(_files(customer, "front/features/n<k>/services/c<c>.ts", _chosen("c_custkey", SERVICE_FORMS), k="c_nationkey", c="c_custkey"))


@_query("""SELECT concat('front/features/n', c_nationkey, '/services/c', c_custkey, '.ts') AS path,
CASE c_custkey % 4 WHEN 0 THEN concat('/api/n/', c_nationkey) WHEN 1 THEN concat('/api/n/', c_nationkey, '/{}/', c_custkey) WHEN 2 THEN concat('/api/other/', c_nationkey) ELSE '/api/shared' END AS url,
CASE c_custkey % 4 WHEN 1 THEN 'POST' WHEN 3 THEN 'DELETE' ELSE 'GET' END AS method FROM customer""")
def endpoint_bindings(spark, sf_dir):
    """Calls through names that other files export: by the file that is imported, else by the only value that a name has."""
    files = cut(front_files(spark, sf_dir))
    return scan.front_calls(cut(lex.facts(files)), files, PROJECT)


RULE_FORMS = [
    "import { x } from './x'\nconst a: any = 1\n", "\n\nconst b = x as any\n", "let c: Array<any> = []\n", "// any\nconst any = 'any'\n", "type T = () => any;\ntype U = { v: any, w: [any, string] }\n",
    "import { y } from '@/y'\nexport const y = <any>z\n", "function f<V = any>(k: keyof any): V extends any ? 1 : 2 { }\n",
]


@_query("""SELECT f.rule_id, concat('front/features/b/lib/p', p_partkey, '.ts') AS path, f.line, f.evidence FROM part JOIN (VALUES
(0, 'technology.typescript.relative-imports', 1, './x'), (0, 'technology.typescript.no-any', 2, ': any'), (1, 'technology.typescript.no-any', 3, 'as any'), (2, 'technology.typescript.no-any', 1, 'Array<any>'),
(4, 'technology.typescript.no-any', 1, ': any'), (4, 'technology.typescript.no-any', 2, ': any'), (4, 'technology.typescript.no-any', 2, ': any'), (5, 'technology.typescript.no-any', 2, '<any>'),
(6, 'technology.typescript.no-any', 1, ': any'), (6, 'technology.typescript.no-any', 1, ': any'), (6, 'technology.typescript.no-any', 1, ': any')) f(form, rule_id, line, evidence) ON p_partkey % 7 = f.form""")
def rule_source_findings(spark, sf_dir):
    """What breaks the rules on imports and types in a source file for each part."""
    files = cut(_files(table(spark, sf_dir, "part"), "front/features/b/lib/p<p>.ts", _chosen("p_partkey", RULE_FORMS), p="p_partkey"))
    return scan.findings(files, cut(lex.facts(files)), PROJECT).select("rule_id", "path", "line", "evidence")


@_query("""SELECT concat('front/x', c_nationkey, '/', f.folder, '/c', c_custkey, '.ts') AS path, f.type FROM customer JOIN (VALUES
(0, 'types/schemas', 'auxiliary'), (1, 'stores/schemas', 'auxiliary'), (2, 'schemas/utils', 'config'), (3, 'config/stores', 'config'), (4, 'services/config', 'service'), (5, 'repositories/types', 'repository'), (6, 'stores/types', 'auxiliary')) f(k, folder, type) ON c_custkey % 7 = f.k""")
def classify_nested_paths(spark, sf_dir):
    """Types of paths that hold two fragments: the first of the list decides, not the first of the path."""
    folders = ["types/schemas", "stores/schemas", "schemas/utils", "config/stores", "services/config", "repositories/types", "stores/types"]
    named = table(spark, sf_dir, "customer").select(F.concat(F.lit("front/x"), F.col("c_nationkey").cast("string"), F.lit("/"), _chosen("c_custkey", folders), F.lit("/c"), F.col("c_custkey").cast("string"), F.lit(".ts")).alias("path"))
    return named.select("path", rules.classify_front(F.col("path")).getField("type").alias("type"))
