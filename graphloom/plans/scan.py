"""From a source tree to a graph: files, facts, nodes, edges, measures."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import lex
from ..functions import text as fx
from ..operators import guardrails, measure, merge, rules, views
from ..sources.facts import kept_facts
from ..sources.files import is_test, scan
from ..sources.work import cut

ENDINGS = [".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]


@dataclass(frozen=True)
class Project:
    """What a scan has to know about a source tree."""

    front_root: str = "front/"
    back_root: str = "back/"
    aliases: tuple[tuple[str, str], ...] = ()
    feature_folder: str = "front/features/{module}/"
    entry_paths: tuple[str, ...] = ()
    entry_suffixes: tuple[str, ...] = ("Program.cs", "Startup.cs")
    suppressions: tuple[dict, ...] = ()
    max_lines: int = 200
    enabled_rules: tuple[str, ...] | None = None
    guardrails: guardrails.Options | None = None
    extra: dict = field(default_factory=dict)


def project_of(row: Row) -> Project:
    """The project that a row of ``projectmaps.normalized`` describes; files outside the frontend count as backend.

    An empty list of rules stands for all; a null list of entry points or suffixes for none.
    """
    front = row["frontend_root"].strip("/")
    back = (row["backend_root"] or "").strip("/")
    keys = {"ruleId": "rule", "pathPattern": "path", "reason": "reason", "expiresOn": "expires"}
    return Project(
        front_root=f"{front}/",
        back_root=f"{back}/",
        aliases=tuple((a["prefix"], a["path"].strip("/") + "/" if a["prefix"].endswith("/") else a["path"]) for a in row["aliases"]),
        feature_folder=f"{front}/{(row['feature_folder_pattern'] or '').strip('/')}/",
        entry_paths=tuple(row["entry_points"] or ()),
        entry_suffixes=tuple(row["entry_suffixes"] or ()),
        suppressions=tuple({keys[k]: v for k, v in s.asDict().items() if v is not None} for s in row["suppressions"]),
        enabled_rules=tuple(row["rules_enabled"]) or None,
    )


@dataclass(frozen=True)
class ScannedGraph:
    """Tables of a scanned tree; findings carry suppressed and reason, usages say why a file uses an entity, reviews
    which routes, pages and main components do more than compose; warnings are sentences."""

    nodes: DataFrame
    edges: DataFrame
    findings: DataFrame
    coverage: DataFrame
    orphans: DataFrame
    quality: DataFrame
    usages: DataFrame
    reviews: DataFrame
    warnings: list[str]


def _file_id(path: F.Column) -> F.Column:
    return F.concat(F.lit("file:"), path)


def file_nodes(files: DataFrame, project: Project) -> DataFrame:
    """A node for each file that is no test."""
    front = F.col("path").startswith(project.front_root)
    kind = F.when(front, rules.classify_front(F.col("path"))).otherwise(rules.classify_back(F.col("path")))
    return files.filter(~is_test(F.col("path"))).select(_file_id(F.col("path")).alias("id"), fx.display_label(F.col("path")).alias("label"), kind.getField("type").alias("type"), kind.getField("layer").alias("layer"), rules.module_of(F.col("path")).alias("module"), "path")


_SUPPORT = r"(?:Service|Client|Provider|Resolver|Sender|Processor|Orchestrator|Selector|Adapter|Worker|Queue|Runtime|Guard|Factory)\z"


def refined_nodes(nodes: DataFrame, facts: DataFrame) -> DataFrame:
    """The nodes with the roles of C# files as what they hold says.

    Files of no role are repositories and services by their folder or name; handlers
    that handle no request are services by name, or none; contexts of a database are
    data-context; interfaces that something implements are no repositories, and
    interfaces named as the file is are no requests.
    """
    said = facts.filter("fact = 'semantics'").groupBy("path").agg(F.collect_set("name").alias("__said"))
    bases = facts.filter("fact = 'declares:class'").select(F.explode(F.split("value", ",")).alias("__stem")).filter("__stem <> ''").distinct().withColumn("__implemented", F.lit(True))
    stem = F.regexp_extract("path", r"([^/]+)\.cs\z", 1)
    joined = nodes.withColumn("__stem", stem).join(said, "path", "left").join(F.broadcast(bases) if bases.count() <= 100_000 else bases, "__stem", "left")
    has = lambda what: F.coalesce(F.array_contains("__said", what), F.lit(False))
    within = lambda fragment: F.contains("path", F.lit(fragment))
    pair = lambda t, l: F.struct(F.lit(t).alias("type"), F.lit(l).alias("layer"))  # noqa: E731, E741
    support = F.when(F.col("__stem").rlike(_SUPPORT), pair("service", "backend-service")).otherwise(pair("auxiliary", "auxiliary"))
    service = F.col("__stem").endswith("Service") | (~within("/Models/") & ~within("/Configuration/") & (within("/Services/") | F.col("__stem").rlike(_SUPPORT)))
    kept = F.struct(F.col("type").alias("type"), F.col("layer").alias("layer"))
    role = F.when(F.col("type").isin("command", "query"), F.struct(F.col("type").alias("type"), F.lit("application-request").alias("layer")))
    role = role.when(F.col("type") == "handler", F.when(has("request-handler"), pair("handler", "application-handler")).otherwise(support))
    role = role.when(F.col("type") == "auxiliary", F.when(within("/Repositories/") | F.col("__stem").endswith("Repository"), pair("repository", "backend-repository")).when(service, pair("service", "backend-service")).otherwise(kept)).otherwise(kept)
    face = F.col("__stem").rlike(r"\AI[A-Z]")
    hidden = ((F.col("__role.type") == "repository") & face & F.coalesce("__implemented", F.lit(False))) | (F.col("__role.type").isin("command", "query") & has("marker-interface"))
    both = joined.withColumn("__role", role).withColumn("__role", F.when(has("data-context"), pair("data-context", "backend-repository")).when(hidden, pair("auxiliary", "auxiliary")).otherwise(F.col("__role")))
    back = F.coalesce(F.col("path").endswith(".cs"), F.lit(False))
    changed = both.withColumn("type", F.when(back, F.col("__role.type")).otherwise(F.col("type"))).withColumn("layer", F.when(back, F.col("__role.layer")).otherwise(F.col("layer")))
    return changed.select(*nodes.columns)


def _named(name: str):
    return lambda b: b["name"] == name


def imported_urls(facts: DataFrame, files: DataFrame, project: Project) -> DataFrame:
    """path, local, value, ordinal: names that a file imports and that stand for an address in the file they come from;
    a name that its file does not export counts if all files that export it agree on its value."""
    exported = facts.filter("fact = 'exports-url'").select(F.col("path").alias("target"), F.col("name").alias("exported"), F.col("value").alias("own"))
    agreed = exported.groupBy("exported").agg(F.count_distinct("own").alias("n"), F.min("own").alias("agreed")).filter("n = 1").drop("n")
    part = F.split("value", " ")
    wanted = facts.filter("fact = 'import-name'").select(F.col("path").alias("file"), F.col("name").alias("specifier"), part[0].alias("exported"), part[1].alias("local"), "ordinal")
    wanted = wanted.join(exported.select("exported").distinct(), "exported", "left_semi")
    found = rules.resolve_imports(wanted.select("file", "specifier").distinct(), files, list(project.aliases), ENDINGS).select("file", "specifier", "target")
    joined = wanted.join(found, ["file", "specifier"]).join(exported, ["target", "exported"], "left").join(agreed, "exported", "left").withColumn("value", F.coalesce("own", "agreed"))
    last = joined.filter("value is not null").groupBy(F.col("file").alias("path"), "local").agg(F.max_by("value", "ordinal").alias("value"), F.max("ordinal").alias("ordinal"))
    return last.select("path", "local", "value", "ordinal")


def front_calls(facts: DataFrame, files: DataFrame, project: Project) -> DataFrame:
    """path, url, method of the calls of the API: literal ones, and those through names of other files; with the tree's version prefix."""
    literal = facts.filter("fact = 'endpoint'").select("path", F.col("name").alias("url"), F.col("value").alias("method"), F.col("ordinal").alias("ord"))
    opened = facts.filter("fact = 'endpoint:open'").select("path", F.col("name").alias("url"), F.col("value").alias("method"), F.col("ordinal").alias("ord"))
    outer = imported_urls(facts, files, project).select("path", F.struct(F.lit(0).alias("own"), "ordinal", F.col("local").alias("name"), "value").alias("b"))
    inner = facts.filter("fact = 'binds-url'").select("path", F.struct(F.lit(1).alias("own"), "ordinal", "name", "value").alias("b"))
    known = outer.union(inner).groupBy("path").agg(F.array_sort(F.collect_list("b")).alias("known"))  # the names of one file
    joined = opened.join(known, "path")
    put = lambda url, name, value: F.replace(F.replace(url, F.concat(F.lit("${"), name, F.lit("}")), value), F.concat(F.lit("${this."), name, F.lit("}")), value)
    bound = F.aggregate("known", F.col("url"), lambda acc, b: put(acc, b["name"], b["value"]))
    named = [F.try_element_at(F.filter("known", _named(n)), F.lit(-1))["value"] for n in lex.BASE_NAMES]
    base = F.coalesce(*named, F.try_element_at("known", F.lit(1))["value"])
    based = joined.withColumn("url", bound).withColumn("base", base)
    for name in lex.BASE_NAMES:
        based = based.withColumn("url", put(F.col("url"), F.lit(name), F.col("base")))
    resolved = based.select("path", F.regexp_replace("url", r"\$\{[^}]+\}", "{}").alias("url"), "method", "ord").filter("startswith(url, '/api')")
    one = rules.distinct_endpoints(literal.union(resolved).withColumnRenamed("path", "file")).withColumnRenamed("file", "path")
    first = facts.filter("fact = 'version-prefix'").agg(F.min_by("name", "path")).first()
    prefix = first[0] if first else None
    if prefix is not None:
        plain = F.col("url").startswith("/api/") & ~F.col("url").rlike(r"\A/api/(?:v\d+|health)(?:/|\z)")
        one = one.withColumn("url", F.when(plain, F.concat(F.lit(prefix), F.substring("url", F.lit(6), F.length("url")))).otherwise(F.col("url")))
    return one.select("path", "url", "method")


def reviews(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, path, type, signals of routes, pages and main components that hold logic, signals in their fixed order."""
    place = F.array_position(F.array(*map(F.lit, lex.BEHAVIOURS)), F.col("name"))
    signals = facts.filter("fact = 'behaviour'").groupBy("path").agg(F.transform(F.array_sort(F.collect_set(F.struct(place.alias("at"), "name"))), lambda s: s["name"]).alias("signals"))
    return nodes.filter(F.col("type").isin("route", "page", "main-component")).join(signals, "path").select("id", "path", "type", "signals")


def endpoint_nodes(facts: DataFrame, nodes: DataFrame, files: DataFrame, project: Project) -> tuple[DataFrame, DataFrame]:
    """Endpoint nodes and edges: callers to endpoints, and front endpoints to controllers' with the same url."""
    calls = front_calls(facts, files, project).select("path", fx.normalize_endpoint(F.col("url")).alias("url"), "method").filter("url is not null")
    actions = facts.filter("fact = 'action'").select("path", fx.normalize_endpoint(F.col("name")).alias("url"), F.split("value", " ")[0].alias("method")).filter("url is not null")
    both = calls.union(actions).withColumn("id", fx.endpoint_id(F.col("url"), F.col("method")))
    modules = nodes.select("path", "module")
    made = both.join(modules, "path", "left").groupBy("id").agg(F.min(F.concat_ws(" ", "method", "url")).alias("label"), F.coalesce(F.min("module"), F.lit("shared")).alias("module"))
    made = made.select("id", "label", F.lit("endpoint").alias("type"), F.lit("api-endpoint").alias("layer"), "module", F.lit(None).cast("string").alias("path"))
    edge = lambda df, kind, trust: df.select("src", "dst", F.lit(kind).alias("type"), F.lit(trust).alias("confidence"))
    used = edge(calls.select(_file_id(F.col("path")).alias("src"), fx.endpoint_id(F.col("url"), F.col("method")).alias("dst")), "calls-api", "medium")
    served = edge(actions.select(fx.endpoint_id(F.col("url"), F.col("method")).alias("src"), _file_id(F.col("path")).alias("dst")), "resolved-controller", "high")
    named = lambda df: df.select(fx.endpoint_id(F.col("url"), F.col("method")).alias("id"), "url", "method")
    matched = rules.link_endpoints(named(calls), named(actions))
    through = matched.join(served.select(F.col("src").alias("dst"), F.col("dst").alias("controller")), "dst").select("src", F.col("controller").alias("dst"))
    return made, used.union(served).union(edge(through, "resolved-controller", "medium")).union(edge(matched, "matches-endpoint", "medium"))


def import_edges(facts: DataFrame, files: DataFrame, project: Project) -> DataFrame:
    """src, dst, type, confidence of references that lead to a file; lazy ones by import()."""
    refs = facts.filter(F.col("fact").startswith("import:")).select(F.col("path").alias("file"), F.col("name").alias("specifier"), F.col("fact").alias("how"))
    found = rules.resolve_imports(refs.select("file", "specifier").distinct(), files, list(project.aliases), ENDINGS)
    kind = F.when(F.col("how") == "import:dynamic", "lazy-imports").otherwise("imports")
    return refs.join(found, ["file", "specifier"]).select(_file_id(F.col("file")).alias("src"), _file_id(F.col("target")).alias("dst"), kind.alias("type"), F.lit("high").alias("confidence"))


def coverage(facts: DataFrame, files: DataFrame, project: Project) -> DataFrame:
    """source, tests, n_cases: tests cover the files that they import and the one that they are named after."""
    cases = facts.filter("fact = 'test-cases'").select("path", F.col("value").cast("long").alias("cases"))
    refs = facts.filter("fact = 'import:static'").select(F.col("path").alias("file"), F.col("name").alias("specifier")).distinct()
    by_import = rules.resolve_imports(refs, files, list(project.aliases), ENDINGS).select(F.col("file").alias("path"), F.col("target").alias("source"))
    by_name = cases.select("path", F.regexp_replace("path", r"\.(test|spec)(\.[^./]+)\z", "$2").alias("source"))
    both = by_import.union(by_name).filter(is_test(F.col("path")) & ~is_test(F.col("source"))).distinct()
    tests = both.join(cases, "path", "left").select(F.col("path").alias("test"), "source", F.coalesce("cases", F.lit(0)).alias("cases"))
    return measure.coverage_by_source(files.select(F.col("path").alias("source")), tests)


#: Rules by the kind of fact that breaks them, with their severity.
RULES = {
    "technology.typescript.relative-imports": "error", "technology.typescript.no-any": "error", "framework.react.component-max-lines": "error",
    "framework.react.route-file-shape": "error", "architecture.mvc.thin-controller": "warning", **guardrails.RULES,
}


def findings(files: DataFrame, facts: DataFrame, project: Project) -> DataFrame:
    """What breaks the enabled rules, with evidence and suppression.

    Relative imports and any in front files, components that are too long, route
    files with more than routes, controllers with more than requests and answers, and
    what breaks the architecture rules, if the project sets options for them.
    The id ends with the finding's number in the order of rule, path and line.
    """
    front = F.col("path").startswith(project.front_root) & ~is_test(F.col("path"))
    kind = rules.classify_front(F.col("path")).getField("type")
    lines = F.size(F.split("content", "\r?\n"))
    component = front & kind.isin("component", "main-component", "subcomponent") & F.col("path").rlike(r"\.[jt]sx\z")
    row = lambda df, rule, line, evidence: df.select(F.lit(rule).alias("rule_id"), "path", line.cast("int").alias("line"), evidence.alias("evidence"))
    at = F.col("value")
    made = row(files.filter(component & (lines > project.max_lines)), "framework.react.component-max-lines", F.lit(project.max_lines + 1), F.concat(lines.cast("string"), F.lit(" lines")))
    made = made.union(row(facts.filter(front & (F.col("fact") == "import:static") & F.col("name").startswith(".")), "technology.typescript.relative-imports", at, F.col("name")))
    made = made.union(row(facts.filter(front & (F.col("fact") == "any")), "technology.typescript.no-any", at, F.col("name")))
    made = made.union(row(facts.filter(front & (kind == "route") & F.col("path").rlike(r"/routes/index\.[jt]sx\z") & (F.col("fact") == "route-shape")), "framework.react.route-file-shape", at, F.col("name")))
    made = made.union(row(facts.filter(F.contains("path", F.lit("/Controllers/")) & F.col("path").endswith("Controller.cs") & (F.col("fact") == "thick-controller")), "architecture.mvc.thin-controller", at, F.col("name")))
    if (o := project.guardrails) is not None:
        fact = lambda kind: facts.filter(F.col("fact") == kind).select("path", "name", F.col("value").alias("line"))
        sources = files.filter(front).select("path", kind.alias("type"))
        imports = facts.filter(front & (F.col("fact") == "import:static")).select("path", "name", F.col("value").alias("line"))
        feature = re.escape(project.feature_folder).replace(r"\{module\}", "([^/]+)")
        made = made.union(guardrails.folder_entries(sources, o)).union(guardrails.thin_views(sources, fact("view-signal"), o)).union(guardrails.hook_names(sources, fact("calls"), o))
        made = made.union(guardrails.cross_features(imports, feature, o)).union(guardrails.ui_imports(sources, imports, o)).union(guardrails.layer_boundaries(fact("using"), o))
    enabled = list(RULES) if project.enabled_rules is None else [r for r in RULES if r in project.enabled_rules]
    severity = F.get(F.array(*map(F.lit, RULES.values())), F.array_position(F.array(*map(F.lit, RULES)), F.col("rule_id")).cast("int") - 1)
    known = made.filter(F.col("rule_id").isin(enabled)).select("rule_id", severity.alias("severity"), _file_id(F.col("path")).alias("node_id"), "path", "line", "evidence")
    return rules.suppressed(rules.numbered(known), list(project.suppressions))


_STORES = r"(?:Repository|Searchable|Pageable|Includable|Aggregatable|BulkOperations|Stateful)"


def backend_edges(facts: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges among C# files, the logical nodes that injected types need, and (id, entity) of generic repositories.

    sends: to the file named after a request, of the sender's own module first, then the
    first path; handled-by: from a request's file to XHandler.cs; depends-on: from a class
    to the class that implements an injected interface, else to what declares the type;
    the own module first, then files that are no tests, then the first path.  A generic
    repository (IRepository<Ship>), and a type that several classes implement, stand as
    nodes of their own in the module that asks for them.
    """
    cs = nodes.filter(F.col("path").endswith(".cs")).select("path", "module")
    stem = F.regexp_extract("path", r"([^/]+)\.cs\z", 1)
    named = cs.select("path", "module", stem.alias("name"))
    found = lambda fact: facts.filter(F.col("fact") == fact).select("path", "name").distinct().join(cs, "path")
    edge = lambda df, src, dst, kind, trust: df.select(_file_id(F.col(src)).alias("src"), _file_id(F.col(dst)).alias("dst"), F.lit(kind).alias("type"), F.lit(trust).alias("confidence"))
    sent = found("sends").filter(F.regexp_replace(stem, r"Handler\z", "") != F.col("name")).withColumnRenamed("path", "source")
    sends = edge(rules.ranked_lookup(sent, named), "source", "target", "sends", "medium")
    handlers = named.filter(F.col("name").endswith("Handler")).select(F.col("path").alias("source"), "module", F.regexp_replace("name", r"Handler\z", "").alias("name"))
    handled = edge(rules.ranked_lookup(handlers, named), "target", "source", "handled-by", "high")
    declared = facts.filter(F.col("fact").startswith("declares:")).select("path", "fact", "name", F.split("value", ",").alias("bases")).join(cs, "path")
    implemented = declared.filter("fact = 'declares:class'").select("path", "module", F.explode("bases").alias("name")).filter(F.col("name").startswith("I"))
    part = F.split("value", "\n")
    wanted = facts.filter("fact = 'injects'").select(F.col("path").alias("source"), "name", part[0].alias("written"), F.nullif(F.split(part[1], ",")[0], F.lit("")).alias("entity")).join(cs.withColumnRenamed("path", "source"), "source")
    tiers = implemented.withColumn("tier", F.lit(0)).unionByName(declared.select("path", "module", "name", F.lit(1).alias("tier")))
    injected = wanted.join(rules.tiered_lookup(wanted, tiers.distinct(), is_test), ["source", "name"]).filter("source <> target")
    store = F.col("name").rlike(_STORES)
    generic = store & F.col("entity").isNotNull()
    several = F.col("ambiguous") & (F.col("tier") == 0)
    role = F.when(store, "repository").otherwise("service")
    own = F.concat(F.lit("backend-"), role, F.lit(":"), "module", F.lit(":"), F.regexp_replace("written", r"\s+", ""))
    aimed = injected.select("*", role.alias("role"), (generic | several).alias("logical"), generic.alias("generic"), F.when(generic | several, own).otherwise(_file_id(F.col("target"))).alias("dst"))
    trust = F.when((F.col("tier") == 0) & ~F.col("ambiguous"), "high").otherwise("medium")
    depends = aimed.select(_file_id(F.col("source")).alias("src"), "dst", F.lit("depends-on").alias("type"), trust.alias("confidence"))
    made = aimed.filter("logical").groupBy(F.col("dst").alias("id")).agg(F.min("written").alias("label"), F.min("role").alias("type"), F.min("module").alias("module"))
    made = made.select("id", "label", "type", F.concat(F.lit("backend-"), "type").alias("layer"), "module", F.lit(None).cast("string").alias("path"))
    stores = aimed.filter("logical and role = 'repository' and entity is not null").select(F.col("dst").alias("id"), "entity").distinct()
    return sends.union(handled).union(depends).distinct(), made, stores


def known_entities(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """entity, property, table, path, module of the entities that contexts list.

    An entity's table is the one that its configuration names, else the property that
    lists it, else its name and an s.
    """
    sets = facts.filter("fact = 'db-set'").select(F.col("name").alias("entity"), F.col("value").alias("property"))
    mapped = facts.filter("fact = 'table'").select(F.col("value").alias("entity"), "name").filter("entity is not null").groupBy("entity").agg(F.min("name").alias("mapped"))
    declared = facts.filter("fact = 'declares:class'").select("path", F.col("name").alias("entity")).join(nodes.select("path", "module"), "path")
    place = declared.groupBy("entity").agg(F.min(F.struct((~F.contains("path", F.lit("/Entities/"))).cast("int").alias("far"), "path", "module")).alias("d"))
    known = sets.groupBy("entity").agg(F.min("property").alias("property")).join(mapped, "entity", "left").join(place, "entity", "left")
    return known.select("entity", "property", F.coalesce("mapped", "property", F.concat("entity", F.lit("s"))).alias("table"), F.col("d.path").alias("path"), F.coalesce("d.module", F.lit("shared")).alias("module"))


def persistence(facts: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of what is stored: entities, their tables, and the contexts that list them."""
    sets = facts.filter("fact = 'db-set'").select("path", F.col("name").alias("entity"))
    entity, stored = F.concat(F.lit("entity:"), F.col("entity")), F.concat(F.lit("table:"), F.col("table"))
    made = known.select(entity.alias("id"), F.col("entity").alias("label"), F.lit("entity").alias("type"), F.lit("domain").alias("layer"), "module", "path")
    made = made.unionByName(known.groupBy("table").agg(F.min("module").alias("module")).select(stored.alias("id"), F.col("table").alias("label"), F.lit("table").alias("type"), F.lit("database-table").alias("layer"), "module", F.lit(None).cast("string").alias("path")))
    row = lambda df, src, dst, kind: df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), F.lit("high").alias("confidence"))
    listed = row(sets, _file_id(F.col("path")), entity, "dbset")
    relations = facts.filter("fact = 'property'").select(F.col("value").alias("owner"), F.col("name").alias("entity")).join(known.select("entity"), "entity", "left_semi").join(known.select(F.col("entity").alias("owner")), "owner", "left_semi").filter("owner <> entity").distinct()
    return made, listed.union(row(known, entity, stored, "maps-to-table")).union(row(relations, F.concat(F.lit("entity:"), F.col("owner")), entity, "domain-relation"))


#: A dictionary of entities of no more rows is sent to every task; a larger one is joined by shuffling.
DICTIONARY_ROWS = 200_000


def entity_usages(facts: DataFrame, nodes: DataFrame, known: DataFrame) -> DataFrame:
    """path, entity, table, reason, confidence, persistent: which entities handlers, repositories and services use, and why.

    Of the mentions in a file the last strong one counts (a type argument of Set or of a
    repository, a collection reached by a dot), else the first bare name.
    """
    users = nodes.filter(F.col("type").isin("handler", "repository", "service")).select("path")
    said = facts.filter(F.col("fact").startswith("mentions:")).select("path", F.substring("fact", 10, 20).alias("how"), "name", F.col("value").cast("long").alias("at")).join(users, "path", "left_semi")
    words = known.select(F.col("entity").alias("name"), "entity", "table", F.lit(False).alias("collection"))
    words = words.union(known.groupBy(F.col("property").alias("name")).agg(F.max(F.struct("entity", "table")).alias("k")).select("name", "k.entity", "k.table", F.lit(True)))
    words = F.broadcast(words) if words.count() <= DICTIONARY_ROWS else words
    hits = said.join(words, "name").filter((F.col("how") == "member") == F.col("collection"))
    strong = F.col("how") != "name"
    reason = F.when(F.col("how") == "set", F.concat(F.lit("ORM Set<"), "entity", F.lit(">"))).when(F.col("how") == "repository", F.concat(F.lit("repository "), "entity"))
    reason = reason.when(F.col("how") == "member", F.concat(F.lit("DbSet "), "name")).otherwise(F.concat(F.lit("entity "), "entity"))
    place = F.struct(strong.alias("strong"), F.when(strong, F.col("at")).otherwise(-F.col("at")).alias("at"), reason.alias("reason"))
    best = hits.groupBy("path", "entity", "table").agg(F.max(place).alias("b"))
    return best.select("path", "entity", "table", F.col("b.reason").alias("reason"), F.when(F.col("b.strong"), "high").otherwise("medium").alias("confidence"), F.col("b.strong").alias("persistent"))


def usage_edges(usages: DataFrame, stores: DataFrame, known: DataFrame) -> DataFrame:
    """uses-entity and queries-table edges of files that use entities and of generic repositories."""
    by_type = stores.join(known.select("entity", "table"), "entity").select("id", "entity", "table", F.lit("high").alias("confidence"), F.lit(True).alias("persistent"))
    every = usages.select(_file_id(F.col("path")).alias("id"), "entity", "table", "confidence", "persistent").union(by_type)
    row = lambda df, kind, dst: df.select(F.col("id").alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), "confidence")
    return row(every, "uses-entity", F.concat(F.lit("entity:"), "entity")).union(row(every.filter("persistent"), "queries-table", F.concat(F.lit("table:"), "table")))


def scan_graph(spark: SparkSession, root: str, project: Project = Project(), store: str | None = None) -> ScannedGraph:  # noqa: B008
    """Scans a tree. Each file is read and lexed once; everything after is joins and aggregations.

    With a ``store`` (a folder that all executors share) files that it has facts of are not lexed again.
    """
    files = cut(scan(spark, root, [".ts", ".tsx", ".js", ".jsx", ".cs"]))
    architecture = project.guardrails is not None
    facts = cut(lex.facts(files, architecture) if store is None else kept_facts(files, store, architecture)[0])
    return graph_of(files, facts, project)


def graph_of(files: DataFrame, facts: DataFrame, project: Project = Project()) -> ScannedGraph:  # noqa: B008
    """The graph of files whose facts are known."""
    sources = cut(refined_nodes(file_nodes(files, project), facts))
    endpoints, endpoint_links = endpoint_nodes(facts, sources, files, project)
    known = cut(known_entities(facts, sources))
    stored, stored_links = persistence(facts, known)
    backend, logical, stores = backend_edges(facts, sources)
    usages = cut(entity_usages(facts, sources, known))
    nodes = cut(sources.unionByName(endpoints).unionByName(stored).unionByName(logical))
    links = import_edges(facts, files, project).union(endpoint_links).union(backend).union(stored_links).union(usage_edges(usages, stores, known))
    edges = cut(merge.admitted_edges(merge.first_edges(links.withColumn("seq", F.concat_ws("::", "src", "type", "dst"))), nodes).select("id", "src", "dst", "type", "confidence"))
    evidence = measure.quality_evidence(nodes, edges, project.feature_folder, list(project.entry_paths), list(project.entry_suffixes))
    warning = views.skipped_warning(files.filter("content is null").select("path"))
    return ScannedGraph(
        nodes, edges, findings(files, facts, project), coverage(facts, files, project), measure.orphans(nodes, edges, list(project.entry_paths), list(project.entry_suffixes)),
        measure.quality_scores(evidence), usages, reviews(facts, sources), [warning] if warning else [],
    )
