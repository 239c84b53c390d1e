"""Classification, endpoints, import resolution, findings and their suppression, ordered views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clean_url, kebab, suppression_glob
from ..sources.work import cut

#: Fixed values, in the order that decides: the first fragment that a path contains.
FRONT_FRAGMENTS = [
    ("/routes/", "route", "ui-route"), ("/pages/", "page", "ui-page"), ("/hooks/", "hook", "ui-component-logic"), ("/services/", "service", "front-service"), ("/repositories/", "repository", "front-repository"),
    ("/config/", "config", "config"), ("/stores/", "auxiliary", "auxiliary"), ("/types/", "auxiliary", "auxiliary"), ("/schemas/", "config", "config"), ("/utils/", "auxiliary", "auxiliary"), ("/lib/", "auxiliary", "auxiliary"),
]
BACK_FRAGMENTS = [
    ("/Controllers/", "controller", "api-controller"), ("/Queries/", "query", "application-request"), ("/Commands/", "command", "application-request"), ("/Handlers/", "handler", "application-handler"), ("/DTOs/", "dto", "hidden-dto"),
    ("/Repositories/", "auxiliary", "auxiliary"), ("/Configurations/Entities/", "auxiliary", "auxiliary"), ("/Data/Context/", "auxiliary", "auxiliary"), ("/Entities/", "entity", "domain"),
]
SEVERITIES = ["error", "warning"]


def first_match(path: Column, fragments: list[tuple[str, str, str]], default: tuple[str, str] = ("auxiliary", "auxiliary")) -> Column:
    """struct(type, layer) by the first fragment that the path contains."""
    pair = lambda t, l: F.struct(F.lit(t).alias("type"), F.lit(l).alias("layer"))  # noqa: E731, E741
    out = None
    for fragment, t, layer in fragments:
        hit = F.contains(F.concat(F.lit("/"), path), F.lit(fragment))
        out = F.when(hit, pair(t, layer)) if out is None else out.when(hit, pair(t, layer))
    return out.otherwise(pair(*default))


def classify_front(path: Column) -> Column:
    """Hooks by name, then the component tree, then configured fragments."""
    pair = lambda t, l: F.struct(F.lit(t).alias("type"), F.lit(l).alias("layer"))  # noqa: E731, E741
    parts = F.split(path, "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*\z", "")
    folder = F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))
    hook = stem.rlike(r"\Ause[A-Z0-9]") | folder.rlike(r"\Ause[A-Z0-9]")
    last = lambda name: F.size(parts) - F.array_position(F.reverse(parts), name)
    at = F.greatest(*(F.when(F.array_contains(parts, n), last(n)).otherwise(-1) for n in ("components", "pages")))
    below = F.when(at >= 0, F.slice(parts, at.cast("int") + 2, F.size(parts)))
    depth = F.size(below)
    nested = F.exists(below, lambda s: s.startswith("_")) | (depth > 2)
    index = stem == "index"
    in_pages = F.get(parts, at.cast("int")) == "pages"
    page = in_pages & (((depth == 1) & ~index) | ((depth == 2) & index))
    main = ~in_pages & (depth == 2) & index & F.get(below, F.lit(0)).rlike(r"Main\z|Main[A-Z]|View\z|Container\z|Content\z")
    tree = F.when(nested, pair("subcomponent", "ui-component-logic")).when(page, pair("page", "ui-page")).when(main, pair("main-component", "ui-component-logic")).otherwise(pair("component", "ui-component-logic"))
    return F.when(hook, pair("hook", "ui-component-logic")).when(at >= 0, tree).otherwise(first_match(path, FRONT_FRAGMENTS))


def classify_back(path: Column) -> Column:
    return first_match(path, BACK_FRAGMENTS)


def module_of(path: Column, front_pattern: str = r"front/features/([^/]+)/", controller_pattern: str = r"/Controllers/([A-Za-z]+)Controller\.cs\z", utility: tuple[str, ...] = ("version", "health", "status", "probe")) -> Column:
    """Front feature, else controller name (utilities are shared), else the folder below back, else shared."""
    part = lambda p: F.nullif(F.regexp_extract(path, p, 1), F.lit(""))
    controller = kebab(part(controller_pattern))
    return F.coalesce(part(front_pattern), F.when(controller.isin(*utility), F.lit("shared")).otherwise(controller), part(r"\Aback/[^/]+/([^/]+)/"), F.lit("shared"))


def distinct_endpoints(found: DataFrame) -> DataFrame:
    """Of (file, url, method, ord): ANY goes where the url has a method of its own; then the first of each."""
    w = W.partitionBy("file", "url")
    kept = found.withColumn("own", F.max((F.col("method") != "ANY").cast("int")).over(w)).filter("method <> 'ANY' or own = 0")
    return kept.groupBy("file", "url", "method").agg(F.min("ord").alias("ord"))


def link_endpoints(front: DataFrame, controllers: DataFrame) -> DataFrame:
    """src, dst of front endpoints and controllers' with the same url; ANY in front fits every method."""
    f = front.select(F.col("id").alias("src"), F.col("method").alias("m"), clean_url(F.col("url")).alias("key"))
    c = controllers.select(F.col("id").alias("dst"), F.col("method").alias("cm"), clean_url(F.col("url")).alias("key"))
    return f.distinct().join(c.distinct(), "key").filter("(m = 'ANY' or m = cm) and src <> dst").select("src", "dst")


def folded_path(path: Column) -> Column:
    """The path with its . and .. segments carried out; .. at the top stays away."""
    step = lambda acc, x: F.when((x == "") | (x == "."), acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def resolve_imports(imports: DataFrame, files: DataFrame, aliases: list[tuple[str, str]], endings: list[str], extensions: tuple[str, ...] = (".ts", ".tsx", ".js", ".jsx")) -> DataFrame:
    """file, specifier, target, ord: relative and aliased specifiers to the first candidate file that exists.

    ``imports(file, specifier)``.  A specifier that begins with a dot is relative to the
    file's folder, whatever its . and .. segments; of those that begin with @ the first
    alias counts whose prefix fits.  One that ends in a known extension has that one candidate, any
    other one candidate for each of ``endings``.  Null files or specifiers resolve to nothing.
    """
    folder = F.when(F.contains("file", F.lit("/")), F.regexp_replace("file", r"/[^/]*\z", "/")).when(F.col("file").isNotNull(), "")
    rest = lambda n: F.substring("specifier", F.lit(n + 1), F.length("specifier"))
    base = F.when(F.col("specifier").startswith("."), F.concat(folder, "specifier"))
    for prefix, target in aliases:
        base = base.when(F.col("specifier").startswith("@") & F.col("specifier").startswith(prefix), F.concat(F.lit(target), rest(len(prefix))))
    known = F.lit(False)
    for e in extensions:
        known = known | F.col("specifier").endswith(e)
    tries = F.when(known, F.array(F.lit(""))).otherwise(F.array(*map(F.lit, endings)))
    based = imports.select("file", "specifier", folded_path(base).alias("base"), tries.alias("tries")).filter("base is not null")
    candidates = based.select("file", "specifier", "base", F.posexplode("tries").alias("ord", "ending")).select("file", "specifier", "ord", F.concat("base", "ending").alias("target"))
    found = candidates.join(files.select(F.col("path").alias("target")).distinct(), "target")
    return found.groupBy("file", "specifier").agg(F.min(F.struct("ord", "target")).alias("m")).select("file", "specifier", "m.target", "m.ord")


def ranked_lookup(wanted: DataFrame, declared: DataFrame) -> DataFrame:
    """For (source, name, module) the declaration of that name: same module first, then the first path; ambiguous if several."""
    found = tiered_lookup(wanted, declared.select("name", "module", "path", F.lit(0).alias("tier")), lambda path: F.lit(False))
    return found.select("source", "name", "target", "ambiguous")


def tiered_lookup(wanted: DataFrame, declared: DataFrame, is_test) -> DataFrame:
    """source, name, target, ambiguous, tier: for (source, name, module) the best of ``declared(path, module, name, tier)``:
    the lowest tier, then the same module, then no test, then the first path; ambiguous if the best tier holds several.

    Declarations come down to one a name and one a name and module before anything is
    joined, so a name that is declared very often costs a caller no more than a rare one.
    """
    place = F.struct("tier", is_test(F.col("path")).cast("int").alias("test"), "path")
    own = declared.groupBy("name", "tier", F.col("module").alias("d_module")).agg(F.min(place).alias("own"), F.count("*").alias("n"))
    first = own.groupBy("name").agg(F.min("own").alias("first"), F.min("tier").alias("low"))
    several = own.groupBy("name", F.col("tier").alias("low")).agg(F.sum("n").alias("several"))
    best = first.join(several, ["name", "low"])
    near = own.select("name", F.col("tier").alias("low"), F.col("d_module").alias("module"), "own")
    joined = wanted.select("source", "name", "module").distinct().join(best, "name").join(near, ["name", "low", "module"], "left")
    return joined.select("source", "name", F.coalesce("own.path", "first.path").alias("target"), (F.col("several") > 1).alias("ambiguous"), F.col("low").alias("tier"))


def positioned(rows: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Adds each row's place, from 0, in a total order.

    Rows are dealt into ranges of that order, sorted and numbered as they are written, and
    offset by the sizes of the ranges before theirs, so no task holds more than a range.
    """
    ranged = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))  # the range above 33 bits of place
    of_range = F.shiftright("__at", 33).alias("__range")
    sizes = ranged.groupBy(of_range).agg(F.count("*").alias("n"))
    first = sizes.select("__range", F.coalesce(F.sum("n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__first"))
    full = ranged.select(*rows.columns, of_range, F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)).alias("__place")).join(F.broadcast(first), "__range")
    return full.select(*rows.columns, (F.col("__first") + F.col("__place")).alias(name))


def numbered(findings: DataFrame) -> DataFrame:
    """Adds id: rule, node, line and the finding's number in the order of rule, path, line and evidence."""
    order = [F.col("rule_id"), F.coalesce("path", F.lit("")), F.coalesce("line", F.lit(0)), F.col("evidence")]
    full = positioned(findings, order, "__at")
    return full.select(F.concat_ws(":", "rule_id", "node_id", F.coalesce("line", F.lit(0)).cast("string"), F.col("__at").cast("string")).alias("id"), *findings.columns)


def runtime_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Manual edges between nodes named by id, logical id or path; links with a missing end are left out."""
    names = nodes.select(F.col("id").alias("name"), "id").union(nodes.filter("path is not null").select(F.concat(F.lit("file:"), "path"), "id")).union(nodes.filter("path is not null").select("path", "id"))
    names = names.groupBy("name").agg(F.min("id").alias("id"))
    plain = lambda c: F.replace(c, F.lit("\\"), F.lit("/"))
    end = lambda c: names.select(F.col("name").alias(c), F.col("id").alias(f"{c}_id"))
    joined = links.select(plain(F.col("from")).alias("f"), plain(F.col("to")).alias("t"), F.coalesce("type", F.lit("runtime-link")).alias("type"), F.coalesce("confidence", F.lit("manual")).alias("confidence"))
    joined = joined.join(end("f"), "f").join(end("t"), "t").filter("f_id <> t_id")
    return joined.select(F.concat_ws("::", "f_id", "type", "t_id").alias("id"), F.col("f_id").alias("src"), F.col("t_id").alias("dst"), "type", "confidence").dropDuplicates(["id"])


def suppressed(findings: DataFrame, suppressions: list[dict[str, str]], today: str | None = None) -> DataFrame:
    """Adds suppressed, reason and the suppression's own rule, path and expiry date.

    Of each finding the first suppression counts whose rule, if it names one, is the
    finding's and whose path glob, if it has one, fits the finding's path (none: empty).
    Those without a reason count for nothing; with ``today`` (an ISO date) nor do those
    that have run out.
    """
    fits, kinds = None, "reason string, suppression_rule string, suppression_path string, expires string"
    for s in suppressions:
        if not s.get("reason") or today is not None and s.get("expires") is not None and s["expires"] < today:
            continue
        hit = F.lit(True)
        if s.get("rule"):
            hit = hit & (F.col("rule_id") == s["rule"])
        if s.get("path"):
            hit = hit & F.coalesce("path", F.lit("")).rlike(suppression_glob(s["path"]))
        values = F.struct(*(F.lit(s.get(k)).cast("string").alias(c) for k, c in (("reason", "reason"), ("rule", "suppression_rule"), ("path", "suppression_path"), ("expires", "expires"))))
        fits = F.when(hit, values) if fits is None else fits.when(hit, values)
    out = findings.withColumn("__by", fits if fits is not None else F.lit(None).cast(f"struct<{kinds.replace(' ', ':').replace(',:', ',')}>"))
    return out.select(*findings.columns, "__by.*").withColumn("suppressed", F.col("reason").isNotNull())


def finding_order() -> list[Column]:
    """Severity, path, line, rule."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return [rank, F.col("path"), F.col("line"), F.col("rule_id")]


def auxiliary_layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, layer for auxiliary nodes: the layer of the first neighbour (by edge id) that is not auxiliary."""
    aux = nodes.filter("layer = 'auxiliary'").select("id")
    near = edges.select("id", F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("id", "dst", "src")).toDF("edge", "id", "other")
    kept = near.join(aux, "id", "left_semi").join(nodes.filter("layer <> 'auxiliary'").select(F.col("id").alias("other"), "layer"), "other")
    return kept.groupBy("id").agg(F.min_by("layer", "edge").alias("layer"))
