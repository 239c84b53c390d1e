"""Project maps of any number of repositories: which file is the map, what is wrong with each, each with its defaults.

A map is one JSON document, a row ``(repo, text)``.  Documents are parsed once into a variant and judged and
completed by native functions; a map stays in its row, nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalogue import _at, _is, _list, _strings, _text
from .rules import BACK_FRAGMENTS, FRONT_FRAGMENTS

# What holds where a map says nothing.
NAME = "Code Map"
GRAPH_OUTPUT = ".code-map/graph.json"
SUBMAPS_DIRECTORY = ".code-map/submaps"
IGNORED_DIRS = ["node_modules", "dist", "build", "coverage", "bin", "obj", ".git"]
TEMPLATES = [
    "filesystem", "typescript", "react", "architecture.feature-sliced", "architecture.mvvm", "http-endpoints", "csharp", "dotnet-api",
    "architecture.mvc", "architecture.clean-architecture", "architecture.cqrs", "entity-framework", "coverage", "quality",
]
UTILITY_CONTROLLERS = ["version", "health", "status", "probe"]
BOOTSTRAP_STEMS = ["program", "startup", "dependencyinjection", "servicecollectionextensions"]
INFRASTRUCTURE_FOLDERS = [
    "assets", "behaviors", "components", "config", "configurations", "constants", "context", "contracts", "data", "entities", "exceptions", "extensions",
    "helpers", "hooks", "interceptors", "layouts", "lib", "middleware", "middlewares", "migrations", "models", "repositories", "routes", "schemas",
    "services", "specifications", "stores", "styles", "test", "tests", "types", "utils", "utilities", "validation", "valueobjects", "value-objects",
]
COVERABLE_TYPES = ["route", "page", "main-component", "component", "subcomponent", "hook", "service", "repository"]
MAIN_NAME_PATTERN = "Main$|Main[A-Z]|View$|Container$|Content$"
FEATURE_FOLDER = "/features/{module}/"
ENTRY_SUFFIXES = ["/Program.cs"]
BACK_PATH_FRAGMENTS = {
    "dtoPathFragment": "/DTOs/", "controllerPathFragment": "/Controllers/", "handlerPathFragment": "/Handlers/", "repositoryPathFragment": "/Repositories/",
    "entityConfigurationPathFragment": "/Configurations/Entities/", "dataContextPathFragment": "/Data/Context/", "entityPathFragment": "/Entities/",
    "validatorPathFragment": "/Validators/", "mappingPathFragment": "/Mappings/",
}

#: A character that is no blank.
_INK = r"[^\t-\r\x20\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_NONE = "array<string>"
_CLASSIFIERS = "array<struct<contains:string,type:string,layer:string>>"


def _none() -> Column:
    return F.array().cast(_NONE)


def _if(wrong: Column, *message: str | Column) -> Column:
    """The message as a list of one, or an empty list."""
    text = F.concat(*(F.lit(m) if isinstance(m, str) else m for m in message))
    return F.when(F.coalesce(wrong, F.lit(False)), F.array(text)).otherwise(_none())


def _there(tree: Column, path: str) -> Column:
    """Whether the document has the name, be it null."""
    return _at(tree, path).isNotNull()


def _worded(tree: Column, path: str) -> Column:
    return F.coalesce(_text(tree, path).rlike(_INK), F.lit(False))


def _blank(tree: Column, path: str) -> Column:
    """Missing, null, false, zero or an empty text."""
    value = _at(tree, path)
    zero = _is(tree, path, "NUMBER") & (_at(tree, path, "double") == 0)
    false = _is(tree, path, "BOOLEAN") & ~_at(tree, path, "boolean")
    return value.isNull() | F.coalesce(F.is_variant_null(value) | zero | false | (_text(tree, path) == ""), F.lit(False))


def _record(item: Column) -> Column:
    return F.schema_of_variant(item).startswith("OBJECT")


def _required(tree: Column, path: str) -> Column:
    return F.concat(_if(_blank(tree, path), f"{path} is required."), _if(~_blank(tree, path) & ~_worded(tree, path), f"{path} must be a non-empty string."))


def _optional(tree: Column, path: str) -> Column:
    return _if(_there(tree, path) & ~_worded(tree, path), f"{path} must be a non-empty string.")


def _texts(tree: Column, path: str, blanks: bool = False) -> Column:
    """Faults of a list of texts that may be missing."""
    listed = _is(tree, path, "ARRAY")
    bad = F.exists(_strings(tree, path), lambda s: s.isNull() | (F.lit(False) if blanks else ~s.rlike(_INK)))
    return F.concat(_if(_there(tree, path) & ~listed, f"{path} must be an array."), _if(listed & bad, f"{path} must contain {'only strings' if blanks else 'only non-empty strings'}."))


def _strange(item: Column, known: list[str], *where: str | Column) -> Column:
    """A fault that names the properties which are not known, in order."""
    names = F.map_keys(F.try_variant_get(item, "$", "map<string,variant>"))
    strange = F.array_sort(F.array_except(names, F.array(*map(F.lit, known))))
    return _if(F.size(strange) > 0, *where, " contains unknown properties: ", F.array_join(strange, ", "), ".")


def _items(tree: Column, path: str, faults) -> Column:
    """Faults of each member of a list, in order; ``faults(item, where)`` judges one that is an object."""

    def one(item: Column, i: Column) -> Column:
        where = F.concat(F.lit(f"{path}["), i.cast("string"), F.lit("]"))
        return F.when(_record(item), faults(item, where)).otherwise(_if(F.lit(True), where, " must be an object."))

    return F.flatten(F.transform(_list(tree, path), one))


def _named(item: Column, where: Column, *names: str) -> Column:
    return F.concat(*(_if(~_worded(item, n), where, f".{n} must be a non-empty string.") for n in names))


def _within(tree: Column, path: str, *faults: Column) -> Column:
    """An optional object: one fault if it is none, else those of its content."""
    return F.when(_is(tree, path, "OBJECT"), F.concat(*faults)).otherwise(_if(_there(tree, path), f"{path} must be an object."))


def _list_of(tree: Column, path: str, faults) -> Column:
    return F.concat(_if(_there(tree, path) & ~_is(tree, path, "ARRAY"), f"{path} must be an array."), _items(tree, path, faults))


def _faults(tree: Column) -> Column:
    version = _at(tree, "schemaVersion", "double")
    whole = F.coalesce(_is(tree, "schemaVersion", "NUMBER") & (version == F.floor(version)), F.lit(False))
    alias = lambda x, at: F.concat(_named(x, at, "prefix", "path"), _strange(x, ["prefix", "path"], at))
    typed = lambda x, at: F.concat(*(_if(_there(x, n) & _text(x, n).isNull(), at, f".{n} must be a string.") for n in ("ruleId", "pathPattern", "expiresOn")))
    few = F.coalesce(F.size(_list(tree, "layers")) == 0, F.lit(True))
    parts = [
        _if(~whole, "schemaVersion must be an integer."),
        _if(whole & (version != 1), "Only project map schema version 1 is supported."),
        _if(_there(tree, "$schema") & _text(tree, "$schema").isNull(), "$schema must be a string."),
        _if(~_is(tree, "project", "OBJECT"), "project must be an object."),
        _required(tree, "project.name"),
        *(_optional(tree, f"project.{n}") for n in ("graphOutput", "runtimeLinks", "submapsDirectory")),
        _if(~_is(tree, "sourceRoots", "OBJECT"), "sourceRoots must be an object."),
        _required(tree, "sourceRoots.frontend"),
        _optional(tree, "sourceRoots.backend"),
        F.when(_is(tree, "sourceRoots", "OBJECT"), _strange(_at(tree, "sourceRoots"), ["frontend", "backend"], "sourceRoots")).otherwise(_none()),
        _within(tree, "templates", _texts(tree, "templates.enabled"), _texts(tree, "templates.plugins")),
        _texts(tree, "ignoredDirs", blanks=True),
        _within(tree, "imports", _list_of(tree, "imports.aliases", alias)),
        _if(_there(tree, "layers") & few, "layers must contain at least one layer when provided."),
        _items(tree, "layers", lambda x, at: _named(x, at, "id", "label")),
        _within(
            tree, "rules", _texts(tree, "rules.enabled", blanks=True), _if(_there(tree, "rules.options") & ~_is(tree, "rules.options", "OBJECT"), "rules.options must be an object."),
            _list_of(tree, "rules.suppressions", lambda x, at: F.concat(_named(x, at, "reason"), typed(x, at))),
        ),
        *(_if(_there(tree, n) & ~_is(tree, n, "OBJECT"), f"{n} must be an object.") for n in ("modules", "types", "frontend", "backend")),
    ]
    return F.concat(*parts)


def chosen(files: DataFrame) -> DataFrame:
    """repo, path, text of each repository's map among ``(repo, path, content)``: ``project-map.json`` at the top, else the
    first ``*.project-map.json`` there by name, else the same below ``.code-map``.

    Rows without repo or path are left out, equal paths count once (the smallest content), repositories without a map have no row.
    """
    path = F.col("path")
    folder = F.when(~F.contains(path, F.lit("/")), 0).when(path.rlike(r"\A\.code-map/[^/]*\z"), 1)
    name = F.element_at(F.split(path, "/"), -1)
    kind = F.when(name == "project-map.json", 0).when(name.endswith(".project-map.json"), 1)
    near = files.filter(F.col("repo").isNotNull() & folder.isNotNull() & kind.isNotNull())
    return near.groupBy("repo").agg(F.min(F.struct(folder, kind, path, F.col("content").alias("text"))).alias("first")).select("repo", "first.path", "first.text")


def _read(maps: DataFrame) -> DataFrame:
    tree = F.col("tree")
    parsed = maps.select("repo", F.try_parse_json("text").alias("tree"))
    record = F.coalesce(F.schema_of_variant(tree).startswith("OBJECT"), F.lit(False))
    faults = F.when(tree.isNull(), _if(F.lit(True), "Project map is no readable JSON.")).when(~record, _if(F.lit(True), "Project map must be a JSON object.")).otherwise(_faults(tree))
    return parsed.withColumn("issues", faults)


def judged(maps: DataFrame) -> DataFrame:
    """repo, issues of ``(repo, text)``: sentences on all that is wrong with a map, in the order of its parts; none if it is sound.

    A null, empty or unreadable text has one sentence, as has a document that is no object; a name that stands twice in an object
    makes the text unreadable.  A null repo is kept, repeated rows stay, other columns are left out.  Unknown properties are
    ordered by their bytes.
    """
    return _read(maps).select("repo", "issues")


def normalized(maps: DataFrame) -> DataFrame:
    """One typed row for each sound map of ``(repo, text)``, with defaults where it says nothing; maps with issues are left out.

    In modules, types, frontend and backend, which are not checked in depth, a value of another kind than its column is null.
    ``rules_options`` is JSON text; without the name of a backend its root is null.  An empty list stays empty.
    """
    tree = F.col("tree")
    words = lambda values: F.array(*map(F.lit, values))
    text = lambda p, default: F.when(_there(tree, p), _text(tree, p)).otherwise(F.lit(default))
    strings = lambda p, default: F.when(_there(tree, p), F.when(_is(tree, p, "ARRAY"), _strings(tree, p))).otherwise(words(default) if default else _none())
    other = lambda p, kind, default: F.when(_there(tree, p), _at(tree, p, kind)).otherwise(default)
    labels = lambda p: other(p, "map<string,string>", F.create_map().cast("map<string,string>"))
    rows = lambda p, kind: other(p, kind, F.array().cast(kind))
    classes = lambda p, values: other(p, _CLASSIFIERS, F.array(*(F.struct(F.lit(c).alias("contains"), F.lit(t).alias("type"), F.lit(y).alias("layer")) for c, t, y in values)))
    columns = {
        "name": text("project.name", NAME), "graph_output": text("project.graphOutput", GRAPH_OUTPUT), "submaps_directory": text("project.submapsDirectory", SUBMAPS_DIRECTORY), "runtime_links": _text(tree, "project.runtimeLinks"),
        "frontend_root": _text(tree, "sourceRoots.frontend"), "backend_root": _text(tree, "sourceRoots.backend"),
        "templates": strings("templates.enabled", TEMPLATES), "plugins": strings("templates.plugins", []), "ignored_dirs": strings("ignoredDirs", IGNORED_DIRS),
        "aliases": rows("imports.aliases", "array<struct<prefix:string,path:string>>"), "layers": rows("layers", "array<struct<id:string,label:string>>"),
        "shared_module": text("modules.shared", "shared"), "module_labels": labels("modules.labels"), "utility_controllers": strings("modules.utilityControllers", UTILITY_CONTROLLERS),
        "bootstrap_stems": strings("modules.bootstrapStems", BOOTSTRAP_STEMS), "infrastructure_folders": strings("modules.infrastructureFolders", INFRASTRUCTURE_FOLDERS),
        "type_labels": labels("types.labels"), "type_colors": labels("types.colors"),
        "front_classifiers": classes("frontend.classifiers", FRONT_FRAGMENTS), "entry_points": strings("frontend.entryPoints", []), "coverable_types": strings("frontend.coverableTypes", COVERABLE_TYPES),
        "main_name_pattern": text("frontend.componentMainNamePattern", MAIN_NAME_PATTERN), "feature_folder_pattern": text("frontend.featureFolderPattern", FEATURE_FOLDER),
        "back_classifiers": classes("backend.classifiers", BACK_FRAGMENTS), "entry_suffixes": strings("backend.entryPointSuffixes", ENTRY_SUFFIXES),
        "back_fragments": F.struct(*(text(f"backend.{n}", v).alias(n) for n, v in BACK_PATH_FRAGMENTS.items())),
        "rules_enabled": strings("rules.enabled", []), "rules_options": F.coalesce(F.to_json(_at(tree, "rules.options")), F.lit("{}")),
        "suppressions": rows("rules.suppressions", "array<struct<ruleId:string,pathPattern:string,reason:string,expiresOn:string>>"),
    }
    return _read(maps).filter(F.size("issues") == 0).select("repo", *(c.alias(n) for n, c in columns.items()))
