"""What repositories are made of: source roots, stacks, modules, entry points and aliases, of any number of them at once.

Files are a table ``(repo, path, content)``, paths below the repository, with slashes.  Each file counts for
every folder above it, so a folder exists if a file lies in it.  Of a repository only what stands in the
fixed lists below is gathered (one row, bounded by the lists, merged before the shuffle); modules stay a table.
Contents are read of the few configuration files only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.work import cut

# Fixed values, in the order that decides.
ROOTS = [("front/src", "back"), ("frontend/src", "backend"), ("client/src", "server"), ("web/src", "api"), ("app/src", "api"), ("src", None)]
FEATURE_FOLDERS = ["features", "modules", "domains", "pages", "views"]
INFRASTRUCTURE = [
    "assets", "behaviors", "components", "config", "configurations", "constants", "context", "contracts", "data", "entities", "exceptions", "extensions",
    "helpers", "hooks", "interceptors", "layouts", "lib", "middleware", "middlewares", "migrations", "models", "repositories", "routes", "schemas",
    "services", "specifications", "stores", "styles", "test", "types", "utils", "utilities", "validation", "valueobjects", "value-objects",
]
ENTRY_FILES = ["App.tsx", "App.ts", "App.jsx", "main.tsx", "main.ts", "main.jsx", "index.tsx", "index.ts"]
ROUTE_FILES = ["AppRoutes/index.tsx", "AppRoutes.tsx", "index.tsx"]
NAME_FOLDERS = ["front", "frontend", "client", ""]
NODE_FOLDERS = ["backend", "server", "api"]
UNSEARCHED = [".git", "node_modules", "dist", "build", "coverage", "bin", "obj", ".cache"]
TEMPLATES = ["filesystem", "typescript"]
REACT_TEMPLATES = ["react", "architecture.feature-sliced", "architecture.mvvm"]
DOTNET_TEMPLATES = ["csharp", "dotnet-api", "architecture.mvc", "architecture.clean-architecture", "architecture.cqrs", "entity-framework"]
LAYERS = {
    "full": [
        ("ui-route", "Routes"), ("ui-page", "Pages"), ("ui-main-component", "Main Components"), ("ui-component-logic", "Components / Logic"),
        ("front-service", "Frontend Services"), ("front-repository", "Frontend Repositories"), ("api-endpoint", "API Endpoints"),
        ("api-controller", "Controllers"), ("application-request", "Commands & Queries"), ("application-handler", "Handlers"),
        ("backend-service", "Backend Services"), ("backend-repository", "Persistence Repositories"), ("domain", "Entities"), ("database-table", "DB Tables"),
    ],
    "ui": [
        ("ui-route", "Routes"), ("ui-page", "Pages"), ("ui-main-component", "Main Components"), ("ui-component-logic", "Components / Logic"),
        ("front-service", "Services"), ("front-repository", "Repositories"),
    ],
    "fallback": [("ui-route", "Routes"), ("ui-page", "Pages"), ("ui-component-logic", "Components"), ("front-service", "Services"), ("api-endpoint", "API Endpoints")],
}
#: A frontend before an interface without the layers behind it: the full list down to the controllers.
LAYERS["api"] = LAYERS["full"][:8]


@dataclass(frozen=True)
class Detector:
    """A stack: there if one of its dependencies is installed, or one of its files stands at the top, or a file with its suffix anywhere."""

    id: str
    dependencies: tuple[str, ...] = ()
    files: tuple[str, ...] = ()
    suffix: str | None = None


FRONTENDS = (Detector("react", ("react", "react-dom")), Detector("vue", ("vue",)), Detector("angular", ("@angular/core",)))
BACKENDS = (
    Detector("dotnet", suffix=".csproj"),
    Detector("go", files=("go.mod",)),
    Detector("python", files=("requirements.txt",)),
    Detector("node", ("express", "fastify", "koa", "hapi", "nestjs", "@nestjs/core")),
)


@dataclass(frozen=True)
class Detectors:
    """The stacks that are looked for, first match first; an id may stand once on each side."""

    frontend: tuple[Detector, ...] = FRONTENDS
    backend: tuple[Detector, ...] = BACKENDS
    every: tuple[Detector, ...] = field(init=False, repr=False)

    def __post_init__(self) -> None:
        for side, those in (("frontend", self.frontend), ("backend", self.backend)):
            ids = [d.id for d in those]
            if twice := sorted({i for i in ids if ids.count(i) > 1}):
                raise ValueError(f"{side} detectors stand twice: {', '.join(twice)}")
            if any(not d.id for d in those):
                raise ValueError(f"{side} detectors need an id")
        object.__setattr__(self, "every", (*self.frontend, *self.backend))


@dataclass(frozen=True)
class Detected:
    """projects: one row a repository; modules(repo, module, label); aliases(repo, ord, prefix, path)."""

    projects: DataFrame
    modules: DataFrame
    aliases: DataFrame


def titled(name: Column) -> Column:
    """Hyphens and underscores as spaces, the first letter of each ASCII word in upper case."""
    words = F.split(F.regexp_replace(name, "[-_]", " "), "(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])")
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.array_join(F.transform(words, lambda w: F.concat(F.translate(F.substring(w, 1, 1), lower, upper), F.substring(w, F.lit(2), F.length(w)))), "")


def _under(folder: str, name: str) -> str:
    return f"{folder}/{name}" if folder else name


def _above(folder: str) -> str:
    return folder.rpartition("/")[0]


def _probed(detectors: Detectors) -> list[str]:
    """Every path whose presence may decide anything."""
    fronts, backs = [f for f, _ in ROOTS], [b for _, b in ROOTS if b]
    inside = [*FEATURE_FOLDERS, *ENTRY_FILES, "routes", *(f"routes/{r}" for r in ROUTE_FILES)]
    return list(dict.fromkeys([*fronts, *backs, *(f"{f}/{x}" for f in fronts for x in inside), *(x for d in detectors.every for x in d.files)]))


def _package_paths() -> list[str]:
    folders = [*NAME_FOLDERS, *(_above(f) for f, _ in ROOTS), *NODE_FOLDERS]
    return list(dict.fromkeys(_under(f, "package.json") for f in folders))


def _present(detectors: Detectors) -> Column:
    """The probed paths that a file stands for, and folder/* for a backend's folders that may hold projects; null for each depth that stands for none."""
    parts = F.split("path", "/")
    probed = _probed(detectors)
    deepest = max(p.count("/") for p in probed) + 1
    backs = sorted({b for _, b in ROOTS if b})
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    projects = F.substring_index("path", "/", 1).isin(backs) & (F.size(parts) > 2) & ~second.startswith(".") & (second != "node_modules")
    way = lambda i: F.substring_index("path", "/", i)
    return F.array(*(F.when(way(i).isin([p for p in probed if p.count("/") < i]), way(i)) for i in range(1, deepest + 1)), F.when(projects, F.concat(first, F.lit("/*"))))


def _package(detectors: Detectors) -> Column:
    """path, name and known dependencies of a package file that can be read; else null."""
    tree = F.try_parse_json("content")
    known = list(dict.fromkeys(x for d in detectors.every for x in d.dependencies))
    at = lambda group, x: F.try_variant_get(tree, f"$.{group}['{x}']", "string")
    installed = [F.when(F.coalesce(at("devDependencies", x), at("dependencies", x)) != "", F.lit(x)) for x in known]
    listed = F.array_compact(F.array(*installed)) if installed else F.array().cast("array<string>")
    return F.when(tree.isNotNull() & ~F.is_variant_null(tree), F.struct("path", F.try_variant_get(tree, "$.name", "string").alias("name"), listed.alias("installed")))


def _evidence(files: DataFrame, detectors: Detectors) -> DataFrame:
    """repo, present, packages, suffixes: one row a repository, no larger than the fixed lists."""
    suffixes = sorted({d.suffix for d in detectors.every if d.suffix})
    folders = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    searched = ~F.arrays_overlap(folders, F.array(*map(F.lit, UNSEARCHED)))
    package = _package(detectors)
    kind = files.select(package.alias("p")).schema["p"].dataType
    # What many files of a repository say is said once before it is gathered; a row with nothing keeps the repository.
    none = lambda t: F.lit(None).cast(t)
    paths = files.select("repo", F.explode(_present(detectors)).alias("present")).distinct().select("repo", "present", none("string").alias("suffix"), none(kind).alias("package"))
    told = paths.union(files.filter(F.col("path").isin(_package_paths())).select("repo", none("string"), none("string"), package))
    for s in suffixes:
        told = told.union(files.filter(F.col("path").endswith(s) & searched).select("repo", none("string"), F.lit(s), none(kind)).distinct())
    return told.groupBy("repo").agg(F.collect_set("present").alias("present"), F.collect_set("suffix").alias("suffixes"), F.array_sort(F.collect_set("package")).alias("packages"))


def _has(path: Column | str) -> Column:
    return F.array_contains("present", path)


def _first(cases: Sequence[tuple[Column, Column]]) -> Column:
    return F.coalesce(*(F.when(when, then) for when, then in cases), F.lit(None))


def _readable(folders: Sequence[str]) -> Column:
    """The package of the first of the folders that has one."""
    one = lambda folder: F.get(F.filter("packages", lambda p: p["path"] == _under(folder, "package.json")), F.lit(0))
    return F.coalesce(*map(one, folders))


def _by_root(value) -> Column:
    """A value that depends on the chosen root, of the possible ones."""
    return F.coalesce(*(F.when(F.col("frontend_root") == f, value(f)) for f, _ in ROOTS))


def _stack(detectors: Sequence[Detector], package: Column) -> Column:
    cases = []
    for d in detectors:
        found = F.lit(False)
        for x in d.dependencies:
            found = found | F.coalesce(F.array_contains(package["installed"], x), F.lit(False))
        for x in d.files:
            found = found | _has(x)
        if d.suffix:
            found = found | F.array_contains("suffixes", d.suffix)
        cases.append((found, F.lit(d.id)))
    return _first(cases).cast("string")


def _layers(frontend: Column, backend: Column) -> Column:
    react = F.coalesce(frontend == "react", F.lit(False))
    listed = lambda k: F.array(*(F.struct(F.lit(i).alias("id"), F.lit(n).alias("label")) for i, n in LAYERS[k]))
    return F.when(react & (backend == "dotnet"), listed("full")).when(react & backend.isin("node", "go"), listed("api")).when(react & backend.isNull(), listed("ui")).otherwise(listed("fallback"))


def _projects(evidence: DataFrame, detectors: Detectors) -> DataFrame:
    rooted = [F.when(_has(f), F.struct(F.lit(f).alias("front"), (F.when(_has(b), F.lit(b)) if b else F.lit(None).cast("string")).alias("back"))) for f, b in ROOTS]
    root = F.coalesce(*rooted, F.struct(F.lit("src").alias("front"), F.lit(None).cast("string").alias("back")))
    out = evidence.withColumn("root", root).withColumn("frontend_root", F.col("root.front")).withColumn("backend_root", F.col("root.back"))
    out = out.withColumn("feature_folder", _by_root(lambda f: _first([(_has(f"{f}/{x}"), F.lit(x)) for x in FEATURE_FOLDERS])).cast("string"))
    entry = _by_root(lambda f: _first([(_has(f"{f}/{x}"), F.lit(f"{f}/{x}")) for x in ENTRY_FILES]))
    route = _by_root(lambda f: _first([(_has(f"{f}/routes/{x}"), F.lit(f"{f}/routes/{x}")) for x in ROUTE_FILES]))
    front = _stack(detectors.frontend, _by_root(lambda f: _readable([_above(f), ""])))
    back = F.when(F.col("backend_root").isNotNull(), _stack(detectors.backend, _readable(NODE_FOLDERS)))
    out = out.withColumn("frontend_framework", front).withColumn("backend_stack", back)
    raw = F.coalesce(_readable(NAME_FOLDERS)["name"], F.element_at(F.split(F.regexp_replace("repo", r"/+\z", ""), "/"), -1))
    when = lambda c, value, those: F.when(F.coalesce(F.col(c) == value, F.lit(False)), F.array(*map(F.lit, those))).otherwise(F.array().cast("array<string>"))
    templates = F.concat(F.array(*map(F.lit, TEMPLATES)), when("frontend_framework", "react", REACT_TEMPLATES), F.array(F.lit("http-endpoints")), when("backend_stack", "dotnet", DOTNET_TEMPLATES), F.array(F.lit("coverage"), F.lit("quality")))
    inner = F.concat(F.lit("^"), F.col("frontend_root"), F.lit("/"), F.coalesce(F.concat(F.col("feature_folder"), F.lit("/")), F.lit("")), F.lit("([^/]+)"))
    behind = lambda tail: F.when(_has(F.concat(F.col("backend_root"), F.lit("/*"))), F.concat(F.lit("^"), F.col("backend_root"), F.lit(tail)))
    return out.select(
        "repo", titled(F.regexp_replace(raw, r"\A@[^/]+/", "")).alias("name"), "frontend_root", "backend_root", "frontend_framework", "backend_stack", "feature_folder",
        F.concat(F.lit("/"), F.coalesce("feature_folder", F.lit("features")), F.lit("/{module}/")).alias("feature_folder_pattern"), inner.alias("frontend_feature_pattern"),
        behind("/[^/]+/([^/]+)").alias("backend_project_pattern"), behind(r"/[^/]+/Controllers/(.+?)Controller\.cs$").alias("backend_controller_pattern"), behind("/[^/]+/Entities/([^/]+)").alias("backend_entity_pattern"),
        F.array_compact(F.array(entry, route)).alias("entry_points"), templates.alias("templates"), _layers(F.col("frontend_framework"), F.col("backend_stack")).alias("layers"),
    )


def _modules(files: DataFrame, projects: DataFrame) -> DataFrame:
    """repo, module, label: the folders below the feature folder, or those of the root that are no infrastructure."""
    homes = [h for f, _ in ROOTS for h in (f, *(f"{f}/{x}" for x in FEATURE_FOLDERS))]
    upto = lambda k: F.substring_index("path", "/", k)
    # At most one home of each depth holds a file; one that stands in the home itself is no module's.
    child = lambda k: F.when(upto(k).isin([h for h in homes if h.count("/") + 1 == k]) & (upto(k + 1) != F.col("path")), F.struct(upto(k).alias("home"), F.substring_index(upto(k + 1), "/", -1).alias("module")))
    depths = sorted({h.count("/") + 1 for h in homes})
    children = files.select("repo", F.explode(F.array(*map(child, depths))).alias("c")).filter("c is not null").select("repo", "c.home", "c.module").distinct()
    home = F.concat_ws("/", "frontend_root", "feature_folder")
    chosen = projects.select("repo", home.alias("home"), F.col("feature_folder").isNull().alias("plain"))
    kept = children.join(chosen, ["repo", "home"]).filter(~F.col("plain") | ~F.col("module").isin(INFRASTRUCTURE))
    return kept.select("repo", "module", titled(F.col("module")).alias("label"))


_STRINGS = r'("(?:[^"\\]++|\\.)*+")'


def _plain_json(text: Column) -> Column:
    """JSON without comments and without commas before a closing bracket."""
    bare = F.regexp_replace(text, _STRINGS + r"|//[^\n\r]*+|/\*[\s\S]*?\*/", "$1")
    return F.regexp_replace(bare, _STRINGS + r"|,(\s*[}\]])", "$1$2")


def _joined(folder: Column, target: Column) -> Column:
    """A target below a folder, with . and .. taken away; a slash at the end stays."""
    whole = F.concat(F.when(folder == "", F.lit("")).otherwise(F.concat(folder, F.lit("/"))), target)
    up = lambda acc: (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), acc), -1) != "..")
    step = lambda acc, x: F.when((x == "") | (x == "."), acc).when((x == "..") & up(acc), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    short = F.array_join(F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step), "/")
    full = F.concat(F.when(whole.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.when(short == "", F.when(whole.startswith("/"), "").otherwise(".")).otherwise(short))
    return F.when(whole.endswith("/") & ~full.endswith("/"), F.concat(full, F.lit("/"))).otherwise(full)


def _aliases(files: DataFrame, projects: DataFrame) -> DataFrame:
    """repo, ord, prefix, path: the first target of each path in the tsconfig.json beside the frontend's root, in its order."""
    folders = list(dict.fromkeys(_above(f) for f, _ in ROOTS))
    read = files.filter(F.col("path").isin([_under(f, "tsconfig.json") for f in folders]))
    tree = F.from_json(_plain_json(F.col("content")), "compilerOptions struct<paths: map<string, array<string>>>")
    folder = F.regexp_replace("path", "/?tsconfig\\.json\\z", "")
    named = read.select("repo", folder.alias("folder"), F.map_entries(tree["compilerOptions"]["paths"]).alias("entries")).groupBy("repo", "folder").agg(F.min("entries").alias("entries"))
    rows = named.select("repo", "folder", F.posexplode("entries").alias("ord", "e")).select("repo", "folder", "ord", F.col("e.key").alias("key"), F.get("e.value", F.lit(0)).alias("target")).filter("target is not null")
    chosen = projects.select("repo", _by_root(lambda f: F.lit(_above(f))).alias("folder"))
    key, target = F.col("key"), F.regexp_replace(F.regexp_replace("target", r"\A\./", ""), r"/\*\z", "")
    cut_star = F.substring(key, F.lit(1), F.length(key) - 1)
    prefix = F.when(key.endswith("/*"), cut_star).when(key.endswith("*"), F.concat(cut_star, F.lit("/"))).when(key.endswith("/"), key).otherwise(F.concat(key, F.lit("/")))
    return rows.join(chosen, ["repo", "folder"]).select("repo", F.col("ord").cast("long").alias("ord"), prefix.alias("prefix"), _joined(F.col("folder"), target).alias("path"))


def detect(files: DataFrame, detectors: Detectors | None = None) -> Detected:
    """Every repository of ``files(repo, path, content)``.

    Rows without repo or path are left out, extra columns too; repeated rows change nothing, and
    of two contents of one path the smaller counts.  Unreadable or empty configuration counts as
    none.  No files: no projects.  The roots are the first candidate of which a file is there (else
    src, with no backend); stacks are the first detector that matches.  The projects are written once.
    """
    known = detectors or Detectors()
    named = files.filter("repo is not null and path is not null").select(F.col("repo").cast("string").alias("repo"), "path", "content")
    projects = cut(_projects(_evidence(named, known), known))
    return Detected(projects, _modules(named, projects), _aliases(named, projects))


def summary(found: Detected) -> DataFrame:
    """repo, roots, stacks and module_count of each repository."""
    counted = found.modules.groupBy("repo").agg(F.count("*").alias("n"))
    kept = ["repo", "frontend_root", "backend_root", "frontend_framework", "backend_stack"]
    return found.projects.select(*kept).join(counted, "repo", "left").select(*kept, F.coalesce("n", F.lit(0)).cast("long").alias("module_count"))
