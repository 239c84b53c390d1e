import pytest

from graphloom.operators import detection


def found(spark, files, **options):
    rows = [(repo, path, text) for repo, tree in files.items() for path, text in tree.items()]
    return detection.detect(spark.createDataFrame(rows, "repo string, path string, content string"), **options)


def one(df):
    return {r["repo"]: r for r in df.collect()}


@pytest.mark.parametrize(
    "tree, expected",
    [
        (["front/src/a.ts", "back/x.cs", "src/b.ts"], ("front/src", "back")),
        (["frontend/src/a.ts", "back/x.cs"], ("frontend/src", None)),
        (["client/src/a.ts", "server/x.js", "api/y.js"], ("client/src", "server")),
        (["web/src/a.ts", "app/src/b.ts", "api/y.js"], ("web/src", "api")),
        (["front/source/a.ts", "src/a.ts", "back/x.cs"], ("src", None)),
        (["front/src"], ("front/src", None)),
        (["lib/src/a.ts"], ("src", None)),
    ],
)
def test_roots(spark, tree, expected):
    row = found(spark, {"r": dict.fromkeys(tree, "")}).projects.first()
    assert (row["frontend_root"], row["backend_root"]) == expected


def test_stacks(spark):
    package = lambda *names: "{%s}" % f'"dependencies": {{{", ".join(f"{n!r}: {1!r}" for n in names)}}}'.replace("'", '"').replace(": 1", ': "1"')
    trees = {
        "react first": {"front/package.json": package("vue", "react"), "front/src/a.ts": ""},
        "beside the root": {"front/package.json": package("vue"), "package.json": package("react"), "front/src/a.ts": ""},
        "unreadable": {"front/package.json": "{", "package.json": package("react"), "front/src/a.ts": ""},
        "null": {"front/package.json": "null", "package.json": package("@angular/core"), "front/src/a.ts": ""},
        "no content": {"front/package.json": None, "front/src/a.ts": ""},
        "dotnet": {"front/src/a.ts": "", "back/A/A.csproj": "", "go.mod": ""},
        "built": {"front/src/a.ts": "", "back/bin/A.csproj": "", "back/x": "", "go.mod": "", "requirements.txt": ""},
        "python": {"front/src/a.ts": "", "back/x": "", "requirements.txt": "", "backend/package.json": package("koa")},
        "node": {"front/src/a.ts": "", "back/x": "", "backend/package.json": "[", "server/package.json": package("@nestjs/core")},
        "first package decides": {"front/src/a.ts": "", "back/x": "", "backend/package.json": "{}", "server/package.json": package("koa")},
        "no backend": {"front/src/a.ts": "", "A.csproj": ""},
    }
    stacks = {k: (r["frontend_framework"], r["backend_stack"]) for k, r in one(found(spark, trees).projects).items()}
    assert stacks == {
        "react first": ("react", None), "beside the root": ("vue", None), "unreadable": ("react", None), "null": ("angular", None), "no content": (None, None), "dotnet": (None, "dotnet"),
        "built": (None, "go"), "python": (None, "python"), "node": (None, "node"), "first package decides": (None, None), "no backend": (None, None),
    }


def test_own_detectors(spark):
    own = detection.Detectors(frontend=(detection.Detector("svelte", ("svelte",)),), backend=(detection.Detector("rust", files=("Cargo.toml",)), detection.Detector("java", suffix=".java")))
    trees = {"a": {"front/src/a.ts": "", "back/x": "", "Cargo.toml": "", "package.json": '{"devDependencies": {"svelte": "5", "react": "18"}}'}, "b": {"front/src/a.ts": "", "back/src/X.java": ""}}
    rows = one(found(spark, trees, detectors=own).projects)
    assert [(rows[k]["frontend_framework"], rows[k]["backend_stack"]) for k in "ab"] == [("svelte", "rust"), (None, "java")]
    with pytest.raises(ValueError, match="stand twice: react"):
        detection.Detectors(frontend=(*detection.FRONTENDS, detection.Detector("react")))
    with pytest.raises(ValueError, match="need an id"):
        detection.Detectors(backend=(detection.Detector(""),))


def test_modules_and_entry_points(spark):
    trees = {
        "features": dict.fromkeys(["src/features/user-list/a.ts", "src/features/x.y/b.ts", "src/features/note.md", "src/pages/home/c.ts", "src/main.ts", "src/App.jsx", "src/routes/index.tsx", "src/routes/AppRoutes.tsx"], ""),
        "plain": dict.fromkeys(["src/shop/a.ts", "src/shop/deep/b.ts", "src/hooks/c.ts", "src/value-objects/d.ts", "src/index.js"], ""),
    }
    detected = found(spark, trees)
    assert {tuple(r) for r in detected.modules.select("repo", "module", "label").collect()} == {("features", "user-list", "User List"), ("features", "x.y", "X.Y"), ("plain", "shop", "Shop")}
    rows = one(detected.projects)
    assert rows["features"]["entry_points"] == ["src/App.jsx", "src/routes/AppRoutes.tsx"] and rows["plain"]["entry_points"] == []
    assert rows["features"]["frontend_feature_pattern"] == "^src/features/([^/]+)" and rows["plain"]["feature_folder_pattern"] == "/features/{module}/"
    assert {r["repo"]: r["module_count"] for r in detection.summary(detected).collect()} == {"features": 2, "plain": 1}


def test_backend_patterns_need_a_project_folder(spark):
    trees = {"with": {"front/src/a": "", "back/Api/Program.cs": ""}, "hidden": {"front/src/a": "", "back/.vs/x": "", "back/node_modules/y": "", "back/Program.cs": ""}}
    rows = one(found(spark, trees).projects)
    assert rows["with"]["backend_entity_pattern"] == "^back/[^/]+/Entities/([^/]+)" and rows["hidden"]["backend_entity_pattern"] is None


def test_aliases(spark):
    text = """// "compilerOptions": 1
    {"compilerOptions": {"paths": { "@/*": ["./src/*"], "b": ["a//b/./c/"], /* "x": ["y"], */ "q*": ["../up/*",], "http://x": ["../../far"], "no": [], "root": ["."], },},}"""
    trees = {"r": {"web/src/a.ts": "", "web/tsconfig.json": text, "tsconfig.json": '{"compilerOptions": {"paths": {"z": ["z"]}}}'}, "app": {"src/a.ts": "", "tsconfig.app.json": text}, "bad": {"src/a": "", "tsconfig.json": "{{"}, "slash": {"src/a": "", "tsconfig.json": '{"compilerOptions": {"paths": {"\\u0040/": ["/abs"], "\\"//": ["."]}}}'}}
    rows = found(spark, trees).aliases.orderBy("repo", "ord").collect()
    assert [(r["prefix"], r["path"]) for r in rows if r["repo"] == "r"] == [("@/", "web/src"), ("b/", "web/a/b/c/"), ("q/", "up"), ("http://x/", "../far"), ("root/", "web")]
    assert [(r["repo"], r["prefix"], r["path"]) for r in rows if r["repo"] != "r"] == [("slash", "@/", "/abs"), ("slash", '"//', ".")]


def test_names(spark):
    trees = {
        "org/my_repo-x": {"src/a": ""},
        "b": {"src/a": "", "front/package.json": '{"name": "@team/shop_front-end"}', "package.json": '{"name": "other"}'},
        "c": {"src/a": "", "front/package.json": "{", "client/package.json": '{"name": "été v2.beta"}'},
    }
    assert {r["repo"]: r["name"] for r in found(spark, trees).projects.collect()} == {"org/my_repo-x": "My Repo X", "b": "Shop Front End", "c": "éTé V2.Beta"}


def test_layers_and_templates(spark):
    react = '{"dependencies": {"react": "1"}}'
    trees = {
        "full": {"front/src/a": "", "back/A.csproj": "", "package.json": react},
        "api": {"front/src/a": "", "back/a": "", "go.mod": "", "package.json": react},
        "ui": {"front/src/a": "", "package.json": react},
        "unknown backend": {"front/src/a": "", "back/a": "", "package.json": react},
        "fallback": {"front/src/a": "", "back/A.csproj": ""},
        "python": {"front/src/a": "", "back/a": "", "requirements.txt": "", "package.json": react},
    }
    rows = one(found(spark, trees).projects)
    assert {k: (len(r["layers"]), r["layers"][-1]["label"], len(r["templates"])) for k, r in rows.items()} == {
        "full": (14, "DB Tables", 14), "api": (8, "Controllers", 8), "ui": (6, "Repositories", 8), "unknown backend": (6, "Repositories", 8), "fallback": (5, "API Endpoints", 11), "python": (5, "API Endpoints", 8),
    }


def test_nulls_repeats_and_empty(spark):
    schema = "repo string, path string, content string, home string, present string, package int"
    rows = [("r", "src/features/a/x.ts", "", "h", "p", 1)] * 3 + [(None, "src/x", "", None, None, None), ("r", None, "", None, None, None), ("r", "package.json", '{"name": "b"}', "", "", 0), ("r", "package.json", '{"name": "a"}', "", "", 0), ("r", "", "", "", "", 0)]
    detected = detection.detect(spark.createDataFrame(rows, schema))
    assert [(r["repo"], r["name"], r["frontend_root"]) for r in detected.projects.collect()] == [("r", "A", "src")]
    assert detected.modules.count() == 1
    empty = detection.detect(spark.createDataFrame([], schema))
    assert [d.count() for d in (empty.projects, empty.modules, empty.aliases, detection.summary(empty))] == [0, 0, 0, 0]


def test_files_are_read_without_functions_on_arrays_and_odd_paths_count_as_before(spark):
    paths = ["front//src/a.ts", "front/src//x.ts", "/front/src/m/b.ts", "front/src/features/", "front/src/features/a/", "back/*", "src", "src/x", "src/x/y/z", "", "back/*/x", "api/.b/c", "api/n/", "server/node_modules/y", "app/src/pages/p/q/r.ts", "deep/bin/a.csproj"]
    files = spark.createDataFrame([(f"r{i}", p, None) for i, p in enumerate(paths)], "repo string, path string, content string")
    known = detection.Detectors()
    probed, want, below = set(detection._probed(known)), {}, set()
    homes = [h for f, _ in detection.ROOTS for h in (f, *(f"{f}/{x}" for x in detection.FEATURE_FOLDERS))]
    for i, p in enumerate(paths):
        parts = p.split("/")
        want[f"r{i}"] = {"/".join(parts[:k]) for k in range(1, len(parts) + 1)} & probed
        if parts[0] in {b for _, b in detection.ROOTS if b} and len(parts) > 2 and not parts[1].startswith(".") and parts[1] != "node_modules":
            want[f"r{i}"].add(parts[0] + "/*")
        below |= {(f"r{i}", h, parts[h.count("/") + 1]) for h in homes if p.startswith(h + "/") and len(parts) > h.count("/") + 2}
    seen = detection._evidence(files, known)
    assert {r.repo: set(r.present) for r in seen.collect()} == want and all(r.suffixes == [] for r in seen.collect())
    projects = files.select("repo").crossJoin(spark.createDataFrame([(h.rsplit("/", 1)[0], h.rsplit("/", 1)[1]) if h.rsplit("/", 1)[-1] in detection.FEATURE_FOLDERS else (h, None) for h in homes], "frontend_root string, feature_folder string"))
    found = detection._modules(files, projects).select("repo", "module")
    assert sorted(map(tuple, found.collect())) == sorted((r, m) for r, h, m in below if h.rsplit("/", 1)[-1] in detection.FEATURE_FOLDERS or m not in detection.INFRASTRUCTURE)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan(seen) and "transform(" not in plan(seen) and "lambdafunction" not in plan(found)  # these ran for every file
