import json

import pytest

from graphloom.operators import projectmaps
from graphloom.plans import scan

SOUND = {"schemaVersion": 1, "project": {"name": "Shop"}, "sourceRoots": {"frontend": "web"}}


def table(spark, docs):
    rows = [(name, d if isinstance(d, str) or d is None else json.dumps(d)) for name, d in docs.items()]
    return spark.createDataFrame(rows, "repo string, text string")


FAULTS = {
    "sound": ({}, []),
    "version": ({"schemaVersion": "1"}, ["schemaVersion must be an integer."]),
    "version half": ({"schemaVersion": 1.5}, ["schemaVersion must be an integer."]),
    "version 2": ({"schemaVersion": 2}, ["Only project map schema version 1 is supported."]),
    "schema": ({"$schema": None}, ["$schema must be a string."]),
    "project": ({"project": []}, ["project must be an object.", "project.name is required."]),
    "no name": ({"project": {"name": ""}}, ["project.name is required."]),
    "name 0": ({"project": {"name": 0}}, ["project.name is required."]),
    "name false": ({"project": {"name": False}}, ["project.name is required."]),
    "name number": ({"project": {"name": 7}}, ["project.name must be a non-empty string."]),
    "name blank": ({"project": {"name": " " + "".join(map(chr, (9, 0xA0, 0x3000, 0xFEFF)))}}, ["project.name must be a non-empty string."]),
    "outputs": ({"project": {"name": "n", "graphOutput": None, "runtimeLinks": " ", "submapsDirectory": 1}}, [f"project.{n} must be a non-empty string." for n in ("graphOutput", "runtimeLinks", "submapsDirectory")]),
    "roots": ({"sourceRoots": {"backend": "", "z": 1, "a": 2}}, ["sourceRoots.frontend is required.", "sourceRoots.backend must be a non-empty string.", "sourceRoots contains unknown properties: a, z."]),
    "roots null": ({"sourceRoots": None}, ["sourceRoots must be an object.", "sourceRoots.frontend is required."]),
    "templates": ({"templates": []}, ["templates must be an object."]),
    "templates within": ({"templates": {"enabled": ["a", " "], "plugins": "x"}}, ["templates.enabled must contain only non-empty strings.", "templates.plugins must be an array."]),
    "ignored": ({"ignoredDirs": ["", 1]}, ["ignoredDirs must contain only strings."]),
    "ignored blank": ({"ignoredDirs": [""]}, []),
    "imports": ({"imports": "x"}, ["imports must be an object."]),
    "aliases": ({"imports": {"aliases": {}}}, ["imports.aliases must be an array."]),
    "alias": (
        {"imports": {"aliases": [{"prefix": "@", "path": "p"}, 3, {"prefix": "", "y": 1, "x": 2}]}},
        ["imports.aliases[1] must be an object.", "imports.aliases[2].prefix must be a non-empty string.", "imports.aliases[2].path must be a non-empty string.", "imports.aliases[2] contains unknown properties: x, y."],
    ),
    "layers": ({"layers": []}, ["layers must contain at least one layer when provided."]),
    "layers object": ({"layers": {"a": 1}}, ["layers must contain at least one layer when provided."]),
    "layer": ({"layers": [None, {"id": "a"}]}, ["layers[0] must be an object.", "layers[1].label must be a non-empty string."]),
    "rules": (
        {"rules": {"enabled": [1], "options": [], "suppressions": [{"reason": "r", "expiresOn": "2030-01-01"}, {"ruleId": 5, "pathPattern": None}]}},
        ["rules.enabled must contain only strings.", "rules.options must be an object.", "rules.suppressions[1].reason must be a non-empty string.", "rules.suppressions[1].ruleId must be a string.", "rules.suppressions[1].pathPattern must be a string."],
    ),
    "rest": ({"modules": 1, "types": None, "frontend": [], "backend": "b"}, [f"{n} must be an object." for n in ("modules", "types", "frontend", "backend")]),
    "order": ({"schemaVersion": 3, "rules": [], "ignoredDirs": 1}, ["Only project map schema version 1 is supported.", "ignoredDirs must be an array.", "rules must be an object."]),
}


def test_each_fault_is_said_in_order(spark):
    docs = {name: SOUND | over for name, (over, _) in FAULTS.items()}
    docs |= {"json": "{", "null": None, "empty": "", "list": "[1]", "number": "1", "null text": "null", "twice": '{"a": 1, "a": 2}'}
    unreadable, other = ["Project map is no readable JSON."], ["Project map must be a JSON object."]
    expected = {name: faults for name, (_, faults) in FAULTS.items()} | {"json": unreadable, "null": unreadable, "empty": unreadable, "twice": unreadable, "list": other, "number": other, "null text": other}
    got = {r["repo"]: r["issues"] for r in projectmaps.judged(table(spark, docs)).collect()}
    assert got == expected


def test_repeats_nulls_other_columns_and_no_rows(spark):
    rows = spark.createDataFrame([(None, json.dumps(SOUND), 1), (None, json.dumps(SOUND), 1), ("r", None, 2)], "repo string, text string, tree int")
    assert sorted((str(r["repo"]), len(r["issues"])) for r in projectmaps.judged(rows).collect()) == [("None", 0), ("None", 0), ("r", 1)]
    assert projectmaps.judged(rows.limit(0)).count() == 0 and projectmaps.normalized(rows.limit(0)).count() == 0
    assert projectmaps.normalized(rows).count() == 2


def test_long_map(spark):
    many = SOUND | {"layers": [{"id": f"l{i}", "label": "x" if i != 19_999 else ""} for i in range(20_000)]}
    assert projectmaps.judged(table(spark, {"long": many})).first()["issues"] == ["layers[19999].label must be a non-empty string."]


def test_defaults(spark):
    row = projectmaps.normalized(table(spark, {"r": SOUND, "bad": SOUND | {"schemaVersion": 9}})).collect()
    assert len(row) == 1
    row = row[0].asDict(recursive=True)
    assert (row["repo"], row["name"], row["graph_output"], row["submaps_directory"], row["runtime_links"]) == ("r", "Shop", ".code-map/graph.json", ".code-map/submaps", None)
    assert (row["frontend_root"], row["backend_root"], row["shared_module"], row["feature_folder_pattern"]) == ("web", None, "shared", "/features/{module}/")
    assert row["templates"][:2] == ["filesystem", "typescript"] and len(row["templates"]) == 14 and row["plugins"] == [] and row["aliases"] == [] and row["layers"] == []
    assert row["ignored_dirs"][0] == "node_modules" and "tests" in row["infrastructure_folders"] and row["module_labels"] == {} and row["rules_options"] == "{}" and row["suppressions"] == []
    assert row["front_classifiers"][8] == {"contains": "/schemas/", "type": "config", "layer": "config"} and row["back_classifiers"][-1]["contains"] == "/Entities/"
    assert row["back_fragments"]["mappingPathFragment"] == "/Mappings/" and row["entry_suffixes"] == ["/Program.cs"] and row["entry_points"] == [] and len(row["coverable_types"]) == 8


def test_what_a_map_says_counts(spark):
    said = SOUND | {
        "project": {"name": "N", "graphOutput": "g.json", "runtimeLinks": "l.json"}, "sourceRoots": {"frontend": "web", "backend": "api"}, "ignoredDirs": [], "templates": {"plugins": ["p"], "enabled": ["react"]},
        "imports": {"aliases": [{"prefix": "@/", "path": "web"}]}, "layers": [{"id": "a", "label": "A", "more": 1}], "modules": {"shared": "core", "labels": {"x": "X"}, "utilityControllers": 7}, "types": {"labels": {"page": "Seite"}},
        "frontend": {"classifiers": [{"contains": "/x/", "type": "t", "layer": "l"}], "entryPoints": ["web/main.ts"], "featureFolderPattern": "/m/{module}/"}, "backend": {"entryPointSuffixes": ["/Start.cs"], "dtoPathFragment": "/D/"},
        "rules": {"enabled": ["r1", ""], "options": {"a": {"b": 1}}, "suppressions": [{"reason": "why", "ruleId": "r1"}]}, "unknown": {"kept": "out"},
    }
    row = projectmaps.normalized(table(spark, {"r": said})).first().asDict(recursive=True)
    assert (row["graph_output"], row["runtime_links"], row["backend_root"], row["templates"], row["plugins"], row["ignored_dirs"]) == ("g.json", "l.json", "api", ["react"], ["p"], [])
    assert row["aliases"] == [{"prefix": "@/", "path": "web"}] and row["layers"] == [{"id": "a", "label": "A"}] and row["shared_module"] == "core" and row["module_labels"] == {"x": "X"} and row["utility_controllers"] is None
    assert row["type_labels"] == {"page": "Seite"} and row["type_colors"] == {} and row["front_classifiers"] == [{"contains": "/x/", "type": "t", "layer": "l"}] and row["bootstrap_stems"][0] == "program"
    assert row["back_fragments"]["dtoPathFragment"] == "/D/" and row["back_fragments"]["entityPathFragment"] == "/Entities/" and json.loads(row["rules_options"]) == {"a": {"b": 1}}
    assert row["rules_enabled"] == ["r1", ""] and row["suppressions"] == [{"ruleId": "r1", "pathPattern": None, "reason": "why", "expiresOn": None}]


def test_which_file_is_the_map(spark):
    rows = [
        ("a", "project-map.json", "1"), ("a", "a.project-map.json", "2"), ("a", ".code-map/project-map.json", "3"),
        ("b", "z.project-map.json", "z"), ("b", "b.project-map.json", "b"), ("b", "b.project-map.json", "c"), ("b", ".code-map/project-map.json", "3"),
        ("c", ".code-map/x.project-map.json", "x"), ("c", "deep/project-map.json", "n"), ("c", ".code-map/deep/project-map.json", "n"), ("d", "map.json", "n"), (None, "project-map.json", "n"), ("e", None, "n"), ("f", "project-map.json", None),
    ]
    got = projectmaps.chosen(spark.createDataFrame(rows, "repo string, path string, content string"))
    assert {r["repo"]: (r["path"], r["text"]) for r in got.collect()} == {"a": ("project-map.json", "1"), "b": ("b.project-map.json", "b"), "c": (".code-map/x.project-map.json", "x"), "f": ("project-map.json", None)}


@pytest.mark.parametrize("name", ["project_map_issues", "project_map_defaults"])
def test_query(spark, sf_dir, name):
    import __spark_entry__ as entry

    from .test_entry import TABLES, duckdb, rows

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    assert rows(entry.queries()[name](spark, sf_dir).toPandas()) == rows(con.sql(entry.oracle_sql()[name]).df())


def test_a_scan_by_a_map(spark, tmp_path):
    (tmp_path / "web/m/cart/pages").mkdir(parents=True)
    (tmp_path / "web/main.ts").write_text("import { a } from '@/m/cart/pages/a'\n")
    (tmp_path / "web/m/cart/pages/a.ts").write_text("export const a: any = 1\n")
    said = SOUND | {"imports": {"aliases": [{"prefix": "@/", "path": "web"}]}, "frontend": {"entryPoints": ["web/main.ts"], "featureFolderPattern": "/m/{module}/"}, "rules": {"suppressions": [{"reason": "old", "pathPattern": "web/m/**"}]}}
    project = scan.project_of(projectmaps.normalized(table(spark, {"r": said})).first())
    graph = scan.scan_graph(spark, str(tmp_path), project)
    assert [(r["from_id"], r["to_id"]) for r in graph.edges.filter("type = 'imports'").select(*(c.alias(n) for c, n in zip(_ends(graph.edges), ("from_id", "to_id"), strict=True))).collect()] == [("file:web/main.ts", "file:web/m/cart/pages/a.ts")]
    assert {r["reason"] for r in graph.findings.collect()} == {"old"}
    assert "file:web/main.ts" not in {r["id"] for r in graph.orphans.collect()}


def _ends(edges):
    return edges["src"], edges["dst"]
