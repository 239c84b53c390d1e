import copy
import json

import pytest

from graphloom.operators import catalogue
from graphloom.plans.documents import submap_uid

LEVELS = ("editable", "readable", "external", "forbidden", "generated")


def document(sid="flow", revision=1, **over):
    doc = {
        "kind": "code-map/submap", "schemaVersion": 1, "id": sid, "revision": revision, "parentUid": None, "createdAt": "2024-05-06T07:08:09.000Z", "source": {"graphDigest": "sha256:" + "0f" * 32, "projectName": "p"},
        "selection": {"resolvedSeedNodeIds": ["a"]}, "access": {"default": "readable", "editable": ["a"], "readable": ["b"], "external": [], "forbidden": [], "generated": []}, "catalog": {}, "metadata": {},
        "nodes": [{"id": "a", "n": 1.0}, {"id": "b"}], "edges": [{"id": "e", "from": "a", "to": "b"}], "findings": [{"id": "f", "nodeId": "a"}, {"id": "g"}], "orphanNodeIds": ["b"],
        "boundaries": [{"edgeId": "x", "insideNodeId": "a", "outsideNode": {"id": "z"}}], "warnings": [],
    } | over
    return fixed(doc)


def fixed(doc):
    """With the statistics and the uid that its content has."""
    size = lambda x: len(x) if isinstance(x, list) else 0
    access = doc["access"] if isinstance(doc["access"], dict) else {}
    doc["statistics"] = {k: size(doc[k]) for k in ("nodes", "edges", "findings", "boundaries")} | {k: size(access.get(k)) for k in LEVELS}
    doc["uid"] = submap_uid(doc) if isinstance(doc["source"], dict) else "?"
    return doc


def table(spark, docs):
    rows = [(name, d if isinstance(d, str) or d is None else json.dumps(d)) for name, d in docs.items()]
    return spark.createDataFrame(rows, "file string, text string")


FAULTS = {
    "kind": ({"kind": "x"}, ["INVALID_KIND"]), "schema": ({"schemaVersion": 2}, ["SCHEMA_INCOMPATIBLE"]), "schema text": ({"schemaVersion": "1"}, ["SCHEMA_INCOMPATIBLE"]), "id": ({"id": " "}, ["INVALID_ID"]),
    "revision": ({"revision": 1.5}, ["INVALID_REVISION"]), "revision 0": ({"revision": 0}, ["INVALID_REVISION"]), "parent": ({"parentUid": "sha256:x"}, ["INVALID_PARENT_UID"]), "created": ({"createdAt": "soon"}, ["INVALID_CREATED_AT"]),
    "records": ({"catalog": [], "metadata": None}, ["CATALOG_MISSING", "METADATA_MISSING"]), "arrays": ({"nodes": {}, "warnings": None}, ["INVALID_NODES", "INVALID_WARNINGS"]), "seeds": ({"selection": {}}, ["INVALID_RESOLVED_SEEDS"]),
    "node id": ({"nodes": [{"id": "a"}, {"id": "b"}, {"id": 5}, 7]}, ["INVALID_NODE_ID"]), "node twice": ({"nodes": [{"id": "a"}, {"id": "b"}, {"id": "b"}]}, ["DUPLICATE_NODE_ID"]),
    "edge id": ({"edges": [{"from": "a", "to": "b"}]}, ["INVALID_EDGE_ID"]), "edge end": ({"edges": [{"id": "e", "from": "a", "to": ""}, {"id": "f", "from": "a", "to": "q"}]}, ["INVALID_EDGE_ENDPOINT", "EDGE_ENDPOINT_MISSING"]),
    "default": ({"access": {"default": "no", "editable": ["a"], "readable": ["b"], "external": [], "forbidden": [], "generated": []}}, ["ACCESS_DEFAULT_INVALID"]),
    "access": ({"access": {"default": "readable", "editable": ["a"], "readable": ["a", "q"], "external": [], "forbidden": []}}, ["ACCESS_NODE_MISSING", "ACCESS_CONFLICT", "ACCESS_INVALID", "ACCESS_UNCLASSIFIED"]),
    "finding": ({"findings": ["x", {"nodeId": "q"}]}, ["INVALID_FINDING", "FINDING_NODE_MISSING"]), "orphan": ({"orphanNodeIds": [1, "q"]}, ["INVALID_ORPHAN_NODE_ID", "ORPHAN_NODE_MISSING"]),
    "boundary": ({"boundaries": [{"edgeId": "x"}, {"edgeId": "e", "insideNodeId": "q", "outsideNode": {"id": "b"}}]}, ["INVALID_BOUNDARY", "BOUNDARY_NODE_MISSING", "BOUNDARY_EDGE_INCLUDED", "BOUNDARY_OUTSIDE_INCLUDED"]),
    "seed": ({"selection": {"resolvedSeedNodeIds": ["a", "q"]}}, ["SEED_NODE_MISSING"]), "digest": ({"source": {"graphDigest": "x"}}, ["SOURCE_DIGEST_MISSING"]),
}


def test_each_fault_is_named(spark):
    docs = {name: document(**copy.deepcopy(over)) for name, (over, _) in FAULTS.items()}
    docs |= {"sound": document(), "statistics": document() | {"statistics": {}}, "uid": document() | {"uid": "sha256:" + "0" * 64}, "json": "{", "null": None, "empty": "", "list": "[1]", "number": "1"}
    expected = {name: codes for name, (_, codes) in FAULTS.items()} | {"sound": [], "statistics": ["STATISTICS_MISMATCH"], "uid": ["UID_MISMATCH"], "json": ["INVALID_JSON"], "null": ["INVALID_JSON"], "empty": ["INVALID_JSON"], "list": ["INVALID_DOCUMENT"], "number": ["INVALID_DOCUMENT"]}
    got = {r["file"]: [c.removeprefix("SUBMAP_") for c in r["issues"]] for r in catalogue.judged(table(spark, docs)).collect()}
    assert got == expected


def test_order_and_columns(spark):
    named = lambda name, r: document(sid=name or "none", revision=r, metadata={"name": name, "kind": "trace"} if name else {})
    rows = catalogue.catalogue(table(spark, {"1": named("b", 1), "2": named("B", 3), "3": named("a", 2), "4": named("b", 10), "5": "{", "6": named(None, 1)})).collect()
    assert [(r["name"], r["revision"]) for r in rows] == [("5", None), ("a", 2), ("b", 10), ("b", 1), ("B", 3), ("none", 1)]
    assert rows[0]["id"] == "invalid:5" and rows[0]["uid"] is None and (rows[1]["kind"], rows[-1]["kind"]) == ("trace", "selection") and (rows[1]["n_nodes"], rows[1]["n_edges"], rows[1]["project"]) == (2, 1, "p")


def put(folder, **docs):
    folder.mkdir(exist_ok=True)
    for name, d in docs.items():
        (folder / f"{name}.submap.json").write_text(d if isinstance(d, str) else json.dumps(d))


def files(spark, place):
    return sorted(r["file"].removesuffix(".submap.json") for r in catalogue.texts(spark, place).collect())


def test_all_revisions_go_at_once_and_come_back(spark, tmp_path, monkeypatch):
    folder, place = tmp_path / "maps", f"file://{tmp_path}/maps"
    assert files(spark, place) == []
    first, second = document(revision=1), document(revision=2)
    put(folder, a=first, b=second, c=document(sid="other"), d='{"id": "flow"', e=second)
    (folder / "note.json").write_text("{}")
    assert files(spark, place) == list("abcde")
    assert [r["file"] for r in catalogue.by_uid(catalogue.texts(spark, place), second["uid"]).collect()] == ["b.submap.json"]
    with pytest.raises(ValueError):
        catalogue.by_uid(catalogue.texts(spark, place), "sha256:1")
    with pytest.raises(LookupError):
        catalogue.remove(spark, place, "sha256:" + "1" * 64)

    def broken(*_):
        raise OSError("lost")

    with monkeypatch.context() as m, pytest.raises(OSError, match="lost"):
        m.setattr(catalogue, "_moved", broken)  # the driver dies after the table, before the rename
        catalogue.remove(spark, place, first["uid"])
    assert files(spark, place) == list("abcde")
    gone = catalogue.remove(spark, place, first["uid"])
    assert (gone.id, gone.deleted) == ("flow", 3) and files(spark, place) == ["c", "d"]
    with pytest.raises(LookupError):
        catalogue.remove(spark, place, second["uid"])
    catalogue.restore(spark, place, gone.version)
    assert files(spark, place) == list("abcde")
    with pytest.raises(LookupError):
        catalogue.restore(spark, place, gone.version)
    again = catalogue.remove(spark, place, second["uid"])
    assert catalogue.purge(spark, place) == 3 and sorted(p.name[0] for p in folder.glob("*.submap.json")) == ["c", "d"]
    with pytest.raises(LookupError):
        catalogue.restore(spark, place, again.version)
    assert catalogue.purge(spark, place) == 0 and files(spark, place) == ["c", "d"]


def test_clashing_columns_repeats_and_empty(spark):
    rows = [("x", json.dumps(document()), "t", 1)] * 2 + [(None, None, None, None)]
    odd = catalogue.judged(spark.createDataFrame(rows, "file string, text string, tree string, issues int"))
    assert sorted((r["file"], r["status"]) for r in odd.collect()) == [("", "invalid"), ("x", "valid"), ("x", "valid")]
    assert catalogue.catalogue(spark.createDataFrame([], "file string, text string")).count() == 0


def test_catalogue_judges_each_text_once_and_in_several_parts(spark):
    from pyspark.sql import functions as F

    read = spark.sparkContext.accumulator(0)

    def seen(n):
        read.add(1)
        return "{}"

    texts = spark.range(0, 2_500, 1, 1).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("file"), F.udf(seen, "string")("id").alias("text"))
    assert catalogue.catalogue(texts).count() == 2_500
    assert len(catalogue.catalogue(texts).collect()) == 2_500
    assert read.value == 5_000
