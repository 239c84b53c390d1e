import pytest

from graphloom.operators import findings

SCHEMA = "id string, rule_id string, severity string, node_id string, path string, line int, suppressed boolean"
ROWS = [
    ("1", "b", "warning", "n1", "p", 2, False), ("2", "a", "error", "n1", "z", 9, None), ("3", "a", "warning", "n1", "p", None, True), ("4", "c", "info", "n2", None, 1, False),
    ("5", "a", "error", None, "p", 1, False), ("6", "a", "error", "gone", "p", 1, False), ("7", "a", "warning", "n1", None, 5, False), ("7", "a", "warning", "n1", None, 5, False),
]


def tables(spark):
    nodes = [("n1", "m", "x"), ("n2", "k", "x"), ("n3", None, "x")]
    return spark.createDataFrame(nodes, "id string, module string, worst string"), spark.createDataFrame(ROWS, SCHEMA)


def ids(df):
    return [r["id"] for r in df.collect()]


def test_views(spark):
    _, found = tables(spark)
    assert ids(findings.view(found)) == ["5", "6", "2", "7", "7", "3", "1", "4"]
    assert ids(findings.view(found, "active")) == ["5", "6", "2", "7", "7", "1", "4"] and ids(findings.view(found, "suppressed")) == ["3"]
    with pytest.raises(ValueError):
        findings.view(found, "some")


def test_on_each_node(spark):
    nodes, found = tables(spark)
    got = {r["id"]: tuple(r)[1:] for r in findings.attached(nodes, found).collect()}
    assert got == {"n1": ("m", 5, 1, 4, "error", ["a", "b"], "2"), "n2": ("k", 1, 0, 0, "info", ["c"], "4"), "n3": (None, 0, 0, 0, None, [], None)}
    assert sorted(ids(findings.on_nodes(nodes.union(nodes), found))) == ["1", "2", "3", "4", "7", "7"]
    assert findings.attached(nodes, found.limit(0)).count() == 3 and findings.attached(nodes.limit(0), found).count() == 0


def test_filters(spark):
    nodes, found = tables(spark)
    assert sorted(ids(findings.filtered(found, nodes.union(nodes), "warning", "a", "m"))) == ["3", "7", "7"]
    assert sorted(ids(findings.filtered(found, severity="error"))) == ["2", "5", "6"] and len(ids(findings.filtered(found))) == 8
    with pytest.raises(ValueError):
        findings.filtered(found, module="m")
