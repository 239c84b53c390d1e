import json
import random

import pytest

from graphloom.operators import projectmaps, templates


def plain_order(wanted, requires):
    """The order of a depth-first walk, or the first fault as a sentence."""
    done, way = [], []

    def visit(t):
        if t in done:
            return
        if t in way:
            raise ValueError("Template dependency cycle: " + " -> ".join(way[way.index(t) :] + [t]))
        if t not in requires:
            raise ValueError(f"Unknown template: {t}" + (f" required by {way[-1]}" if way else ""))
        way.append(t)
        for n in requires[t]:
            visit(n)
        way.pop()
        done.append(t)

    try:
        for t in wanted:
            visit(t)
    except ValueError as e:
        return str(e)
    return done


def tables(spark, wanted, requires):
    want = [(p, i, t) for p, ts in wanted.items() for i, t in enumerate(ts)]
    needs = [(t, i, n) for t, ns in requires.items() for i, n in enumerate(ns)]
    return (
        spark.createDataFrame(want, "project string, pos int, template string"),
        spark.createDataFrame([(t,) for t in requires], "template string"),
        spark.createDataFrame(needs, "template string, pos int, needs string"),
    )


def result(found):
    got = {r["project"]: r["templates"] for r in templates.lists(found.ordered).collect()}
    faults = {r["project"]: r["message"] for r in found.faults.collect()}
    assert not set(got) & set(faults)
    return got | faults


def test_orders_circles_and_unknown_names(spark):
    requires = {"base": [], "ts": ["base"], "react": ["ts", "ui"], "ui": ["base"], "x": ["y"], "y": ["z"], "z": ["y"], "self": ["self"], "lost": ["ts", "gone"], "both": ["lost", "x"], "late": ["x", "lost"]}
    wanted = {"a": ["react"], "b": ["ui", "react", "base"], "c": ["ts", "x"], "d": ["self"], "e": ["lost"], "f": ["gone"], "g": ["both"], "h": ["late"], "i": ["base", "base"], "j": ["z"]}
    found = templates.expanded(*tables(spark, wanted, requires))
    assert result(found) == {p: plain_order(ts, requires) for p, ts in wanted.items()}


def test_random_catalogues_against_a_plain_walk(spark):
    rng = random.Random(5)
    for density, forward in ((0.3, True), (0.04, False)):
        names = [f"t{i}" for i in range(14)]
        rng.shuffle(names)
        requires = {t: [n for n in rng.sample(names, len(names)) if (names.index(n) > i if forward else n != t) and rng.random() < density] for i, t in enumerate(names)}
        requires[names[-1]] += ["gone"] if not forward else []
        wanted = {f"p{i}": rng.sample(names, rng.randint(1, 5)) for i in range(60)}
        expected = {p: plain_order(ts, requires) for p, ts in wanted.items()}
        if not forward:
            assert 5 < sum(isinstance(v, list) for v in expected.values()) < 55
        assert result(templates.expanded(*tables(spark, wanted, requires))) == expected


def test_nulls_repeats_and_no_rows(spark):
    wanted, known, requires = tables(spark, {"a": ["ts"]}, {"base": [], "ts": ["base"]})
    extra = spark.createDataFrame([("a", 0, "ts"), (None, 1, "ts"), ("a", 1, None), ("b", None, "ts")], "project string, pos int, template string")
    assert result(templates.expanded(wanted.union(extra), known.union(known), requires.union(requires))) == {"a": ["base", "ts"]}
    none = templates.expanded(wanted.limit(0), known, requires)
    assert none.ordered.count() == 0 and none.faults.count() == 0
    assert result(templates.expanded(wanted, known.limit(0), requires)) == {"a": "Unknown template: ts"}


def test_enabled_lists(spark):
    rows = spark.createDataFrame([("a", ["x", "base", "y"]), ("b", []), ("c", None)], "repo string, templates array<string>")
    got = {}
    for r in sorted(templates.enabled(rows).collect(), key=lambda r: r["pos"]):
        got.setdefault(r["project"], []).append(r["template"])
    assert got == {"a": ["base", "x", "y"], "b": ["base", *projectmaps.TEMPLATES], "c": ["base", *projectmaps.TEMPLATES]}


def ordered(spark, *names):
    return spark.createDataFrame([("p", t, [i, templates.LAST]) for i, t in enumerate(names)], "project string, template string, at array<int>")


def test_entries_are_laid_one_on_another(spark):
    parts = spark.createDataFrame(
        [
            ("a", "layers", 0, "ui", "label", "UI"), ("a", "layers", 0, "ui", "order", "1"), ("a", "layers", 1, "api", "label", "API"), ("b", "layers", 0, "db", "label", "DB"), ("b", "layers", 1, "ui", "label", "Screens"),
            ("b", "layers", 2, "api", "label", None), ("z", "layers", 0, "ui", "label", "never"), ("a", "types", 0, "ui", "label", "type"), ("a", None, 0, "ui", "label", "x"), ("b", "layers", 3, "db", "label", "DB2"), ("b", "layers", 3, "db", "label", "DB1"),
        ],
        "template string, section string, pos int, id string, field string, value string",
    )
    own = spark.createDataFrame([("p", "layers", 0, "new", "label", "New"), ("p", "layers", 1, "api", "label", "Mine"), ("q", "layers", 0, "api", "label", "Q")], "project string, section string, pos int, id string, field string, value string")
    found = templates.entries(ordered(spark, "a", "b"), parts, own).collect()
    values = {(r["project"], r["section"], r["id"], r["field"]): r["value"] for r in found}
    assert values == {("p", "layers", "ui", "label"): "Screens", ("p", "layers", "ui", "order"): "1", ("p", "layers", "api", "label"): "Mine", ("p", "layers", "db", "label"): "DB2", ("p", "types", "ui", "label"): "type", ("p", "layers", "new", "label"): "New", ("q", "layers", "api", "label"): "Q"}
    order = sorted({(tuple(r["first"]["at"]), r["first"]["pos"], r["id"]) for r in found if r["project"] == "p" and r["section"] == "layers"})
    assert [o[2] for o in order] == ["ui", "api", "db", "new"]
    without = {(r["id"], r["field"]): r["value"] for r in templates.entries(ordered(spark, "a", "b"), parts).collect() if r["section"] == "layers"}
    assert without[("api", "label")] is None


def plain_merge(left, right):
    out = dict(left)
    for k, v in right.items():
        out[k] = plain_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def leaves(tree, path=()):
    for k, v in tree.items():
        if isinstance(v, dict) and v:
            yield from leaves(v, (*path, k))
        else:
            yield list((*path, k)), json.dumps(v)


def random_tree(rng, depth):
    return {k: random_tree(rng, depth - 1) if depth and rng.random() < 0.6 else rng.choice([1, 2, None, [1], "x"]) for k in "abc" if rng.random() < 0.6}


@pytest.mark.parametrize("seed", range(2))
def test_options_against_a_plain_merge(spark, seed):
    rng = random.Random(seed)
    rows, own, expected, at = [], [], {}, []
    for p in range(40):
        merged = {}
        for i in range(rng.randint(1, 4)):
            tree = random_tree(rng, 3)
            name = f"t{p}.{i}"
            at.append((f"p{p}", name, [i, templates.LAST]))
            rows += [(name, path, value) for path, value in leaves(tree)]
            merged = plain_merge(merged, tree)
        mine = random_tree(rng, 2) if p % 2 else {}
        own += [(f"p{p}", path, value) for path, value in leaves(mine)]
        expected[f"p{p}"] = plain_merge(merged, mine)
    found = templates.options(
        spark.createDataFrame(at, "project string, template string, at array<int>"),
        spark.createDataFrame(rows, "template string, path array<string>, value string"),
        spark.createDataFrame(own, "project string, path array<string>, value string"),
    )
    got = {}
    for r in found.collect():
        spot = got.setdefault(r["project"], {})
        for k in r["path"][:-1]:
            spot = spot.setdefault(k, {})
        assert r["path"][-1] not in spot
        spot[r["path"][-1]] = json.loads(r["value"])
    assert got == {p: t for p, t in expected.items() if t}


def test_rules_count_once(spark):
    parts = spark.createDataFrame([("a", 0, "r1"), ("a", 1, "r2"), ("b", 0, "r2"), ("b", 1, ""), ("b", 2, None), ("b", 3, "r3"), ("z", 0, "r9")], "template string, pos int, rule string")
    got = sorted((r["first"]["at"], r["first"]["pos"], r["rule"]) for r in templates.rules(ordered(spark, "a", "b"), parts).collect())
    assert [g[2] for g in got] == ["r1", "r2", "r3"]


@pytest.mark.parametrize("name", ["template_orders", "template_faults", "effective_layers", "effective_options"])
def test_query(spark, sf_dir, name):
    import __spark_entry__ as entry

    from .test_entry import TABLES, duckdb, rows

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    assert rows(entry.queries()[name](spark, sf_dir).toPandas()) == rows(con.sql(entry.oracle_sql()[name]).df())
