"""Literal fixtures: small graphs with known answers."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as fx
from graphloom.operators import layout, measure, merge, rules, trace, traverse
from graphloom.operators.traverse import Request, SelectionConflict, Selector, Traversal

#: Two towns with a ring road each and one ferry between them; an islet on its own.
KINDS = {"gate": ("gate", "edge"), "square": ("square", "core"), "mill": ("mill", "edge")}
PLACES = [(f"{town}{i}", f"{town.title()} {kind} {i}", *KINDS[kind], town, f"{town}/{kind}s/{i}.map") for town in ("north", "south") for i, kind in enumerate(("gate", "square", "square", "mill"))] + [("islet", "Islet", "gate", "edge", "sea", None)]
ROADS = [(f"{town}{i}", "road", f"{town}{(i + 1) % 4}") for town in ("north", "south") for i in range(4)] + [("north2", "ferry", "south0"), ("south3", "path", "south1"), ("islet", "path", "islet2")]


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame(PLACES, "id string, label string, type string, layer string, module string, path string").cache()
    edges = spark.createDataFrame([(f"{s}::{t}::{d}", s, d, t, "high") for s, t, d in ROADS], "id string, src string, dst string, type string, confidence string").cache()
    return nodes, edges


def ids(df):
    return sorted(r.id for r in df.collect())


def plain_reach(seeds, direction, depth, types=(), excluded=(), blocked=()):
    """Breadth first, one node at a time."""
    seen, now = {s: 0 for s in seeds}, list(seeds)
    for d in range(1, depth + 1):
        after = []
        for x in now:
            for s, t, e in ROADS:
                for here, there, way in ((s, e, "outgoing"), (e, s, "incoming")):
                    if here == x and x not in blocked and direction in (way, "both") and (not types or t in types) and there not in excluded and there not in seen and any(there == p[0] for p in PLACES):
                        seen[there] = d
                        after.append(there)
        now = after
    return sorted(seen)


@pytest.mark.parametrize(
    ("seeds", "traversal", "more"),
    [
        (("north0",), Traversal("outgoing", 2), {}), (("south1",), Traversal("incoming", 3), {}), (("north0", "south3"), Traversal("both", 1), {}), (("north1",), Traversal("both", 9), {}), (("islet",), Traversal("both", 4), {}),
        (("north0",), Traversal("outgoing", 9, ("road",)), {}), (("north0",), Traversal("outgoing", 9, (), ("road",)), {"types": ("ferry", "path")}), (("north0",), Traversal("outgoing", 9), {"excluded": ("south1",)}),
        (("north0",), Traversal("outgoing", 9), {"blocked": ("south0",)}), (("south0",), Traversal("both", 0), {}),
    ],
)
def test_reach_against_a_plain_search(graph, seeds, traversal, more):
    want = plain_reach(seeds, traversal.direction, traversal.max_depth, **{"types": traversal.edge_types, **more})
    request = Request(Selector(seeds), Selector(more.get("excluded", ())), traversal, {"forbidden": Selector(more["blocked"])} if "blocked" in more else {})
    got = traverse.create(*graph, request)
    assert ids(got.nodes) == want
    inside = set(want)
    types = more.get("types") or traversal.edge_types
    usable = [(s, t, d) for s, t, d in ROADS if not types or t in types]
    assert ids(got.edges) == sorted(f"{s}::{t}::{d}" for s, t, d in usable if s in inside and d in inside)
    known = {p[0] for p in PLACES}
    crossing = {(f"{s}::{t}::{d}", "outgoing" if s in inside else "incoming", "excluded" if (d if s in inside else s) in more.get("excluded", ()) else "depth-limit") for s, t, d in usable if (s in inside) != (d in inside) and {s, d} <= known}
    assert {(r.edge_id, r.direction, r.reason) for r in got.boundaries.collect()} == crossing


def test_selectors(graph):
    nodes, _ = graph
    pick = lambda **kw: ids(Selector(**kw).ids(nodes))
    assert pick(paths=("north/**",)) == ["north0", "north1", "north2", "north3"] and pick(paths=("*/squares/?.map",)) == ["north1", "north2", "south1", "south2"]
    assert pick(modules=("south",), layers=("edge",), types=("mill",)) == ["south3"] and pick(modules=("sea",), types=("mill",)) == []
    assert pick(node_ids=("islet",), paths=("south/gates/*",), types=("mill",)) == ["islet", "north3", "south0", "south3"] and pick() == []


def test_access_and_changes(graph):
    rules_ = {"editable": Selector(types=("square",)), "generated": Selector(modules=("south",)), "external": Selector(("north0",))}
    near = traverse.create(*graph, Request(Selector(("north1",)), traversal=Traversal("outgoing", 1), access=rules_))
    far = traverse.create(*graph, Request(Selector(("north1",)), traversal=Traversal("outgoing", 3), access=rules_, default_access="external"))
    assert {(r.id, r.level) for r in far.access.collect()} == {("north1", "editable"), ("north2", "editable"), ("north3", "external"), ("south0", "generated"), ("north0", "external"), ("south1", "generated")}
    assert {(r.change, r.id) for r in traverse.changes(near.nodes, far.nodes).collect()} == {("added", "north3"), ("added", "south0"), ("added", "north0"), ("added", "south1")}
    assert {(r.change, r.id) for r in traverse.changes(far.edges, near.edges).collect()} == {("removed", e) for e in set(ids(far.edges)) - set(ids(near.edges))}
    assert {(r.id, r.previous, r.current) for r in traverse.access_changes(far.access, near.access).filter("id in ('north1', 'south1')").collect()} == {("south1", "generated", None)}


def test_conflicts(graph):
    with pytest.raises(SelectionConflict):
        traverse.create(*graph, Request(Selector(("south2",)), access={"editable": Selector(modules=("south",)), "forbidden": Selector(types=("square",))}))
    with pytest.raises(SelectionConflict):
        traverse.create(*graph, Request(Selector(modules=("north",)), Selector(("north3",))))
    for wrong in ({"direction": "sideways"}, {"max_depth": -1}):
        with pytest.raises(ValueError):
            Traversal(**wrong)


@pytest.mark.parametrize(
    ("pattern", "value", "hit"),
    [
        ("src/**/x.ts", "src/x.ts", True), ("src/**/x.ts", "src/a/b/x.ts", True), ("src/*.ts", "src/a.ts", True), ("src/*.ts", "src/a/b.ts", False), ("src/?.ts", "src/a.ts", True), ("src/?.ts", "src/ab.ts", False),
        ("src/a.ts", "src/axts", False), ("src\\a.ts", "src/a.ts", True), ("src/**", "src/a/b", True), ("a+(b)", "a+(b)", True), ("src/a.ts", "src/a.ts\n", False),
    ],
)
def test_submap_globs(spark, pattern, value, hit):
    assert spark.range(1).select(F.lit(value).rlike(fx.submap_glob(pattern))).first()[0] is hit


def test_suppressions(spark):
    df = spark.createDataFrame([("a", "r1", "error", "src/legacy/a.ts", 3), ("b", "r2", "warning", "src/b.ts", 1), ("c", "r1", "error", None, 1), ("d", "r3", "error", "lib/d.ts", 1)], "id string, rule_id string, severity string, path string, line int")
    rows = [{"rule": "r2"}, {"rule": "r1", "path": "src/legacy/", "reason": "literal"}, {"path": "src/**", "reason": "tree", "expires": "2030-01-01"}, {"rule": "r3", "reason": "everywhere"}]
    got = {r.id: (r.suppressed, r.reason, r.suppression_rule, r.suppression_path, r.expires) for r in rules.suppressed(df, rows).collect()}
    assert got == {"a": (True, "tree", None, "src/**", "2030-01-01"), "b": (True, "tree", None, "src/**", "2030-01-01"), "c": (False, None, None, None, None), "d": (True, "everywhere", "r3", None, None)}
    assert {r.id for r in rules.suppressed(df, rows, today="2031-01-01").filter("suppressed").collect()} == {"d"}
    assert rules.suppressed(df, []).filter("suppressed").count() == 0
    assert [r.id for r in df.orderBy(*rules.finding_order()).collect()] == ["c", "d", "a", "b"]
    numbered = rules.numbered(df.withColumn("node_id", F.col("id")).withColumn("evidence", F.lit("x")).drop("id"))
    assert sorted(r.id for r in numbered.collect()) == ["r1:a:3:1", "r1:c:1:0", "r2:b:1:2", "r3:d:1:3"]


@pytest.mark.parametrize(
    ("file", "specifier", "target"),
    [
        ("a/b/c.ts", "./d", "a/b/d.ts"), ("a/b/c.ts", "../d", "a/d.tsx"), ("a/b/c.ts", "../../d", "d/index.ts"), ("a/b/c.ts", "./../b/./d", "a/b/d.ts"), ("top.ts", "./d", "d/index.ts"), ("a/b/c.ts", "./d.ts", "a/b/d.ts"), ("a/b/c.ts", "./d.js", None),
        ("a/b/c.ts", "@x/d", "a/d.tsx"), ("a/b/c.ts", "x/d", None), ("a/b/c.ts", "lodash", None), ("a/b/c.ts", None, None), (None, "./d", None), ("a/b/c.ts", "../../../../d", "d/index.ts"), ("a/b/c.ts", "..", None),
    ],
)
def test_imports(spark, file, specifier, target):
    files = spark.createDataFrame([("a/b/d.ts",), ("a/b/d.tsx",), ("a/d.tsx",), ("d/index.ts",)], "path string")
    got = rules.resolve_imports(spark.createDataFrame([(file, specifier)], "file string, specifier string"), files, [("@x/", "a/"), ("x/", "a/")], [".ts", ".tsx", "/index.ts", "/index.tsx"])
    assert [r.target for r in got.collect()] == ([target] if target else [])


def test_runtime_links(spark):
    nodes = spark.createDataFrame([("file:a/b.ts", "a/b.ts"), ("table:t", None)], "id string, path string")
    links = spark.createDataFrame([("a\\b.ts", "table:t", None), ("file:a/b.ts", "table:t", "reads"), ("a/b.ts", "file:a/b.ts", None), ("gone", "table:t", None)], "`from` string, `to` string, type string").withColumn("confidence", F.lit(None).cast("string"))
    assert ids(rules.runtime_links(links, nodes)) == ["file:a/b.ts::reads::table:t", "file:a/b.ts::runtime-link::table:t"]


def test_upserts_and_first_edges(spark):
    writes = spark.createDataFrame([("a", "old", None, 1), ("a", "A", "service", 2), ("a", None, None, 3), ("b", None, None, 4)], "id string, label string, type string, seq int")
    assert {tuple(r) for r in merge.upsert_nodes(writes, ["label", "type"]).collect()} == {("a", "A", "service"), ("b", "b", "unknown")}
    e = spark.createDataFrame([("a", "b", "t", "first", 1), ("a", "b", "t", "second", 2), ("a", "a", "t", "self", 3), ("a", "", "t", "empty", 4), ("a", "x", "t", "dangling", 5)], "src string, dst string, type string, evidence string, seq int")
    first = merge.first_edges(e)
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    assert [(r.id, r.evidence) for r in merge.admitted_edges(first, nodes).collect()] == [("a::t::b", "first")]
    assert [(r.end, r.missing) for r in merge.dangling_edges(first, nodes).collect()] == [("to", "x")]


def test_validation_lists_everything(spark):
    n = spark.createDataFrame([("a", "", "t", "l", "m"), ("a", "x", None, "l", "m")], "id string, label string, type string, layer string, module string")
    e = spark.createDataFrame([("bad", "a", "gone", "t"), ("a::t::a", "a", "a", "t")], "id string, src string, dst string, type string")
    assert {tuple(r) for r in merge.validation_issues(n, e).collect()} == {("NODE_LABEL_EMPTY", "a"), ("NODE_TYPE_EMPTY", "a"), ("NODE_DUPLICATE", "a"), ("EDGE_SELF", "a::t::a"), ("EDGE_ID", "bad"), ("EDGE_ENDPOINT_MISSING", "gone")}


def test_quality_of_an_isolated_component(spark):
    n = spark.createDataFrame([("c", "C", "component", "ui", "login", "src/x.tsx"), ("t", "T", "table", "db", "db", None)], "id string, label string, type string, layer string, module string, path string")
    e = spark.createDataFrame([], "id string, src string, dst string, type string")
    s = measure.quality_scores(measure.quality_evidence(n, e, "src/features/{module}/", [], []))
    assert [tuple(r) for r in s.collect()] == [("c", 5, 10, 7)]
    assert ids(measure.orphans(n, e, [], [])) == ["c"]
    kids = spark.createDataFrame([("p", "k1", "Low"), ("p", "k2", "High")], "parent string, child string, label string")
    scores = spark.createDataFrame([("k1", 4), ("k2", 6)], "id string, score int")
    assert [tuple(r) for r in measure.internal_rollup(scores, kids).collect()] == [("p", 5, 2, "Low 4/10", "Low,High")]


def test_cheapest_way(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "d", 5.0), ("a", "c", 2.0), ("c", "d", 1.0), ("d", "a", 1.0)], "src string, dst string, weight double")
    best = trace.cheapest(e, spark.createDataFrame([("a",)], "id string"))
    assert {r.id: r.cost for r in best.collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert trace.path_to(best, "d") == ["a", "c", "d"] and trace.path_to(best, "z") == []


def test_cheapest_way_of_many_edges(spark):
    names = [f"n{i:02}" for i in range(36)]
    # A dear shortcut to the end, and a cheap way of 35 edges.
    e = spark.createDataFrame([*((a, b, 1.0) for a, b in zip(names, names[1:])), (names[0], names[-1], 100.0)], "src string, dst string, weight double")
    best = trace.cheapest(e, spark.createDataFrame([(names[0],)], "id string"))
    assert {r.id: r.cost for r in best.collect()} == {x: float(i) for i, x in enumerate(names)}
    assert trace.path_to(best, names[-1]) == names


def test_trace_policy(spark):
    n = spark.createDataFrame([("h", "handler", "x"), ("r", "repository", "x"), ("t", "table", "x"), ("c", "controller", "x"), ("d", "data-context", "x"), ("e", "entity", "x"), ("s", "service", "x")], "id string, type string, layer string")
    e = [("1", "h", "t", "queries-table", "high"), ("2", "h", "r", "depends-on", "high"), ("3", "r", "t", "queries-table", "low"), ("4", "c", "h", "sends", "high"), ("5", "h", "t", "dbset", "high")]
    e += [("6", "d", "e", "uses-entity", "high"), ("7", "d", "t", "queries-table", "high"), ("8", "s", "t", "queries-table", "medium"), ("9", "h", "e", "matches-endpoint", "high"), ("10", "h", "e", "uses-entity", "high"), ("11", "h", "gone", "imports", "high")]
    kept = trace.trace_edges(spark.createDataFrame(e, "id string, src string, dst string, type string, confidence string"), n)
    assert ids(kept) == ["10", "2", "3", "8"]
    assert {r.id: r.w for r in kept.select("id", trace.edge_weight().alias("w")).collect()} == {"2": 1.0, "3": 6.0, "8": 10.0, "10": 5.0}


@pytest.mark.parametrize(
    ("kind", "layer", "path", "stage"),
    [
        ("route", "ui", "front/r.tsx", "route-root"), ("route", "ui", "front/other.tsx", "route"), ("hook", "ui", None, "support"), ("component", "auxiliary", None, "support"), ("query", "x", None, "request"), ("command", "x", None, "request"),
        ("service", "backend-service", None, "back-service"), ("service", "front-service", None, "front-service"), ("repository", "backend-repository", None, "back-repository"), ("repository", None, None, "front-repository"),
        ("main-component", "ui", None, "main"), ("data-context", "x", None, "back-repository"), ("odd", "x", "back/a.cs", "back-service"), ("odd", "x", "front/a.ts", "support"), ("odd", None, None, "support"), ("table", "db", None, "table"),
    ],
)
def test_stages(spark, kind, layer, path, stage):
    row = spark.createDataFrame([(kind, layer, path)], "type string, layer string, path string").select(trace.stage(F.col("type"), F.col("layer"), F.col("path"), ("front/r.tsx",)).alias("s"))
    assert row.withColumn("n", trace.stage_rank(F.col("s"))).first()[:] == (stage, trace.STAGES.index(stage))


def test_trace_by_intent(spark):
    n = [("p", "InvoiceCreatePage", "page", None, None, None), ("e1", "GET /api/invoices", "endpoint", None, "ListInvoices", "GET"), ("e2", "POST /api/invoices", "endpoint", None, "AddInvoice", "POST"), ("h1", "ListHandler", "handler", None, None, None), ("h2", "InvoicesHandler", "handler", None, None, None), ("t", "a_table", "table", None, None, None)]
    e = [("p", "e1", "calls-api"), ("p", "e2", "calls-api"), ("e1", "h1", "handled-by"), ("e2", "h2", "handled-by"), ("h1", "t", "maps-to-table"), ("h2", "t", "maps-to-table")]
    nodes = spark.createDataFrame(n, "id string, label string, type string, path string, action string, method string").withColumn("layer", F.lit("x"))
    edges = spark.createDataFrame([(f"{a}-{b}", a, b, t, "high") for a, b, t in e], "id string, src string, dst string, type string, confidence string")
    assert trace.search_tokens("InvoiceCreatePage new index") == ["invoice", "create", "page", "new"]
    weights = {r.id: r.weight for r in trace.weighted_edges(edges, nodes, trace.search_tokens("InvoiceCreatePage")).collect()}
    assert weights == {"p-e1": 0.25 + 8, "p-e2": 0.25, "e1-h1": 1.0, "e2-h2": 0.25, "h1-t": 1.0, "h2-t": 1.0}
    assert trace.node_trace(nodes, edges, "p") == ["p", "e2", "h2", "t"] and trace.node_trace(nodes, edges, "t") == ["t"] and trace.node_trace(nodes, edges, "nobody") == []
    assert trace.node_trace(nodes, edges, "h1", F.col("type") == "page") == ["h1"]


@pytest.mark.parametrize(
    ("path", "kind"),
    [
        ("src/components/UserMain/index.tsx", "main-component"), ("src/components/Card/index.tsx", "component"), ("src/pages/login.tsx", "page"), ("src/pages/Login/index.tsx", "page"), ("src/components/_parts/Row.tsx", "subcomponent"),
        ("src/components/a/b/c.tsx", "subcomponent"), ("src/x/useThing.ts", "hook"), ("src/useCart/index.ts", "hook"), ("src/services/api.ts", "service"), ("src/lib/a.ts", "auxiliary"), ("src/lib/schemas/a.ts", "config"), ("src/other.ts", "auxiliary"),
    ],
)
def test_front_classes(spark, path, kind):
    assert spark.range(1).select(rules.classify_front(F.lit(path)).alias("c")).first().c.type == kind


@pytest.mark.parametrize(
    ("raw", "url", "key"),
    [
        ("/api//v1/users/?q=1", "/api/v1/users/?q=1", "GET /api/v1/users/?q=1"), ("/api/api/users/", "/api/users", "GET /api/users"), ("/api/v{version:apiVersion}/u/{id}/:name", "/api/v1/u/{id}/:name", "GET /api/v1/u/{}/{}"),
        ("/api/u/:id-no", "/api/u/:id-no", "GET /api/u/{}"), ("/apix", "/apix", "GET /apix"), ("api/x", None, None), ("/other", None, None), ("", None, None), (None, None, None),
    ],
)
def test_endpoints(spark, raw, url, key):
    row = spark.createDataFrame([(raw,)], "raw string").select(fx.normalize_endpoint(F.col("raw")).alias("u")).select("u", fx.endpoint_id(F.col("u"), F.lit("get")).alias("k")).first()
    assert row.u == url and row.k == (f"endpoint:{key}" if key else None)


def test_endpoint_links(spark):
    side = lambda *urls: spark.createDataFrame([(f"{m} {u}", u, m) for m, u in urls], "id string, url string, method string")
    links = rules.link_endpoints(side(("ANY", "/api/a/${x}"), ("GET", "/api/A/{id}"), ("GET", "/api/a/:id/")), side(("GET", "/api/a/{key}"), ("POST", "/api/a/:k")))
    assert {(r.src, r.dst) for r in links.collect()} == {("ANY /api/a/${x}", "GET /api/a/{key}"), ("ANY /api/a/${x}", "POST /api/a/:k"), ("GET /api/a/:id/", "GET /api/a/{key}")}


def test_names(spark):
    row = spark.range(1).select(
        fx.kebab(F.lit("userProfile View_x")).alias("k"), fx.display_label(F.lit("a/b/index.ts")).alias("d"), rules.module_of(F.lit("back/Api/Controllers/UserAdminController.cs")).alias("m"), rules.module_of(F.lit("back/Api/Controllers/HealthController.cs")).alias("h"), fx.health_key(F.lit(7.5)).alias("q"),
        fx.title_case(F.lit("user-profile_view x")).alias("t"), fx.truncated(F.lit("abcdefgh"), 4).alias("c"), fx.slug(F.lit(" Über uns! 2 ")).alias("s"), fx.html_escaped(F.lit("<a & 'b'>")).alias("e"),
    ).first()
    assert tuple(row) == ("user-profile-view-x", "b", "user-admin", "shared", "good", "User Profile View X", "abc…", "über-uns-2", "&lt;a &amp; &#39;b&#39;&gt;")


def test_coverage_counts_a_test_once(spark):
    tests = spark.createDataFrame([("t1", "a", 2), ("t1", "a", 5), ("t2", "a", 1), ("t2", "gone", 1), ("t1", "b", 2)], "test string, source string, cases int")
    got = measure.coverage_by_source(spark.createDataFrame([("a",), ("b",), ("c",)], "source string"), tests)
    assert {tuple(r) for r in got.collect()} == {("a", "t1,t2", 6), ("b", "t1", 5)}


def test_levels_of_chains_and_circles(spark):
    chain = [(f"c{i:02}", f"c{i + 1:02}") for i in range(24)]
    circle = [("x", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("b", "y"), ("y", "z"), ("z", "other")]
    names = sorted({v for e in chain + circle for v in e})
    n = spark.createDataFrame([(v, "m", "k" if v == "other" else "l") for v in names], "id string, module string, layer string")
    got = {r.id: r.level for r in layout.levels(n, spark.createDataFrame(chain + circle, "src string, dst string")).collect()}
    assert got == {f"c{i:02}": i for i in range(25)} | {"x": 0, "a": 3, "b": 1, "c": 2, "y": 2, "z": 3, "other": 0}


def test_levels_and_rows(spark):
    n = spark.createDataFrame([("a", "A", "m", "l"), ("b", "B", "m", "l"), ("c", "C", "m", "l")], "id string, label string, module string, layer string")
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "src string, dst string")
    assert {r.id: r.level for r in layout.levels(n, e).collect()} == {"a": 0, "b": 1, "c": 2}
    assert {r.id: r.y for r in layout.rows(n).collect()} == {"a": 0, "b": 76, "c": 152}


def test_digest_has_the_same_buckets_whatever_the_number_of_lines(spark, monkeypatch):
    from hashlib import sha256

    texts = [f"line {i} é" for i in range(600)] + ["line 1 é", "", "a\nb"]
    lines = spark.createDataFrame([(t,) for t in [*texts, None]], "line string").repartition(7)
    monkeypatch.setattr(lines, "count", lambda: 1 << 30)
    buckets = {}
    for t in sorted(texts, key=str.encode):
        buckets.setdefault(sha256(t.encode()).hexdigest()[:2], []).append(t)
    whole = "\n".join(f"{b} {sha256(chr(10).join(ts).encode()).hexdigest()}" for b, ts in sorted(buckets.items()))
    assert measure.digest(lines).first().digest == "sha256:" + sha256(whole.encode()).hexdigest()
    none = spark.createDataFrame([], "line string")
    assert measure.digest(none).first().digest == "sha256:" + sha256(b"").hexdigest()


def test_module_stats_join_what_is_known_of_nodes_once(spark):
    nodes = spark.createDataFrame([("a", "component", "m", "p/a"), ("b", "component", "m", "p/b"), ("c", "table", "n", None), ("d", "page", None, "p/d")], "id string, type string, module string, path string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    found = spark.createDataFrame([("a", "r1"), ("a", "r1"), ("c", "r2"), ("gone", "r2")], "node_id string, rule_id string")
    scores = spark.createDataFrame([("a", 4), ("b", 9)], "id string, score long")
    out = measure.module_stats(nodes, ids("b", "b", "gone"), ids("a", "a"), found, scores)
    got = {r.module: tuple(r)[1:] for r in out.collect()}
    assert got == {"m": (2, 1, 1, 1, 2, 13, 2, "r1=2"), "n": (1, 0, 0, 0, 1, 0, 0, "r2=1"), None: (1, 0, 1, 0, 0, 0, 0, "")}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 3
