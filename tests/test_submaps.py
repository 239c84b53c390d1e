from graphloom.operators import measure, rules, submaps, views
from graphloom.operators.submaps import Stored
from graphloom.plans import cgraph, queries
from graphloom.sources.work import cut


def stored(spark, **over):
    parts = {
        "nodes": ([("a", "m1"), ("b", "m1"), ("c", None)], "id string, module string"),
        "edges": ([("e1", "a", "b")], "id string, src string, dst string"),
        "findings": ([("f1", "a")], "id string, node_id string"),
        "boundaries": ([("x1", "a", "z")], "edge_id string, inside_id string, outside_id string"),
        "access": ([("a", "editable"), ("b", "readable"), ("c", "readable")], "id string, level string"),
        "orphans": ([("c",)], "id string"),
        "seeds": ([("a",)], "id string"),
        "statistics": ([("nodes", 3), ("edges", 1), ("findings", 1), ("boundaries", 1), ("editable", 1), ("readable", 2), ("forbidden", 0), ("generated", 0), ("external", 0)], "field string, value long"),
    }
    default = over.pop("default_access", "readable")
    return Stored(**{k: spark.createDataFrame(over.get(k, rows), schema) for k, (rows, schema) in parts.items()}, default_access=default)


def issues(s):
    return sorted((r.code.removeprefix("SUBMAP_"), r.subject, r.detail) for r in submaps.content_issues(s).collect())


def test_sound_document(spark):
    assert issues(stored(spark)) == []


def test_each_fault_is_found(spark):
    assert issues(stored(spark, nodes=[("a", None), ("b", None), ("c", None)] + [("b", None)] * 2)) == [("DUPLICATE_NODE_ID", "b", None)] * 2 + [("STATISTICS_MISMATCH", "nodes", "5")]
    assert [c for c, *_ in issues(stored(spark, edges=[(None, "a", "b"), ("", "a", "b"), ("e2", None, "b"), ("e3", "q", "p")]))] == ["EDGE_ENDPOINT_MISSING", "INVALID_EDGE_ENDPOINT", "INVALID_EDGE_ID", "INVALID_EDGE_ID", "STATISTICS_MISMATCH"]
    assert issues(stored(spark, findings=[("f1", "q")])) == [("FINDING_NODE_MISSING", "f1", "q")]
    assert issues(stored(spark, findings=[("f1", None)])) == [] and issues(stored(spark, seeds=[("q",)])) == [("SEED_NODE_MISSING", "q", "q")]
    assert issues(stored(spark, orphans=[(None,), ("q",)])) == [("INVALID_ORPHAN_NODE_ID", None, None), ("ORPHAN_NODE_MISSING", "q", "q")]
    assert issues(stored(spark, boundaries=[("e1", "q", "b")])) == [("BOUNDARY_EDGE_INCLUDED", "e1", None), ("BOUNDARY_NODE_MISSING", "e1", "q"), ("BOUNDARY_OUTSIDE_INCLUDED", "e1", "b")]
    assert issues(stored(spark, boundaries=[("x1", "a", None)])) == [("INVALID_BOUNDARY", "x1", None)]
    faulty = issues(stored(spark, access=[("a", "editable"), ("a", "readable"), ("q", "readable"), ("b", "unheard")]))
    assert faulty == [("ACCESS_CONFLICT", "a", None), ("ACCESS_NODE_MISSING", "readable", "q"), ("ACCESS_UNCLASSIFIED", "b", None), ("ACCESS_UNCLASSIFIED", "c", None)]
    assert issues(stored(spark, default_access="unheard")) == [("ACCESS_DEFAULT_INVALID", None, None)]


def test_against_the_graph(spark):
    s = stored(spark)
    graph = s.nodes.filter("id <> 'a'").selectExpr("id", "if(id = 'b', 'm9', module) as module", "1 as extra")
    got = {tuple(r) for r in submaps.against_graph(s, graph, s.edges, "d1", "d2").collect()}
    assert got == {("error", "SUBMAP_SOURCE_NODE_MISSING", "a"), ("warning", "SUBMAP_SOURCE_NODE_CHANGED", "b"), ("error", "SUBMAP_GRAPH_DIGEST_MISMATCH", "d1")}
    assert submaps.against_graph(s, s.nodes, s.edges).count() == 0


def test_differences(spark):
    a, b = stored(spark), stored(spark, nodes=[("a", "m1"), ("d", "m2")], access=[("a", "readable"), ("d", "readable")], boundaries=[])
    got = {tuple(r) for r in submaps.difference(a, b).collect()}
    assert got == {("node", "added", "d"), ("node", "removed", "b"), ("node", "removed", "c"), ("access", "editable>readable", "a"), ("access", "readable>", "b"), ("access", "readable>", "c"), ("access", ">readable", "d")}
    row = submaps.difference_summary(a, b).first()
    assert (row.nodes_added, row.nodes_removed, row.access_changes, row.boundaries_before, row.boundaries_after, row.node_delta, row.changed) == (1, 2, 4, 1, 0, -1, True)
    same = submaps.difference_summary(a, a).first()
    assert not same.changed and same.boundaries_before == 1
    assert [tuple(r) for r in submaps.inspected(a).collect()] == [("m1", 2)]
    assert submaps.same_selection(a.nodes, a.nodes) and not submaps.same_selection(a.nodes, b.nodes)


def test_order_of_a_domain(spark):
    nodes = spark.createDataFrame([(x, x.upper()) for x in "abcdefg"], "id string, label string")
    links = spark.createDataFrame([("d", "e"), ("d", "f"), ("e", "f"), ("b", "c"), ("g", "g"), ("a", "nowhere")], "src string, dst string")
    got = sorted((r.position, r.id) for r in views.domain_order(nodes, links, cut).collect())
    # d, e, f have two neighbours each: by outgoing (2, 1, 0); then b before c; those alone by label.
    assert [i for _, i in got] == ["d", "e", "f", "b", "c", "a", "g"] and [p for p, _ in got] == list(range(7))
    assert views.domain_order(nodes.limit(0), links, cut).count() == 0


def test_internal_parents(spark):
    rows = [
        ("page", "page", "m", "f/pages/Cart/index.tsx"), ("deep", "component", "m", "f/pages/Cart/_parts/Row.tsx"), ("near", "component", "m", "f/components/_own/Row.tsx"),
        ("lone", "component", "x", "f/components/_own/Lone.tsx"), ("main", "main-component", "m", "f/main.tsx"), ("hook", "hook", "m", "f/components/_h/use.ts"), ("none", "component", "m", None),
    ]
    nodes = spark.createDataFrame(rows, "id string, type string, module string, path string")
    edges = spark.createDataFrame([("page", "near"), ("near", "hook"), ("near", "near")], "src string, dst string")
    assert {r.id: (r.parent, r.tier) for r in views.internal_parents(nodes, edges).collect()} == {"deep": ("page", 0), "near": ("page", 1), "lone": (None, None)}


def test_skipped_files(spark):
    skipped = spark.createDataFrame([(f"p{i}",) for i in range(7)], "path string")
    assert views.skipped_warning(skipped) == "7 source files larger than 2 MiB were skipped: p0, p1, p2, p3, p4, and 2 more."
    assert views.skipped_warning(skipped.filter("path = 'p3'")) == "1 source file larger than 2 MiB was skipped: p3." and views.skipped_warning(skipped.limit(0)) is None


def test_a_submap_reads_written_tables(spark, sf_dir):
    graph = cut(cgraph.nodes(spark, sf_dir)), cut(cgraph.edges(spark, sf_dir))
    found = queries._submap(spark, sf_dir, 1, graph)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for part in (found.nodes, found.edges, found.boundaries, found.access):
        assert "l_quantity" not in plan(part) and "o_custkey" not in plan(part)  # else the graph is made again in every step
    without = queries._submap(spark, sf_dir, 1)
    for part in ("nodes", "edges", "boundaries", "access"):
        assert "l_quantity" not in plan(getattr(without, part)) and "o_custkey" not in plan(getattr(without, part))
        assert sorted(map(str, getattr(without, part).collect())) == sorted(map(str, getattr(found, part).collect()))


def test_a_domain_reads_its_nodes_once(spark, monkeypatch):
    nodes = cut(spark.createDataFrame([(f"n{i:03}", f"L{i % 7}") for i in range(200)], "id string, label string"))
    links = spark.createDataFrame([(f"n{i:03}", f"n{i * 3 % 100:03}") for i in range(0, 90)], "src string, dst string")
    kept = []
    write = lambda t: kept.append(t) or cut(t)
    monkeypatch.setattr(rules, "cut", write)
    got = views.domain_order(nodes, links, write)
    assert sorted(r.position for r in got.collect()) == list(range(200))
    assert sum(bool(set(nodes.inputFiles()) & set(t.inputFiles())) for t in kept) == 1


def test_edges_are_joined_once_for_words_and_evidence(spark):
    nodes = spark.createDataFrame([(x, "hook", "m" + x[0], f"l{x}", None) for x in ("a", "a2", "b", "c")], "id string, type string, module string, label string, path string")
    edges = cut(spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("a", "a2"), ("a", "a"), ("a", "b"), ("a", "nowhere")], "src string, dst string"))
    seen = measure.quality_evidence(nodes, edges, "x", [], [])
    assert sorted((r.id, r.internal, r.external, r.outgoing, r.incoming, r.external_modules) for r in seen.collect()) == [("a", 3, 4, 5, 2, 2), ("a2", 1, 0, 0, 1, 0), ("b", 0, 3, 1, 2, 1), ("c", 0, 1, 0, 1, 0)]
    assert seen._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
    evidence = nodes.selectExpr("id", "1 as internal_relations", "2 as external_relations", "3 as outgoing", "4 as incoming", "false as inside_folder")
    told = views.narratives(nodes, edges, evidence)
    assert not set(edges.inputFiles()) & set(told.inputFiles())
    assert {r.id: (r.related, r.coupling.split("dependencies; ")[1]) for r in told.collect()} == {
        "a": (["a2", "b", "c"], "2 external modules: mb, mc; external deps: lb, lc"), "a2": (["a"], "0 external modules: none"), "b": (["a"], "1 external modules: ma; external deps: la"), "c": (["a"], "1 external modules: ma"),
    }
