"""Node traces against a plain search, on graphs with circles, ties and dead ends."""

import heapq
import random

import pyarrow.parquet as pq
import pytest

from graphloom.operators import nearest, nodetrace, trace
from graphloom.operators.nodetrace import CONTAINERS, CONTINUED, node_traces
from graphloom.sources import work

NODE = "id string, label string, type string, layer string, module string, path string, action string, method string"
EDGE = "id string, src string, dst string, type string, confidence string"
ENDING = "s"


def words(label):
    return trace.search_tokens(label)


def one(w):
    return w[:-1] if len(w) > 4 and w.endswith(ENDING) else w


def gain(node, tokens):
    if not tokens or node["type"] not in ("endpoint", "query", "command", "handler", "repository", "entity", "table"):
        return 0
    name = node["action"] if node["type"] == "endpoint" and node["action"] else node["label"] or ""
    import re

    mine = [one(w) for w in re.split(r"[^a-z0-9]+", re.sub("([a-z])([A-Z])", r"\1 \2", name).lower())]
    mine = [w for w in mine if len(w) > 3 and w not in ("command", "query", "handler", "repository", "controller", "endpoint")]
    if mine and set(mine) <= {one(t) for t in tokens}:
        return 1.75
    return 0.75 if any(t in f"{name} {node['path'] or ''}".lower() for t in tokens) else 0


def penalty(node, tokens):
    if node["type"] != "endpoint" or not node["action"]:
        return 0
    action, get = node["action"].lower(), node["method"] == "GET"
    for asked, fits, cost in ((("create", "new"), "create" in action or "add" in action, 8), (("edit", "update"), any(x in action for x in ("update", "edit", "save", "set")), 8), (("list",), any(x in action for x in ("list", "search", "getall")) or get, 6), (("detail", "view"), any(x in action for x in ("get", "detail", "byid")) or get, 4)):
        if set(asked) & set(tokens):
            return 0 if fits else cost
    return 0


def search(nodes, steps, start, goal, tokens):
    costs, before, heap, done = {start: 0}, {}, [(0, start)], set()
    while heap:
        cost, at = heapq.heappop(heap)
        if at in done:
            continue
        done.add(at)
        if goal(nodes[at]):
            way, used = [at], []
            while way[-1] != start:
                up, edge = before[way[-1]]
                way.append(up)
                used.append(edge)
            return way[::-1], used[::-1], True
        for edge, to, base in steps.get(at, ()):
            price = max(0.25, base - gain(nodes[to], tokens)) + penalty(nodes[to], tokens)
            if cost + price < costs.get(to, float("inf")):
                costs[to] = cost + price
                before[to] = (at, edge)
                heapq.heappush(heap, (cost + price, to))
    return [start], [], False


def reach(steps, starts):
    seen, now = set(starts), set(starts)
    for _ in range(28):
        now = {to for a in now for _, to, _ in steps.get(a, ())} - seen
        seen |= now
    return seen


def plain(nodes, kept, start, entries):
    """kept: (edge, src, dst, base) sorted by edge id."""
    out, back = {}, {}
    for edge, a, b, base in kept:
        out.setdefault(a, []).append((edge, b, base))
        back.setdefault(b, []).append((edge, a, base))
    origin = lambda n: n["type"] == "route" and (not entries or n["path"] in entries)
    left, left_edges, found = search(nodes, back, start, origin, [])
    me = nodes[start]
    holds = lambda x: nodes[x]["module"] == me["module"] and not origin(nodes[x]) and nodes[x]["type"] in CONTAINERS
    tokens = list(dict.fromkeys(words(me["label"]) + [w for x in left[1:] if holds(x) for w in words(nodes[x]["label"])]))

    def stored(x):
        first = search(nodes, out, x, lambda n: n["type"] == "table", tokens)
        return first if first[2] else search(nodes, out, x, lambda n: n["type"] == "entity", tokens)

    right, right_edges, reached = stored(start)
    carried = None
    if not reached and me["type"] in CONTINUED:
        for x in left[1:]:
            if holds(x) and (trial := stored(x))[2]:
                right, right_edges, reached, carried = *trial, x
                break
        else:
            right, right_edges = [start], []
    root = carried or start
    forward, backward = reach(out, {root}), reach(back, {root})
    stores = {x for x in forward if nodes[x]["type"] == "table"} or {x for x in forward if nodes[x]["type"] == "entity"}
    every = {start, root, *left} | forward & reach(back, stores) | backward & reach(out, {x for x in backward if origin(nodes[x])})
    primary = list(dict.fromkeys(left[::-1] + right[1:]))
    return left, right, set(left_edges) | set(right_edges), primary, carried, found, reached, every


@pytest.mark.parametrize(("seed", "entries"), [(2, ("front/r0",))])
def test_like_a_plain_search(spark, seed, entries):
    rng = random.Random(seed)
    kinds = ["route", "page", "component", "component", "hook", "subcomponent", "service", "endpoint", "handler", "repository", "entity", "table", "data-context", "controller"]
    names = ["shipCreate", "DockList", "mooring", "ShipsRepository", "tide", "crewDetail", "new dock"]
    nodes = {}
    for i in range(40):
        kind = "route" if i == 0 else rng.choice(kinds)
        nodes[f"n{i:02}"] = {"id": f"n{i:02}", "label": rng.choice(names), "type": kind, "layer": "x", "module": rng.choice(["a", "a", "b", None]), "path": f"front/r{i}" if rng.random() < 0.7 else None, "action": rng.choice(["AddShip", "ListDocks", None, ""]) if kind == "endpoint" else None, "method": rng.choice(["GET", "POST"]) if kind == "endpoint" else None}
    ids = list(nodes)
    rows = {}
    for _ in range(70):
        a, b = rng.sample(ids, 2)
        kind = rng.choice(["imports", "imports", "calls-api", "depends-on", "uses-entity", "queries-table", "maps-to-table", "dbset"])
        rows[f"{a}::{kind}::{b}"] = (a, b, kind, rng.choice(["high", "medium", "low"]))
    n = spark.createDataFrame([tuple(x.values()) for x in nodes.values()], NODE)
    e = spark.createDataFrame([(k, *v) for k, v in rows.items()], EDGE)
    kept = sorted((r.id, r.src, r.dst, r.w) for r in trace.trace_edges(e, n).select("id", "src", "dst", trace.edge_weight().alias("w")).collect())
    got = node_traces(n, e, n.select("id"), entries)
    members = {}
    for r in got.members.collect():
        members.setdefault(r.source, set()).add(r.id)
    inner = {}
    for r in got.member_edges.collect():
        inner.setdefault(r.source, set()).add(r.edge)
    seen = 0
    for r in got.paths.collect():
        left, right, edges, primary, carried, found, reached, every = plain(nodes, kept, r.source, entries)
        assert (r.left_nodes, r.right_nodes, r.continued_from) == (left, right, carried), r.source
        assert set(r.primary_edges) == edges and r.primary_nodes == primary
        assert (r.missing_start, r.missing_persistence, r.complete) == (not found, not reached, found and reached)
        assert members[r.source] == every and inner.get(r.source, set()) == {k for k, a, b, _ in kept if a in every and b in every}
        tables, ends = ([x for x in every if nodes[x]["type"] == t] for t in ("table", "endpoint"))
        assert (r.n_tables, r.n_endpoints, r.path_count) == (len(tables), len(ends), max(1, len(tables), len(ends)))
        seen += carried is not None
    assert got.paths.count() == len(nodes)


def test_a_component_goes_on_from_its_page(spark):
    n = [("r", "Root", "route", "x", "shop", "front/r", None, None), ("p", "CartPage", "page", "x", "shop", "front/p", None, None), ("c", "Total", "component", "x", "shop", "front/c", None, None), ("d", "Deep", "component", "x", "shop", "front/d", None, None), ("e", "GET /api/carts", "endpoint", "x", "shop", None, None, None), ("h", "H", "handler", "x", "shop", "back/h", None, None), ("t", "carts", "table", "x", "shop", None, None, None)]
    e = [("r", "p", "imports"), ("p", "c", "imports"), ("c", "d", "imports"), ("p", "e", "calls-api"), ("e", "h", "handled-by"), ("h", "t", "queries-table")]
    nodes, edges = spark.createDataFrame(n, NODE), spark.createDataFrame([(f"{a}{b}", a, b, t, "high") for a, b, t in e], EDGE)
    got = node_traces(nodes, edges, spark.createDataFrame([("d",), ("gone",)], "id string"))
    (r,) = got.paths.collect()
    assert (r.continued_from, r.left_nodes, r.right_nodes, r.primary_nodes) == ("p", ["d", "c", "p", "r"], ["p", "e", "h", "t"], ["r", "p", "c", "d", "e", "h", "t"]) and r.complete


def test_the_node_before_is_the_nearest_then_the_smaller(spark):
    e = spark.createDataFrame([("s", "z", 1.0), ("s", "b", 2.0), ("z", "t", 2.0), ("b", "t", 1.0), ("s", "x", 1.0), ("x", "t", 2.0)], "src string, dst string, weight double")
    best = trace.cheapest(e, spark.createDataFrame([("s",)], "id string"))
    assert {r.id: (r.cost, r.previous) for r in best.collect()} == {"s": (0, None), "z": (1, "s"), "b": (2, "s"), "x": (1, "s"), "t": (3, "x")}


def test_ways_of_a_chain_take_few_rounds(spark):
    rows = [(1, f"n{i:03}", float(i), f"n{i - 1:03}" if i else None, f"e{i}" if i else None) for i in range(200)]
    best = spark.createDataFrame(rows, "k int, id string, cost double, previous string, edge string")
    (w,) = trace.ways(best, spark.createDataFrame([(1, "n199")], "k int, id string"), ["k"]).collect()
    assert w.nodes == [f"n{i:03}" for i in range(200)] and w.edges == [f"e{i}" for i in range(1, 200)]


def test_no_nodes(spark):
    got = node_traces(spark.createDataFrame([], NODE), spark.createDataFrame([], EDGE), spark.createDataFrame([("a",)], "id string"))
    assert got.paths.count() == got.members.count() == got.member_edges.count() == 0


def test_ways_alone_need_no_search_for_members(spark, monkeypatch):
    n = spark.createDataFrame([("r", "route", "m", "Home", "front/r"), ("p", "page", "m", "Ships", "front/p"), ("h", "handler", "m", "Ship", "back/h"), ("t", "table", "m", "ships", None)], "id string, type string, module string, label string, path string")
    e = spark.createDataFrame([("r", "imports", "p"), ("p", "calls-api", "h"), ("h", "queries-table", "t")], "src string, type string, dst string")
    e = e.selectExpr("concat_ws('::', src, type, dst) AS id", "src", "dst", "type", "'high' AS confidence")
    chosen = n.filter("id = 'p'").select("id")
    whole = nodetrace.node_traces(n, e, chosen).paths
    monkeypatch.setattr(nodetrace, "spread", None)
    alone = nodetrace.node_paths(n, e, chosen)
    assert alone.collect() == whole.select(alone.columns).collect()
    assert alone.first().primary_nodes == ["r", "p", "h", "t"]


def test_ways_longer_than_those_followed_edge_by_edge(spark):
    for n in (3, trace.SHORT_WAY + 2):
        best = spark.createDataFrame([(1, f"v{i:03}", float(i), f"v{i - 1:03}" if i else None, f"e{i}" if i else None) for i in range(n + 1)], "k int, id string, cost double, previous string, edge string")
        got = trace.ways(best, spark.createDataFrame([(1, f"v{n:03}")], "k int, id string"), ["k"]).collect()
        assert [(r.nodes, r.edges) for r in got] == [([f"v{i:03}" for i in range(n + 1)], [f"e{i}" for i in range(1, n + 1)])]


def test_pages_of_the_same_words_share_one_search(spark, monkeypatch, tmp_path):
    """No table that is written has more rows than there are edges, though every page reaches all tables."""
    n = [("r", "route", "m", "Home", "front/r"), ("e", "endpoint", "m", "GET /", None), ("h", "handler", "m", "H", "back/h")]
    n += [(f"p{i:02}", "page", "m", f"Ships {i}", f"front/p{i}") for i in range(12)]
    n += [(f"{k}{i:02}", kind, "m", "x", None) for k, kind in (("d", "repository"), ("t", "table")) for i in range(40)]
    e = [("r", f"p{i:02}", "imports", "high") for i in range(12)] + [(f"p{i:02}", "e", "calls-api", "high") for i in range(12)] + [("e", "h", "handled-by", "high")]
    e += [("h", f"d{i:02}", "depends-on", "high" if i == 7 else "low") for i in range(40)] + [(f"d{i:02}", f"t{i:02}", "queries-table", "high") for i in range(40)]
    nodes = spark.createDataFrame(n, "id string, type string, module string, label string, path string")
    edges = spark.createDataFrame([(f"{a}::{t}::{b}", a, b, t, c) for a, b, t, c in e], EDGE)
    monkeypatch.setattr(work, "work_dir", lambda s: f"file://{tmp_path}")
    for user in (trace, nearest):
        monkeypatch.setattr(user, "drop", lambda *tables: None)
    got = nodetrace.node_paths(nodes, edges, nodes.filter("type = 'page'").select("id")).collect()
    assert {r.source: r.primary_nodes for r in got} == {f"p{i:02}": ["r", f"p{i:02}", "e", "h", "d07", "t07"] for i in range(12)}
    assert all(r.right_edges == [f"{r.source}::calls-api::e", "e::handled-by::h", "h::depends-on::d07", "d07::queries-table::t07"] for r in got)
    rows = [sum(pq.read_metadata(f).num_rows for f in t.rglob("*.parquet")) for t in tmp_path.iterdir()]
    assert max(rows) == len(e)


def test_tables_of_a_long_way_are_merged(spark, monkeypatch):
    """A chain with an edge that leads back and two that cost the same, of which the smaller id counts."""
    monkeypatch.setattr(nearest, "MOST", 2)
    kinds = ["route", "page", *["component", "service"] * 3, "table"]
    nodes = spark.createDataFrame([(f"n{i}", k, "m", "x", None) for i, k in enumerate(kinds)], "id string, type string, module string, label string, path string")
    e = [(f"{i}", f"n{i}", f"n{i + 1}", "imports", "high") for i in range(len(kinds) - 1)] + [("3x", "n3", "n4", "sends", "high"), ("back", "n6", "n2", "imports", "high"), ("last", "n2", "n8", "imports", "low"), ("dear", "n3", "n8", "queries-table", "low")]
    (r,) = nodetrace.node_paths(nodes, spark.createDataFrame(e, EDGE), nodes.filter("id = 'n1'").select("id")).collect()
    assert (r.left_nodes, r.left_edges, r.right_nodes, r.right_edges) == (["n1", "n0"], ["0"], ["n1", "n2", "n8"], ["1", "last"])
    far = [x for x in e if x[0] != "last"]
    (r,) = nodetrace.node_paths(nodes, spark.createDataFrame(far, EDGE), nodes.filter("id = 'n1'").select("id")).collect()
    assert (r.right_nodes, r.right_edges) == ([f"n{i}" for i in range(1, 9)], [str(i) for i in range(1, 8)])
