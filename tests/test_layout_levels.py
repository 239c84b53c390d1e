"""Levels against a plain recursive version: circles, circles in circles, long chains."""

import random
import sys

import pytest

from graphloom.operators import layout
from graphloom.sources import work


def plain(ids, edges):
    """Longest ways, where a predecessor that is still being visited counts as level 0; parts are entered at their smallest id."""
    sys.setrecursionlimit(10_000)
    before = {}
    for a, b in set(edges):
        if a != b:
            before.setdefault(b, []).append(a)
    reach = {}
    for start in ids:
        seen, todo = set(), [start]
        while todo:
            for p in before.get(todo.pop(), ()):
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        reach[start] = seen
    ring = {v: min([v, *(p for p in reach[v] if v in reach[p])]) for v in ids}
    memo, visiting = {}, set()

    def depth(v):
        if v in memo:
            return memo[v]
        if v in visiting:
            return 0
        visiting.add(v)
        own = [depth(p) + 1 for p in sorted(before.get(v, ())) if ring[p] == ring[v]]
        memo[v] = max([0, *own, *(depth(p) + 1 for p in before.get(v, ()) if ring[p] != ring[v])])
        visiting.discard(v)
        return memo[v]

    for v in sorted(ids, key=lambda v: (len(reach[v] | {v}), v)):
        depth(min(x for x in ids if ring[x] == ring[v]))
    for v in sorted(ids):
        depth(v)
    return memo


@pytest.mark.parametrize("seed", [1])
def test_like_a_plain_version(spark, seed):
    rng = random.Random(seed)
    ids = [f"v{i:02}" for i in range(30)]
    edges = [tuple(rng.sample(ids, 2)) for _ in range(32)] + [("p0", "p1"), ("p1", "p2"), ("p2", "p0"), ("q0", "q1"), ("q1", "q0"), ("q1", "v00"), ("v01", "v01")]
    ids += ["p0", "p1", "p2", "q0", "q1", "lonely"]
    n = spark.createDataFrame([(v, "m", "l") for v in ids], "id string, module string, layer string")
    got = {r.id: r.level for r in layout.levels(n, spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == plain(ids, edges)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(layout, "cut", lambda df: written.append(1) or work.cut(df))
    ids = [f"c{i:04}" for i in range(2000)]
    edges = list(zip(ids, ids[1:], strict=False)) + [("a", "c0500"), ("c1500", "z")]
    n = spark.createDataFrame([(v, "m", "l") for v in [*ids, "a", "z"]], "id string, module string, layer string")
    got = {r.id: r.level for r in layout.levels(n, spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {v: i for i, v in enumerate(ids)} | {"a": 0, "z": 1501}
    assert len(written) < 120


def test_a_walk_cuts_what_leads_from_the_open_path():
    assert layout.walked([("a", "b"), ("b", "c"), ("c", "a")]) == [("a", "b")]
    assert sorted(layout.walked([("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")])) == [("a", "b"), ("b", "c")]
