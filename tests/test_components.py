import random

from graphloom.operators import components
from graphloom.operators.components import connected_components
from graphloom.plans import cgraph
from graphloom.plans.queries import QUERIES


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {(x, find(x)) for x in parent}


def run(spark, edges):
    df = spark.createDataFrame(edges, "u long, v long")
    got = [tuple(r) for r in connected_components(df, lambda t: spark.createDataFrame(t.collect(), t.schema)).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_shapes(spark):
    chain = [(i, i + 1) for i in range(70)]
    random.Random(0).shuffle(chain)
    for edges in (chain, [(0, i) for i in range(1, 40)], [(5, 5)], [(None, 1), (1, None)], [], [(3, 9), (9, 3), (9, 4), (3, 9)], [(-7, 2), (2, 100)]):
        assert run(spark, edges) == brute(edges)


def test_random(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]
    assert run(spark, edges) == brute(edges)


def test_all_dependencies(spark, sf_dir):
    links = [(r.src, r.dst) for r in cgraph.edges(spark, sf_dir).filter("type = 'depends-on'").select("src", "dst").collect()]
    got = [tuple(r) for r in QUERIES["connected_components_of_dependencies"](spark, sf_dir).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(links)


def test_a_round_shuffles_three_times(spark):
    edges = spark.range(50).selectExpr("id + 1 as u", "id div 3 as v")
    plan = components._small_star(components._large_star(edges))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3  # every shuffle costs as many tasks as there are partitions, however few rows
