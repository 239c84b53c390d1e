import math
import random

import numpy as np

from graphloom.llm import embdup
from graphloom.llm.embdup import similar_vectors, unit


def brute(rows, least=0.93):
    n = len(rows)
    ok = [v is not None and len(v) > 0 and lab is not None and i is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for i, v, lab in rows]
    links, parent = [0] * n, list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = unit(np.array([rows[i][1]], float))[0], unit(np.array([rows[j][1]], float))[0]
                if a @ b >= least:
                    links[i] += 1
                    links[j] += 1
                    parent[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted([(r[0], links[i], None if r[0] is None else low[find(i)], r[0] is None or low[find(i)] == r[0]) for i, r in enumerate(rows)], key=str)


def data(seed, groups, dim=32):
    rng, rows = np.random.default_rng(seed), []
    order = random.Random(seed)
    for g in range(groups):
        base = rng.standard_normal(dim)
        for k in range(order.randrange(1, 14)):
            v = base + rng.standard_normal(dim) * order.choice([0, 0.05, 0.15]) if k else base
            rows.append((int(order.randrange(1 << 40)), [float(np.float32(x)) for x in v], g % 3))
    return rows


def run(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").selectExpr("*", "1 as kept", "2 as rep", "3 as grp")
    return sorted(map(tuple, similar_vectors(df).collect()), key=str)


ODD = [
    (1, None, 1), (2, [], 1), (3, [0.0] * 32, 1), (4, [float("nan")] + [1.0] * 31, 1), (5, [float("inf")] * 32, 1), (6, [None] + [1.0] * 31, 1), (7, [1.0] * 32, None),
    (None, [1.0] * 32, 1), (8, [1.0] * 32, 1), (9, [2.0] * 32, 1), (10, [1.0] * 32, 2), (11, [1.0] * 31, 1), (12, [1.0] * 32, 1), (12, [1.0] * 32, 1),
]


def test_against_brute_force(spark):
    rows = data(1, 30) + ODD
    assert run(spark, rows) == brute(rows)


def test_blocks_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(embdup, "BLOCK", 5)
    monkeypatch.setattr(embdup, "TILE", 3)
    rng = np.random.default_rng(0)
    base = rng.standard_normal(16)
    rows = [(i, [float(x) for x in base + rng.standard_normal(16) * 0.02], 0) for i in range(60)] + data(2, 4, 16)
    assert run(spark, rows, "double") == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, None)]) == [(1, 0, 1, True)]


def test_recall_at_the_threshold():
    rng = np.random.default_rng(5)
    a = unit(rng.standard_normal((3000, 64)))
    b = rng.standard_normal((3000, 64))
    b = unit(b - (a * b).sum(1, keepdims=True) * a)
    met = {}
    for cos in (0.93, 0.95, 0.97, 0.1):
        c = a * cos + b * math.sqrt(1 - cos * cos)
        met[cos] = (embdup.bucket_codes(a) == embdup.bucket_codes(c)).any(1).mean()
    assert met[0.93] > 0.98 and met[0.95] > 0.995 and met[0.97] > 0.999 and met[0.1] < 0.02


def test_recall_on_the_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    want = {r[0]: r for r in brute(rows)}
    got = {r.vec_id: tuple(r) for r in similar_vectors(df).collect()}
    assert got.keys() == want.keys()
    assert sum(got[k][1] for k in got) >= 0.99 * sum(want[k][1] for k in want)
    assert all(got[k][1] <= want[k][1] for k in got)
