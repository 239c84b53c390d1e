import random
import re

import numpy as np
import pytest

from graphloom.llm import neardup
from graphloom.llm.neardup import near_duplicates, shingle_set, tokens


def plain_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows, k, percent=80):
    sets = [plain_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and None not in (rows[i][0], rows[j][0]) and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    group = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            group[find(i)] = min(group.get(find(i), d), d)
    return sorted(((d, len(sets[i]), group[find(i)] if d is not None else None, d is None or group[find(i)] == d) for i, (d, _) in enumerate(rows)), key=str)


def run(spark, rows, k, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as node", "1 as kept", "2 as n")
    return sorted(map(tuple, near_duplicates(df, k, **more).collect()), key=str)


def test_shingles_as_plain_sets():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice(["a", "B", "É", " ", "\n", "\t", "\x0b", " ", "x"]) for _ in range(rng.randrange(30)))
        for k in (1, 4, 5):
            assert len(shingle_set(text, k)) == len(plain_set(text, k)), repr(text)
    assert (shingle_set("The CAT sat down", 4) == shingle_set(" the cat\nSAT  down ", 4)).all()
    assert (shingle_set("a b", 4) != shingle_set("b a", 4)).any()
    assert len(shingle_set(None, 4)) == len(shingle_set(" \n", 4)) == 0


def test_tokens_estimate_similarity():
    rng = np.random.default_rng(0)
    base = np.sort(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
    agree = []
    for _ in range(40):
        x, y = np.sort(rng.permutation(base)[:2700]), np.sort(rng.permutation(base)[:2700])
        j = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        agree.append((tokens(x) == tokens(y)).mean() - j)
    assert abs(np.mean(agree)) < 0.03


def corpus(seed, groups, spread):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    common = [word() for _ in range(40)]
    rows = []
    for g in range(groups):
        base = [word() for _ in range(rng.choice([3, 20, 60, 150]))] + (common if g % 3 == 0 else [])
        for _ in range(rng.randrange(1, spread)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, len(copy) // 25) + 1)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows) * 7 % 1009, " ".join(copy)))
    return rows


@pytest.mark.parametrize("k", [4, 5])
def test_against_brute_force(spark, k):
    rows = corpus(k, 30, 9) + [(2000, None), (2001, ""), (2002, " \n"), (2003, "one two"), (2004, "One  Two"), (None, "one two"), (2005, "one two three")]
    assert run(spark, rows, k) == brute(rows, k)


def test_large_nodes_branch(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 3)
    rows = corpus(9, 5, 30)
    assert run(spark, rows, 4) == brute(rows, 4)


def test_last_descent_is_exhaustive(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 2)
    monkeypatch.setattr(neardup, "ROUNDS", 0)
    rows = corpus(11, 4, 20)
    assert run(spark, rows, 4) == brute(rows, 4)


def test_empty_and_repeated(spark):
    assert run(spark, [], 4) == []
    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (1, "x")]
    assert run(spark, rows, 4) == sorted([(5, 4, 5, True), (5, 4, 5, True), (1, 1, 1, True)], key=str)


def test_paths_of_a_pair_survive_all_descents(spark):
    # 60 of 75 tokens agree: 0.8.
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        x, y = rng.integers(-(1 << 31), 1 << 31, (2, neardup.TOKENS))
        same = rng.permutation(neardup.TOKENS)[:60]
        y[same] = x[same]
        rows += [(2 * i, x.tolist()), (2 * i + 1, y.tolist())]
    sets = spark.createDataFrame(rows, "rep long, tokens array<int>").selectExpr("*", "100L as n")
    nodes = neardup._first_nodes(sets)
    for _ in range(neardup.ROUNDS):
        nodes = neardup._lower_nodes(nodes, sets)
    met = nodes.selectExpr("node", "rep", "rep div 2 as pair").groupBy("node", "pair").agg({"rep": "count"}).filter("`count(rep)` = 2").select("pair").distinct()
    assert met.count() == 300


def test_blocks_of_a_large_node(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 20)
    rng = np.random.default_rng(6)
    common = rng.integers(1, 1 << 62, 140)
    rows = []
    for i in range(90):
        own = rng.integers(1, 1 << 62, 30)
        rows.append((i, sorted([*common.tolist(), *own.tolist()])))
        if i % 3 == 0:
            rows.append((100 + i, sorted([*common.tolist(), *own[:12].tolist(), *rng.integers(1, 1 << 62, 18).tolist()])))
    shingles = spark.createDataFrame(rows, "doc_id long, shingles array<long>")
    members = shingles.selectExpr("7L as node", "doc_id as rep", "cast(size(shingles) as long) as n", "doc_id as component")
    found = {tuple(sorted(r)) for r in neardup._linked_in_blocks(members, shingles, 80).collect()}
    assert found == {(i, 100 + i) for i in range(0, 90, 3)}


def test_recall_in_a_group_of_near_copies(spark):
    # Any two share about 0.7 of their shingles; every tenth has a partner just above 0.8. The constants are the production ones.
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    base, rows, planted = [word() for _ in range(300)], [], []
    for i in range(700):
        copy = list(base)
        for at in rng.sample(range(300), 13):
            copy[at] = word()
        rows.append((i, " ".join(copy)))
        if i % 10 == 0:
            for at in rng.sample(range(300), 7):
                copy[at] = word()
            rows.append((10_000 + i, " ".join(copy)))
            planted.append((i, 10_000 + i))
    sets = {d: plain_set(t, 4) for d, t in rows}
    linked = [(a, b) for a, b in planted if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    got = {r[0]: r[2] for r in run(spark, rows, 4)}
    assert len(linked) > 50 and sum(got[a] == got[b] for a, b in linked) >= 0.99 * len(linked)


def test_full_sets_are_made_and_components_joined_twice_whatever_the_levels(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(400):
        words = list(base)
        for at in rng.sample(range(60), 2):
            words[at] = f"x{rng.randrange(1000)}"
        docs.append((i, " ".join(words)))
    calls = {"full_sets": 0, "connected_components": 0}
    for name in calls:
        real = getattr(neardup, name)
        monkeypatch.setattr(neardup, name, lambda *a, real=real, name=name: (calls.__setitem__(name, calls[name] + 1), real(*a))[1])
    neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 4).count()
    assert max(calls.values()) <= 2
