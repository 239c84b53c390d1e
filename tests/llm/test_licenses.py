import random

import duckdb
import pytest

from graphloom.llm.licenses import NOTICES, license_matches, oracle_sql


def both(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' as key", "1 as n")
    got = sorted(map(tuple, license_matches(df).collect()))
    con = duckdb.connect()
    con.register("documents", df.filter("doc_id is not null").toPandas())
    return got, sorted(con.sql(oracle_sql()).fetchall())


def test_against_exact_containment(spark):
    rng = random.Random(6)
    filler = ["lorem", "Ipsum", "dolor-sit", "amet,", "License", "under", "the", "été"]
    rows = []
    for i in range(150):
        words = [rng.choice(filler) for _ in range(rng.choice([0, 3, 40, 200]))]
        if i % 2:
            words[len(words) // 2 : 0] = rng.choice(list(NOTICES.values())).split()
        if i % 10 == 1:
            words = words[: len(words) // 2 + 4]
        rows.append((i, rng.choice([" ", "\n"]).join(words)))
    rows += [(900, None), (901, ""), (902, "five"), (903, NOTICES["mit"].upper()), (903, NOTICES["mit"]), (None, NOTICES["mit"]), (904, (NOTICES["mit"] + " ") * 2000)]
    got, want = both(spark, rows)
    assert got == want and {r[1] for r in got} >= {"mit", "gpl-3.0"}


def test_every_notice_finds_itself(spark):
    got, want = both(spark, [(i, v) for i, (_, v) in enumerate(sorted(NOTICES.items()))])
    assert got == want
    assert all((i, k) in {(r[0], r[1]) for r in got} for i, k in enumerate(sorted(NOTICES)))


def test_empty_and_refused(spark):
    assert both(spark, []) == ([], [])
    with pytest.raises(ValueError, match="fewer than 5"):
        license_matches(spark.createDataFrame([(1, "x")], "doc_id long, text string"), {"short": "two words"})


def test_no_python_in_the_plan(spark):
    plan = license_matches(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan
