import random
from fractions import Fraction

import duckdb
import pytest

from graphloom.llm.mixing import LEVELS, Mixture, budgets, mixed, mixed_documents, oracle_sql


def poured(total, nodes):
    """Water filling by rounds: nodes are (name, weight, supply)."""
    given, open_, left = {}, sorted(nodes, key=lambda x: (x[2] / x[1], x[0])), total
    while open_:
        weights = sum(w for _, w, _ in open_)
        name, w, supply = open_[0]
        if supply * weights <= left * w:
            given[name], left = supply, left - supply
            open_.pop(0)
        else:
            return given | {n: min(s, int(Fraction(left * w, weights))) for n, w, s in open_}
    return given


def brute_budgets(sizes, m):
    supply = lambda *key: sum(t * m.epochs for k, t in sizes.items() if k[: len(key)] == key)
    weight = lambda level, name: getattr(m, level).get(name, 1)
    out = {}
    top = poured(sum(sizes.values()) * m.budget_percent // 100, [(d, weight("domain", d), supply(d)) for d in {k[0] for k in sizes}])
    for d, a in top.items():
        for lang, b in poured(a, [(x, weight("lang", x), supply(d, x)) for x in {k[1] for k in sizes if k[0] == d}]).items():
            for s, c in poured(b, [(x, weight("source", x), supply(d, lang, x)) for x in {k[2] for k in sizes if k[:2] == (d, lang)}]).items():
                out[d, lang, s] = c
    return out


@pytest.mark.parametrize("seed", range(6))
def test_budgets_against_rounds(spark, seed):
    rng = random.Random(seed)
    sizes = {(f"d{rng.randrange(3)}", rng.choice("ab"), f"s{rng.randrange(6)}"): rng.choice([0, 1, 7, 100, 5000]) for _ in range(14)}
    m = Mixture(domain={"d0": 5}, lang={"a": 3}, source={"s1": 9, "s2": 2}, budget_percent=rng.choice([10, 60, 190, 200, 500]), epochs=2)
    df = spark.createDataFrame([(*k, t) for k, t in sizes.items()], "domain string, lang string, source string, tokens long")
    got = {tuple(r[k] for k in LEVELS): r.given for r in budgets(df, m).collect()}
    assert got == brute_budgets(sizes, m)


def documents(spark, seed=0, n=400):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 40])), rng.choice(["en", "en", "de", None]), rng.choice(["src0", "src0", "src1", "src12", "web", None])) for i in range(n)]
    rows += [(5000, None, "en", "src0"), (7, "twice over", "en", "src0"), (7, "twice over", "en", "src0"), (None, "no id", "de", "src1")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize("percent", [5, 60, 130, 400])
def test_against_sql(spark, percent):
    docs = documents(spark)
    m = Mixture(lang={"en": 3}, domain={"d0": 2}, budget_percent=percent)
    got = sorted((tuple(r) for r in mixed(docs.selectExpr("*", "1 as copies", "2 as domain"), m).collect()), key=str)
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    want = sorted(con.sql("SELECT doc_id, domain, lang, source, n_tokens, copies FROM (" + oracle_sql(m) + ")").fetchall(), key=str)
    assert got == want
    taken = sum(r[4] * r[5] for r in got)
    assert taken >= sum(r[4] for r in got) * min(percent, 200) // 100 - 60


def test_documents_are_repeated(spark):
    docs = documents(spark)
    m = Mixture(budget_percent=150)
    copies = {r.doc_id: r.copies for r in mixed(docs, m).collect() if r.doc_id != 7}
    out = mixed_documents(docs, m)
    assert out.columns == docs.columns
    n = {}
    for r in out.collect():
        n[r.doc_id] = n.get(r.doc_id, 0) + 1
    assert all(n.get(d, 0) == c for d, c in copies.items())
    assert mixed(docs.limit(0), m).count() == 0 and mixed_documents(docs.limit(0), m).count() == 0
