import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ["graph_nodes", "graph_edges", "orphans", "quality_scores", "module_graph_edges", "submap_nodes", "endpoint_link", "import_resolution", "finding_suppression", "graph_digest"]


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(str, df.astype(object).where(df.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", QUICK)
def test_query_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    assert rows(entry.queries()[name](spark, sf_dir).toPandas()) == rows(con.sql(entry.oracle_sql()[name]).df())


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
