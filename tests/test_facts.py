"""Facts kept between scans."""

import pytest

from graphloom.functions import lex
from graphloom.plans.scan import scan_graph
from graphloom.sources.facts import kept_facts

FILES = [("a.ts", "import './b'\nfetch('/api/a')\n"), ("b.ts", "const x: any = 1\n"), ("C.cs", "class C { }\n"), ("empty.ts", "// nothing\n"), ("gone.ts", None)]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_only_changed_files_are_lexed(spark, tmp_path):
    store, schema = str(tmp_path / "store"), "path string, content string"
    files = spark.createDataFrame(FILES, schema)
    first, n = kept_facts(files, store)
    assert n == 4 and rows(first) == rows(lex.facts(files))
    again, n = kept_facts(files, store)
    assert n == 0 and rows(again) == rows(lex.facts(files))
    changed = spark.createDataFrame([("a.ts", "fetch('/api/b')\n"), *FILES[1:3], ("new.ts", "import './a'\n")], schema)
    got, n = kept_facts(changed, store)
    assert n == 2 and rows(got) == rows(lex.facts(changed))
    _, n = kept_facts(files, store, architecture=True)
    assert n == 4
    none, n = kept_facts(files.limit(0), store)
    assert n == 0 and none.count() == 0


def test_rows_of_a_lost_batch_are_not_read(spark, tmp_path):
    store, files = str(tmp_path / "store"), spark.createDataFrame(FILES, "path string, content string")
    kept_facts(files.filter("path = 'a.ts'"), store)
    # A job that wrote its facts and was lost before it entered its files.
    stored = spark.read.parquet(f"{store}/facts").selectExpr("key", "'lost' as batch", "path", "fact", "ordinal", "name", "value").collect()
    spark.createDataFrame(stored, spark.read.parquet(f"{store}/facts").schema).write.mode("append").parquet(f"{store}/facts")
    got, n = kept_facts(files, store)
    assert n == 3 and rows(got) == rows(lex.facts(files))


@pytest.mark.parametrize("change", [False, True])
def test_a_second_scan_gives_the_same_graph(spark, tmp_path, change):
    root, store = tmp_path / "tree", str(tmp_path / "store")
    root.mkdir()
    for name, text in FILES[:4]:
        (root / name).write_text(text)
    scan_graph(spark, str(root), store=store)
    if change:
        (root / "b.ts").write_text("import './a'\n")
    kept, plain = scan_graph(spark, str(root), store=store), scan_graph(spark, str(root))
    assert rows(kept.edges) == rows(plain.edges) and rows(kept.nodes) == rows(plain.nodes)
