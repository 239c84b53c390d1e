import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import phrases
from graphloom.llm.phrases import Mining, collocations, prefix_counts, scored

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SMALL = Mining(least=3, top=40, word_slots=64, phrase_slots=256)
WHOLE = Mining(least=3, top=40, word_slots=1 << 20, phrase_slots=1 << 20)


def counted(docs, spec):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        for piece in re.split("[.,;:!?\n\v\f\r]", (text or "").translate(UPPER)):
            words = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(words)
            for size in range(1, spec.max_n + 1):
                f[lang or "und"].update(" ".join(words[i : i + size]) for i in range(len(words) - size + 1))
    return f, n


def plain(docs, spec):
    f, n = counted(docs, spec)
    out = []
    for lang, fs in f.items():
        candidates = {p: a for p, a in fs.items() if a >= spec.least and " " in p}
        rows = []
        for p, a in candidates.items():
            words = p.split(" ")
            if any(100 * b >= spec.within_percent * a and any(q.split(" ")[i : i + len(words)] == words for i in range(q.count(" ") + 2 - len(words))) for q, b in candidates.items() if q.count(" ") > p.count(" ")):
                continue
            score, _, l, r = min((2000000 * a // (fs[" ".join(words[:k])] + fs[" ".join(words[k:])]), k, fs[" ".join(words[:k])], fs[" ".join(words[k:])]) for k in range(1, len(words)))  # noqa: E741
            rows.append((-score, -a, p.encode(), (p, a, l, r, n[lang], score)))
        out += [(lang, i, *row) for i, (*_, row) in enumerate(sorted(rows)[: spec.top], 1)]
    return sorted(out)


def random_docs(seed):
    rng = random.Random(seed)
    words = ["the", "The", "of", "king", "a\x01b", "a", "\x00", "été", "straße", "<s>", "a-b", "…", "日本"]
    docs = [(" ".join(rng.choice(words) + rng.choice(["", "", "", "", ".", ",\t", "\n", " "]) for _ in range(rng.randrange(30))), rng.choice(["en", "de", None, "und"])) for _ in range(150)]
    return docs + [(None, "en"), ("", None), ("...", "en"), ("only", "fr")] + [("hot pair " + " ".join(rng.choice(words) for _ in range(3)), "en") for _ in range(200)]


@pytest.mark.parametrize("spec", [SMALL, WHOLE])
def test_like_a_plain_version_with_nulls_ties_repeats_and_clashing_columns(spark, spec):
    docs = random_docs(1)
    df = spark.createDataFrame([(*d, 5, "x") for d in docs], "text string, lang string, n int, phrase string").repartition(5)
    got = collocations(df, spec)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain(docs, spec)


def test_an_empty_table_gives_no_rows(spark):
    assert collocations(spark.createDataFrame([], "text string, lang string"), SMALL).count() == 0
    assert collocations(spark.createDataFrame([(None, None)], "text string, lang string"), SMALL).count() == 0


def test_a_very_long_text_is_read_in_slices(spark):
    rng = random.Random(2)
    text = " ".join(f"w{int(rng.paretovariate(0.7)) % 400}" + ("." if rng.random() < 0.1 else "") for _ in range(400_000))
    spec = Mining(least=30, top=500, phrase_slots=1 << 16)
    assert len(text) > 1 << 20
    assert sorted(map(tuple, collocations(spark.createDataFrame([(text, "en")], "text string, lang string"), spec).collect())) == plain([(text, "en")], spec)


def test_products_may_pass_64_bits(spark):
    a, l, r = 10**15, 3 * 10**15, 4 * 10**15 + 1  # noqa: E741
    found = spark.createDataFrame([("en", "x y", a), ("en", "x", l), ("en", "y", r), ("en", "x y z", a - 10**15 // 5), ("en", "z", l), ("en", "y z", a)], "lang string, phrase string, n long")
    got = {row.phrase: (row.score, row.l, row.r) for row in scored(found, Mining()).collect()}
    assert "x y" not in got and got["x y z"][0] == min(2000000 * (a - a // 5) // (l + a), 2000000 * (a - a // 5) // (a + l))


def test_one_stack_counts_all_prefixes():
    rows = sorted(Counter({"a b c": 2, "a b": 1, "a": 4, "a c": 3, "b": 1}).items(), reverse=True)
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(rows)), pa.array([s for s, _ in rows]), pa.array([n for _, n in rows])], names=["lang", "suffix", "n"])
    got = Counter()
    for out in prefix_counts(iter([batch.slice(0, 2), batch.slice(2)])):
        for r in out.to_pylist():
            got[r["phrase"]] += r["n"]
    assert got == {"a b c": 2, "a b": 3, "a": 10, "a c": 3, "b": 1}


def test_like_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    spec = Mining(least=5)
    got = collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"), spec)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(phrases.oracle_sql(spec)).fetchall())


def test_what_a_task_holds_does_not_grow_with_languages_and_tables_stay_bits():
    hashes = phrases._Hashes(100)
    words = [[f"{lang}{i}".encode() for i in range(60)] for lang in range(20)]
    first = [hashes(str(lang), w).tolist() for lang, w in enumerate(words)]
    assert sum(map(len, hashes.of.values())) <= 100
    assert [hashes(str(lang), w).tolist() for lang, w in enumerate(words)] == first
    often = np.random.default_rng(1).integers(0, 2, 1 << 12).astype(bool)
    (table,) = phrases._tables([np.packbits(often).tobytes()])
    assert table.nbytes == len(often) // 8
    found = np.arange(0, 1 << 20, 77, dtype=np.uint64) << np.uint64(5)
    assert (phrases._told(table, found) == often[phrases._slot(found, len(often))]).all()


def test_suffixes_come_out_of_the_tasks_of_a_language_and_not_of_every_file(spark, monkeypatch):
    rng = random.Random(3)
    docs = [(" ".join(rng.choice("abc") for _ in range(200)), lang) for _ in range(60) for lang in ("de", "en", "fr", None)]
    real, seen = phrases.suffixes, []
    monkeypatch.setattr(phrases, "suffixes", lambda *args: seen.append(real(*args)) or seen[-1])
    got = collocations(spark.createDataFrame(docs, "text string, lang string").repartition(60), WHOLE)
    assert sorted(map(tuple, got.collect())) == plain(docs, WHOLE)
    (rows,) = seen
    different = rows.groupBy("lang", "suffix").count().count()
    assert rows.count() < 4 * different  # 8 tasks for 4 languages; of 60 files each would give most of them again
