import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest

from graphloom.llm import resampling
from graphloom.llm.common import ByKey
from graphloom.llm.resampling import Resampling, bucket_counts, count_matrix, resample

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SMALL = Resampling(max_n=2, buckets=50, least_words=3, percent=40)


def plain(docs, target, spec):
    def features(text):
        words = WORD.findall((text or "").translate(UPPER))
        return len(words), [" ".join(words[i : i + n]) for n in range(1, spec.max_n + 1) for i in range(len(words) - n + 1)]

    slot = lambda f: zlib.crc32(f.encode()) % spec.buckets
    s, t = Counter(slot(f) for _, x in docs for f in features(x)[1]), Counter(slot(f) for x in target for f in features(x)[1])
    all_s, all_t = sum(s.values()) + spec.buckets, sum(t.values()) + spec.buckets
    rows = []
    for doc_id, text in docs:
        n, found = features(text)
        weight = sum(math.floor(1000 * math.log(((t[slot(f)] + 1) * all_s) / ((s[slot(f)] + 1) * all_t))) for f in found)
        h = int(hashlib.sha256(f"{spec.seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in rows if r[4] >= spec.least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], -r[1]))
    k = spec.percent * len(able) // 100
    ranks = {id(r): i for i, r in enumerate(able[:k], 1)}
    return sorted((tuple(r[:4]) + (ranks.get(id(r)),) for r in rows), key=repr)


DOCS = [(1, "The cat sat, THE CAT."), (2, None), (3, ""), (4, "one two"), (5, "straße été naïve ÀB cat"), (6, "a b c d e f g"), (6, "a b c d e f g"), (7, "the cat sat on the mat\x00again"), (None, "no id for this text"), (8, "!!! ..."), (9, "cat 12 x7 cat 12")]


def test_like_a_plain_version_with_nulls_ties_repeats_and_clashing_columns(spark):
    docs = spark.createDataFrame([(d, x, 1, "w") for d, x in DOCS], "doc_id long, text string, rank int, weight string")
    target = spark.createDataFrame([("the cat", 1), (None, 2), ("sat on", 3)], "text string, bucket int")
    got = resample(docs, target, SMALL)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(DOCS, ["the cat", None, "sat on"], SMALL)


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample(none, docs, SMALL).count() == 0
    assert sorted(map(tuple, resample(docs, none, SMALL).collect()), key=repr) == plain(DOCS, [], SMALL)


@pytest.mark.parametrize("max_n", [1, 2, 3])
def test_long_texts_are_read_in_slices_that_lose_no_feature(max_n):
    words = [f"w{i % 977}" for i in range(400_000)]
    n, counts = bucket_counts(" ".join(words).encode(), max_n, ByKey(lambda f: zlib.crc32(f) % 97))
    wanted = Counter(zlib.crc32(" ".join(words[i : i + k]).encode()) % 97 for k in range(1, max_n + 1) for i in range(len(words) - k + 1))
    assert n == len(words) and counts == wanted


def test_matrix_is_made_of_bounded_blocks(spark):
    docs = spark.createDataFrame([(i, f"word{i} common") for i in range(1200)], "doc_id long, text string").coalesce(1)
    blocks = count_matrix(docs, "doc_id", Resampling()).collect()
    assert [len(b.doc_ids) for b in blocks] == [500, 500, 200]
    assert all(b.indptr[-1] == len(b.indices) == len(b.counts) and len(b.indptr) == len(b.doc_ids) + 1 for b in blocks)


def test_rank_numbers_over_several_ranges(spark):
    docs = [(i, f"alpha beta w{i % 7}") for i in range(300)]
    got = resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame([("w3",)], "text string"), Resampling(least_words=3, percent=50))
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, ["w3"], Resampling(least_words=3, percent=50))


def test_like_its_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(con.sql(resampling.oracle_sql()).fetchall(), key=repr)
