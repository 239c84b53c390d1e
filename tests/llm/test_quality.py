import math
import random

import numpy as np
import pytest

from graphloom.llm.quality import BUCKETS, Selection, calibrates, keep_quality, kth_largest, log_ratios, log_weight, ngram_buckets, select_quality


def brute_buckets(text):
    tokens, kind = [], None
    for byte in (text or "").encode():
        k = 0 if byte == 32 or 9 <= byte <= 13 else 1 if byte >= 128 or chr(byte).isalnum() or byte == 95 else 2
        if k and k == kind:
            tokens[-1] += bytes([byte])
        elif k:
            tokens.append(bytes([byte]))
        kind = k
    return [t.lower() for t in tokens]


def test_number_and_identity_of_n_grams():
    rng = random.Random(0)
    for _ in range(200):
        text = "".join(rng.choice(["a", "B", "é", " ", "!", "?", "7", "\n", "_"]) for _ in range(rng.randrange(25)))
        n = len(brute_buckets(text))
        assert len(ngram_buckets(text)) == max(0, 2 * n - 1)
    assert (ngram_buckets("The cat!!") == ngram_buckets(" the\nCAT !!")).all()
    assert ngram_buckets("x x y y")[4] == ngram_buckets("q q")[2]
    assert len(ngram_buckets(None)) == len(ngram_buckets(" \n ")) == 0


def corpus():
    rng = random.Random(8)
    good = ["river", "stone", "of", "the", "and", "light", "house", "walks"]
    rows, labels = [], []
    for i in range(240):
        bad = i % 6 == 0
        words = [rng.choice(good) + ("###" if bad else "") for _ in range(rng.randrange(20, 60))]
        rows.append((i, " ".join(words), "en"))
        if i % 2 == 0:
            labels.append((i, 0 if bad else 1))
    return rows, labels


def frames(spark, rows, labels):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_ratios_and_selection_against_brute_force(spark):
    rows, labels = corpus()
    docs, lab = frames(spark, rows, labels)
    good = frozenset(d for d, q in labels if q and not calibrates(d))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for d, text, _ in rows:
        for b in ngram_buckets(text):
            raw[b] += 1
            target[b] += d in good
    want = np.log((target + 1) / (raw * target.sum() / raw.sum() + 1))
    assert np.allclose(log_ratios(docs, good), want)
    got = {r.doc_id: r for r in select_quality(docs, lab, Selection(keep=0.99)).collect()}
    for d, text, _ in rows:
        assert math.isclose(got[d].log_weight, want[ngram_buckets(text)].sum(), abs_tol=1e-9)
    clean = [r.kept for d, r in got.items() if d % 6]
    assert sum(clean) >= 0.97 * len(clean) and not any(r.kept for d, r in got.items() if d % 6 == 0)
    scores = sorted((r.score for r in got.values()), reverse=True)
    k = sum(r.kept for r in got.values())
    assert all(r.kept == (r.score >= scores[k - 1]) for r in got.values())


def test_weight_of_a_very_long_text_is_the_whole_sum():
    ratios = np.random.default_rng(1).normal(size=BUCKETS)
    once, twice = log_weight(ratios, "river stone of the"), log_weight(ratios, "river stone of the " * 60_000)
    between = ratios[ngram_buckets("the river")[2]]
    assert twice[1] == 2 * 240_000 - 1 and math.isclose(twice[0], 60_000 * once[0] + 59_999 * between, rel_tol=1e-6)


def test_noise_is_gumbel(spark):
    docs, lab = frames(spark, [(i, "", "x") for i in range(4000)], [(0, 1)])
    noise = [r.score - r.log_weight for r in select_quality(docs, lab).collect()]
    assert abs(np.mean(noise) - 0.5772) < 0.1 and abs(np.std(noise) - math.pi / math.sqrt(6)) < 0.1


def test_keep_returns_whole_rows(spark):
    rows, labels = corpus()
    docs, lab = frames(spark, rows + [(None, "the river", None), (900, None, None), (900, None, None)], labels)
    docs = docs.selectExpr("*", "1 as score", "array(doc_id) as kept")
    out = keep_quality(docs, lab)
    assert out.columns == docs.columns
    flags = select_quality(docs, lab)
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r.doc_id) for r in flags.filter("kept").collect())
    assert keep_quality(docs.limit(0), lab).count() == 0
    assert keep_quality(docs, lab.limit(0)).count() == docs.count()


@pytest.mark.parametrize("k", [0, 1, 17, 500, 999, 1000, 2000])
def test_kth_largest(spark, k):
    rng = random.Random(k)
    values = [rng.choice([rng.gauss(0, 1), 5.0, -1e9, rng.random() * 1e-9]) for _ in range(1000)]
    got = kth_largest(spark.createDataFrame([(v,) for v in values], "v double"), "v", k, collect=20)
    assert got == (float("inf") if k == 0 else sorted(values, reverse=True)[min(k, 1000) - 1])
