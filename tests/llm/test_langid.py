import zlib

import numpy as np

from graphloom.llm import langid
from graphloom.llm.langid import ByteGRU, Sample, identify


def test_gradients_against_differences():
    net = ByteGRU(["a", "b", "c"], hidden=3, width=4, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    seqs, labels = [b"abc", b"q", "zé".encode()], np.array([0, 2, 1])
    _, g = net.gradients(seqs, labels)
    rng = np.random.default_rng(0)
    for k, v in net.p.items():
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in v.shape) if k != "emb" else (int(rng.choice(list(b"abcqz"))), int(rng.integers(0, 4)))
            old, eps = v[at], 1e-3
            v[at] = old + eps
            up, _ = net.gradients(seqs, labels)
            v[at] = old - eps
            down, _ = net.gradients(seqs, labels)
            v[at] = old
            assert abs((up - down) / (2 * eps) - g[k][at]) < 2e-3, (k, at)


def plain_pooled(net, text):
    """Position by position in double precision, window after window, as the module states it."""
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    h, sig = net.hidden, lambda x: 1 / (1 + np.exp(-x))

    def states(d, raw):
        out, s = [], np.zeros(h)
        for byte in raw:
            a, b = p["emb"][byte] @ p[f"{d}W"] + p[f"{d}b"], s @ p[f"{d}U"]
            z, r = sig(a[:h] + b[:h]), sig(a[h : 2 * h] + b[h : 2 * h])
            n = np.tanh(a[2 * h :] + r * (b[2 * h :] + p[f"{d}c"]))
            s = (1 - z) * n + z * s
            out.append(s)
        return out

    total = np.zeros(len(net.languages) + 1)
    for at in range(0, len(text), langid.WINDOW):
        stop = min(len(text), at + langid.WINDOW)
        lead = max(0, at - langid.CONTEXT)
        f = states("f", text[lead:stop])[at - lead :]
        b = states("b", text[at : stop + langid.CONTEXT][::-1])[::-1][: stop - at]
        for x, y in zip(f, b):
            e = np.exp(np.concatenate([x, y]) @ p["out"] + p["out_b"])
            total[:-1] += e / e.sum()
            total[-1] += 1
    return total


def test_windows_against_a_plain_reading():
    net = ByteGRU(["a", "b", "c"], hidden=4, width=4)
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (1, 0, 255, 256, 257, 260, 300, 511, 513, 1500)]
    together = net.pooled(texts)
    assert together[:, -1].tolist() == [len(t) for t in texts]
    for i, t in enumerate(texts):
        assert np.allclose(together[i], plain_pooled(net, t), atol=1e-3)
        assert np.allclose(net.pooled([t])[0], together[i], atol=1e-3)


def test_context_crosses_words():
    net = ByteGRU(["a", "b"], hidden=4, width=4, seed=5)
    both, one, two = net.pooled([b"chat noir", b"chat ", b"noir"])
    assert abs(both[0] - one[0] - two[0]) > 1e-4


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    got = {r.doc_id: r for r in identify(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert got.keys() == truth.keys()
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = [d for d in got if got[d].held_out]
    assert sum(got[d].lang_pred == truth[d] for d in held) / len(held) >= 0.98


def test_odd_rows(spark):
    rows = [(i, f"the and of was {i}", "en") for i in range(12)] + [(20 + i, f"der und die zu {i}", "de") for i in range(12)]
    odd = [(100, None, "en"), (101, "", None), (102, "12 34 !!", "de"), (103, "the", None), (None, "und die", None), (103, "the", None), (104, "the" * 3000, None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").selectExpr("*", "1 as score")
    got = identify(df, Sample(10), steps=60).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    assert [(by[k].lang_pred, by[k].score) for k in (100, 101, 102)] == [("und", 0.0)] * 3
    assert by[103].lang_pred == "en" and by[104].lang_pred in ("en", "de")
    assert identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in identify(df.withColumn("lang", df.lang.cast("string")).replace({"en": None, "de": None}, subset=["lang"])).collect()} == {"und"}
