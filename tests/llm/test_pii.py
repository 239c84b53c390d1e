import hashlib
import itertools
import random
import re

import numpy as np

from graphloom.llm import pii
from graphloom.llm.pii import KINDS, Field, Graph, base_spans, detect, find_spans, redact, redacted

PLAIN = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain(text):
    out = []
    for k, p in enumerate(PLAIN):
        for m in re.finditer(p, text or ""):
            digits = re.sub(r"\D", "", m[0])
            d = [int(x) * (1 + i % 2) for i, x in enumerate(reversed(digits))]
            ok = (True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 16 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in d) % 10 == 0, 8 <= len(digits) <= 15)[k]
            if ok:
                out.append((k, m.start(), m.end()))
    return out


def test_base_against_plain_patterns():
    rng = random.Random(1)
    parts = ["a.b", "@", "@x", ".com", "-", ".", " ", "+1 (523) 555-7040", "1.2.3.4", "999", "256", "0", "4539 1488 0343 6467", "4539148803436467", "é", "+", "(", "12345678", "\n", "x_y%", "007"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert base_spans(text) == plain(text), repr(text)
    assert base_spans(None) == base_spans("") == []


def test_long_runs_are_linear():
    for run in ("a" * 200_000, "7" * 200_000, "a@" * 100_000, "1." * 100_000, "+1" * 100_000, "7 " * 100_000):
        base_spans(run)
        find_spans(Field.fresh(), [run[:20_000]])


def test_beliefs_are_exact_on_trees():
    rng = np.random.default_rng(0)
    g = Graph()
    g.add([("a1", "", "", False, -1), ("b2", "", "", True, -1), ("c3", "", "", True, -1), ("a1", "", "", False, -1)])
    assert g.chain == [(0, 1), (1, 2)] and g.skip == [(0, 3)]
    f = Field(rng.standard_normal((pii.FEATURES, 5)), rng.standard_normal((2, 5, 5)))
    unary = f.weights[np.array(g.feats)].sum(1)
    want, total = np.zeros((4, 5)), 0
    for y in itertools.product(range(5), repeat=4):
        w = np.exp(sum(unary[i, y[i]] for i in range(4)) + f.pairs[0][y[0], y[1]] + f.pairs[0][y[1], y[2]] + f.pairs[1][y[0], y[3]])
        total += w
        for i in range(4):
            want[i, y[i]] += w
    pii.SWEEPS, old = 60, pii.SWEEPS
    got, _ = f.beliefs(g, clamp=False)
    pii.SWEEPS = old
    assert np.allclose(got, want / total, atol=1e-6)


def trained():
    rng = random.Random(3)
    g = Graph()
    for _ in range(300):
        n = rng.randrange(10**9)
        text = rng.choice([f"mail us {n % 97}.x@host{n % 9}.example.com now", f"in {n % 2000} we had {n % 90} of 12.5 parts", f"call +1 ({n % 900 + 100}) 555-{n % 9000 + 1000} today", f"from 10.{n % 250}.{n % 99}.7 at 10:30"])
        g.add(pii._labelled(text, base_spans(text)))
    f = Field.fresh()
    f.fit(g)
    return f


def test_field_learns_and_spreads_labels():
    f = trained()
    plain_text = "in 1999 we had 14 of 12.5 parts at 10:30 and 300 more"
    assert find_spans(f, [plain_text]) == [([], [])]
    (base, added), = find_spans(f, ["call +15235557040 today, again 15235557040 or 1-523-555-7040."])
    assert [k for k, _, _ in base] == [3] and added
    assert {k for k, _, _ in added} == {3}


def test_detect_and_redact(spark):
    text = "Write to a.b@mail.example.com or +1 (523) 555-7040; card 4539 1488 0343 6467 from 10.0.0.255."
    rows = [(i, f"plain words {i}", "x") for i in range(30)] + [(100, text, "x"), (101, None, None), (102, "", None), (None, text, None), (100, text, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string").selectExpr("*", "cast(length(text) as long) as n_chars")
    got = detect(df).collect()
    assert len(got) == len(rows)
    for r in got:
        full = {100: text, None: text}.get(r.doc_id, f"plain words {r.doc_id}" if r.doc_id < 100 else "") if r.doc_id is not None else text
        base = plain(full)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for k, _, _ in base) for j in range(4)]
        line = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))
    out = redact(df)
    assert out.columns == df.columns
    texts = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert texts[100][0].startswith("Write to [EMAIL] or [PHONE]; card [CARD]") and texts[100][1] == len(texts[100][0])
    assert not base_spans(texts[100][0]) and texts[101] == (None, None) and texts[3][0] == "plain words 3"
    assert detect(df.limit(0)).count() == 0 and redact(df.limit(0)).count() == 0


def test_overlapping_spans_as_one():
    assert redacted("0123456789", [(0, 2, 6), (1, 4, 8), (2, 9, 10)]) == "01[EMAIL]8[CARD]"
    assert redacted("abc", []) == "abc" and redacted(None, []) is None


def test_labels_reach_dozens_of_mentions():
    first, more = "call +15235557040 today,", " again 15235557040 or" * 60
    for f in (Field.fresh(), trained()):
        for text in (first + more, more + " " + first + more):
            (base, added), = find_spans(f, [text])
            assert [k for k, _, _ in base] == [3]
            assert [k for k, _, _ in added] == [3] * text.count(" 15235557040")


def test_whole_words_stand_around_a_candidate():
    text = "x" * 70 + "  a@b.org " + " " * 50 + "y" * 90 + " z"
    ((_, _, before, after, _),) = pii.tokens_of(text)
    assert (before, after) == ("x" * 70, "y" * 90)
    assert pii.tokens_of("1")[0][2:4] == ("", "") and pii.tokens_of(" " * 100 + "1" + "\n" * 100)[0][2:4] == ("", "")


def test_a_document_is_judged_for_itself():
    field = pii.Field.fresh()
    texts = ["call +49 30 1234567 or 0301234567", None, "a@b.org a@b.org x1", " ".join(f"+49 30 12345{i % 7}7 n{i} 12345{i % 7}7" for i in range(300))]
    alone = [pii.judged_spans(field, [t])[0] for t in texts]
    assert pii.judged_spans(field, texts) == alone and all(done for _, _, done in alone)
