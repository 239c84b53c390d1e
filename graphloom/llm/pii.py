"""Personal data: exact patterns, and a skip-chain conditional random field that adds to them.

The patterns (email, ip, card, phone) give the base spans.  The field is over the
tokens that may be part of personal data, those with a digit or an @ (any other
token is O by definition, and cuts the chain).  Neighbouring tokens share a
transition potential; tokens of a document that are equal, or have the same seven
digits or more, each share a skip potential with one of them, their hub: the first,
or where labels are to spread the first that is observed, so that a label reaches
every mention in one step and however many there are.  Loopy belief propagation
passes messages over both kinds of edges, all documents of a batch at once, until
they stop changing; the tokens of base spans are observed, so their labels spread
to repeated and similar tokens.  Tokens whose belief in a label reaches ``CERTAIN`` add spans.

Weights are learnt in numpy from a bounded sample of documents (``Sample``), whose
base spans are the labels; the gradient is what is observed less what the beliefs
expect.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_rows, gives_back

KINDS = ("email", "ip", "card", "phone")
LABELS = ("o", *KINDS)
FEATURES = 1 << 12
CERTAIN = 0.9
SWEEPS = 1000  # a guard against messages that never settle; documents it stops are reported
SETTLED = 1e-6
AGREE = 8.0  # what equal or similar tokens gain from equal labels, before learning

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CANDIDATE = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")
_EDGE = "\"'.,;:!?()[]{}<>|"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > end and (text[first - 1].isascii() and (text[first - 1].isalnum() or text[first - 1] in "._%+-")):
            first -= 1
        m = _DOMAIN.match(text, at + 1) if first < at else None
        if m:
            yield first, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind then start."""
    if not text or not _CANDIDATE.search(text):
        return []
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def _word_before(text: str, at: int) -> str:
    """The whole word before a place, however far and long."""
    n = 40
    while True:
        part = text[max(0, at - n) : at]
        words = part.split()
        if at <= n or words and (len(words) > 1 or part[0].isspace()):
            return words[-1] if words else ""
        n *= 4


def _word_after(text: str, at: int) -> str:
    n = 40
    while True:
        part = text[at : at + n]
        words = part.split()
        if at + n >= len(text) or words and (len(words) > 1 or part[-1].isspace()):
            return words[0] if words else ""
        n *= 4


def tokens_of(text: str | None) -> list[tuple[int, int, str, str, bool]]:
    """(start, end, word before, word after, next to the token before) of each candidate, its edges' signs left out."""
    if not text or not _CANDIDATE.search(text):
        return []
    out, last = [], -1
    for m in _TOKEN.finditer(text):
        raw, a = m[0], m.start()
        core = raw.strip(_EDGE)
        shift = raw.find(core) if core else 0
        joined = last >= 0 and text[last:a].isspace()
        out.append((a + shift, a + shift + len(core or raw), _word_before(text, a), _word_after(text, m.end()), joined))
        last = m.end()
    return out


def _features(word: str, before: str, after: str) -> list[int]:
    shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"\d", "9", word))
    digits = sum(map(str.isdigit, word))
    names = ["1", f"s{shape}", "r" + re.sub(r"9+", "9", shape), f"d{min(digits, 20)}", f"b{before.strip(_EDGE).lower()}", f"a{after.strip(_EDGE).lower()}", f"p{word[:1]}", f"@{'@' in word}{word.count('.') > 2}"]
    return [zlib.crc32(n.encode("utf-8", "replace")) % FEATURES for n in names]


class Graph:
    """The tokens of many documents as one field."""

    def __init__(self) -> None:
        self.feats: list[list[int]] = []
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []
        self.observed: list[int] = []
        self.document: list[int] = []
        self.documents = 0
        self.unsettled: set[int] = set()

    def add(self, tokens: list[tuple[str, str, str, bool, int]], anchored: bool = False) -> None:
        """One document's (word, before, after, joined, label or -1); anchored: hubs are observed tokens, if there are any."""
        hub: dict[str, int] = {}
        named: list[tuple[int, set[str]]] = []
        for word, before, after, joined, label in tokens:
            i = len(self.feats)
            self.feats.append(_features(word, before, after))
            self.observed.append(label)
            self.document.append(self.documents)
            if joined:
                self.chain.append((i - 1, i))
            digits = re.sub(r"\D", "", word)
            keys = {f"w{word.lower()}"} | ({f"d{digits}"} if len(digits) >= 7 else set())
            named.append((i, keys))
            for k in keys:
                if k not in hub or (anchored and label > 0 and self.observed[hub[k]] <= 0):
                    hub[k] = i
        for i, keys in named:
            self.skip += sorted({(min(i, hub[k]), max(i, hub[k])) for k in keys if hub[k] != i})
        self.documents += 1

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Ends of all edges, and the kind (0 chain, 1 skip)."""
        both = np.array(self.chain + self.skip, np.int64).reshape(-1, 2)
        return both, np.repeat([0, 1], [len(self.chain), len(self.skip)])


@dataclass
class Field:
    """Weights by feature and label, and the log potentials of chain and skip edges."""

    weights: np.ndarray
    pairs: np.ndarray

    @classmethod
    def fresh(cls) -> Field:
        return cls(np.zeros((FEATURES, len(LABELS))), np.stack([np.zeros((len(LABELS),) * 2), AGREE * np.eye(len(LABELS))]))

    def beliefs(self, graph: Graph, clamp: bool) -> tuple[np.ndarray, np.ndarray]:
        """Beliefs of tokens and of edges, after damped messages have settled."""
        unary = self.weights[np.array(graph.feats)].sum(1)
        if clamp:
            label = np.array(graph.observed)
            known = np.flatnonzero(label > 0)
            unary[known, label[known]] += 1e8  # more than any number of neighbours can outvote
        ends, kind = graph.edges()
        k = len(LABELS)
        there, back = np.zeros((len(ends), k)), np.zeros((len(ends), k))
        pot = self.pairs[kind]
        lse = lambda x, axis: np.log(np.exp(x - x.max(axis, keepdims=True)).sum(axis)) + x.max(axis)
        belief = unary
        owner = np.array(graph.document, np.int64)[ends[:, 0]]
        live = np.arange(len(ends))  # edges of documents whose messages still change: none waits for another document
        for _ in range(SWEEPS):
            if not len(live):
                break
            e, mine = ends[live], owner[live]
            new_there, new_back = lse((belief[e[:, 0]] - back[live])[:, :, None] + pot[live], 1), lse((belief[e[:, 1]] - there[live])[:, None, :] + pot[live], 2)
            new_there -= new_there.max(1, keepdims=True)
            new_back -= new_back.max(1, keepdims=True)
            change = np.zeros(graph.documents)
            np.maximum.at(change, mine, np.maximum(np.abs(new_there - there[live]).max(1), np.abs(new_back - back[live]).max(1)))
            there[live], back[live] = 0.5 * (there[live] + new_there), 0.5 * (back[live] + new_back)
            belief = unary.copy()
            np.add.at(belief, ends[:, 1], there)
            np.add.at(belief, ends[:, 0], back)
            live = live[change[mine] >= SETTLED]
        graph.unsettled = set(owner[live].tolist())
        p = np.exp(belief - belief.max(1, keepdims=True))
        e = (belief[ends[:, 0]] - back)[:, :, None] + pot + (belief[ends[:, 1]] - there)[:, None, :]
        e = np.exp(e - e.max((1, 2), keepdims=True))
        return p / p.sum(1, keepdims=True), e / e.sum((1, 2), keepdims=True)

    def fit(self, graph: Graph, rounds: int = 60, rate: float = 0.5, decay: float = 1e-3) -> None:
        """Gradient ascent (scaled by past gradients) on the likelihood of the observed labels."""
        if not graph.feats:
            return
        feats, label = np.array(graph.feats), np.maximum(0, np.array(graph.observed))
        ends, kind = graph.edges()
        past_w, past_p = np.full_like(self.weights, 1e-6), np.full_like(self.pairs, 1e-6)
        for _ in range(rounds):
            tokens, edges = self.beliefs(graph, clamp=False)
            delta = -tokens
            delta[np.arange(len(label)), label] += 1
            gw, gp = -decay * self.weights, -decay * self.pairs
            for c in range(feats.shape[1]):
                np.add.at(gw, feats[:, c], delta)
            for t in (0, 1):
                of = kind == t
                np.add.at(gp[t], (label[ends[of, 0]], label[ends[of, 1]]), 1)
                gp[t] -= edges[of].sum(0)
            past_w += gw * gw
            past_p += gp * gp
            self.weights = self.weights + rate * gw / np.sqrt(past_w)
            self.pairs = self.pairs + 0.2 * rate * gp / np.sqrt(past_p)


@dataclass(frozen=True)
class Sample:
    """The bounded sample to learn from: about ``documents`` rows, drawn by a hash of doc_id,
    with all their candidate tokens."""

    documents: int = 6000


def _labelled(text: str, base: list[tuple[int, int, int]]) -> list[tuple[str, str, str, bool, int]]:
    """The candidates of a text with the label of the base span that covers them, else -1."""
    spans = sorted((a, b, k) for k, a, b in base)
    out, i = [], 0
    for a, b, before, after, joined in tokens_of(text):
        while i < len(spans) and spans[i][1] <= a:
            i += 1
        hit = next((k + 1 for x, y, k in spans[i : i + 4] if x < b and y > a), -1)
        out.append((text[a:b], before, after, joined, hit))
    return out


def train(docs: DataFrame, sample: Sample = Sample()) -> Field:  # noqa: B008
    """A field learnt from ``docs(doc_id, text)``."""
    share = min(1.0, sample.documents / max(1, docs.count()))
    unit = (F.xxhash64(F.lit(31), "doc_id") % (1 << 20) + (1 << 20)) / (1 << 21)

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in arrow_rows(batches, "doc_id", "text"):
            found = [(d, json.dumps(t)) for d, t in ((d, _labelled(x, base_spans(x))) for d, x in rows if x) if t]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([t for _, t in found], pa.string())], names=["doc_id", "tokens"])

    picked = docs.select("doc_id", "text").filter((unit < share) & F.col("text").rlike("[0-9@]")).mapInArrow(run, "doc_id long, tokens string").collect()
    graph, field = Graph(), Field.fresh()
    for r in sorted(picked, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["tokens"])):
        graph.add([tuple(t) for t in json.loads(r["tokens"])])
    field.fit(graph)
    return field


def find_spans(field: Field, texts: list[str | None]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text its base spans and those that the field adds."""
    return [(base, added) for base, added, _ in judged_spans(field, texts)]


def judged_spans(field: Field, texts: list[str | None]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], bool]]:
    """The spans of find_spans() and whether the messages of the text have settled."""
    graph, places, bases, number = Graph(), [], [], {}
    for n, text in enumerate(texts):
        base = base_spans(text)
        bases.append(base)
        if text:
            labelled = _labelled(text, base)
            number[n] = graph.documents
            graph.add(labelled, anchored=True)
            places += [(n, a, b, joined, t[4]) for (a, b, _, _, joined), t in zip(tokens_of(text), labelled, strict=True)]
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if places:
        belief, _ = field.beliefs(graph, clamp=True)
        best, sure = belief.argmax(1), belief.max(1)
        for i, (n, a, b, joined, known) in enumerate(places):
            if known < 0 and best[i] and sure[i] >= CERTAIN:
                kind, mine = int(best[i]) - 1, added[n]
                if joined and mine and mine[-1][0] == kind and places[i - 1][2] == mine[-1][2]:
                    mine[-1] = (kind, mine[-1][1], b)
                else:
                    mine.append((kind, a, b))
    return [(b, sorted(x), number.get(n) not in graph.unsettled) for n, (b, x) in enumerate(zip(bases, added, strict=True))]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, sample: Sample = Sample()) -> DataFrame:  # noqa: B008
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, settled for each row of ``docs(doc_id, text)``.

    The counts and the digest are of the base spans, ``spans`` holds all; ``settled``
    is false if the messages of the document still changed when they were stopped.  A
    document is judged for itself, whatever others it is read with.  A null
    text counts as empty.  Rows are neither dropped nor merged; other columns are
    ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, sample))

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in arrow_rows(batches, "doc_id", "text"):
            for at in range(0, len(rows), 200):
                some = rows[at : at + 200]
                judged = judged_spans(shared.value, [t for _, t in some])
                found = [(base, added) for base, added, _ in judged]
                counts = [[sum(k == kind for k, _, _ in base) for base, _ in found] for kind in range(len(KINDS))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d for d, _ in some], pa.int64()), *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b, _ in found]), pa.array([_joined(sorted(b + x)) for b, x in found]), pa.array([done for _, _, done in judged], pa.bool_())],
                    names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "settled"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, settled boolean")


def redacted(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans as one."""
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame, sample: Sample = Sample()) -> DataFrame:  # noqa: B008
    """The rows of ``docs`` with personal data replaced in ``text``; all columns stay, and
    ``n_chars``, if there, counts the new text (null stays null)."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, sample))
    columns, at = docs.columns, docs.columns.index("text")

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 200):
                part = batch.slice(first, 200)
                texts = part.column(at).to_pylist()
                new = [redacted(t, b + x) for t, (b, x) in zip(texts, find_spans(shared.value, texts), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == at else part.column(i) for i in range(len(columns))], names=columns)

    out = docs.mapInArrow(run, T.StructType(docs.schema.fields))
    if "n_chars" not in columns:
        return out
    kind = docs.schema["n_chars"].dataType
    return out.select(*(F.when(F.col("n_chars").isNotNull() & F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(kind).alias("n_chars") if c == "n_chars" else F.col(c) for c in columns))
