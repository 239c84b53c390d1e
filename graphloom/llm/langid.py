"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a whole lower-cased text, forwards and
backwards, and labels every byte position with a distribution over the languages;
a document's distribution is the mean over all its positions.  So that texts of any
length are read in bounded memory and side by side, each layer starts ``CONTEXT``
bytes before the ``WINDOW`` positions that it labels at a time (the backward one
behind them); what lies further away has no bearing on a label.

The weights are learnt in numpy by backpropagation through time (Adam), on stretches
at random places of the whole texts of a bounded sample of labelled documents
(``Sample``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows

WINDOW = 256
CONTEXT = 32
STRETCH = 96  # bytes of a training sequence
TOGETHER = 1024  # windows read side by side
UNDETERMINED = "und"


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _padded(seqs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes by position (time first), and the lengths."""
    lengths = np.array([len(s) for s in seqs])
    width = int(lengths.max())
    flat = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in seqs), np.uint8).reshape(len(seqs), width)
    return np.ascontiguousarray(flat.T), lengths


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class ByteGRU:
    """Two gated recurrent layers in opposite directions and a softmax for each position."""

    def __init__(self, languages: list[str], hidden: int = 8, width: int = 12, seed: int = 7):
        self.languages, self.hidden = languages, hidden
        rng = np.random.default_rng(seed)
        normal = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        h, zero = hidden, lambda n: np.zeros(n, np.float32)
        self.p = {"emb": normal(256, width) * 4, "out": normal(2 * h, len(languages)), "out_b": zero(len(languages))}
        for d in "fb":
            self.p |= {f"{d}W": normal(width, 3 * h), f"{d}U": normal(h, 3 * h), f"{d}b": zero(3 * h), f"{d}c": zero(h)}

    def _run(self, d: str, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states by time; with ``keep`` also what backpropagation needs."""
        p, h = self.p, self.hidden
        table = p["emb"] @ p[f"{d}W"] + p[f"{d}b"]
        u, c = p[f"{d}U"], p[f"{d}c"]
        state = np.zeros((x.shape[1], h), np.float32)
        states, saved = np.empty((len(x), x.shape[1], h), np.float32), []
        for t, now in enumerate(x):
            a, b = table[now], state @ u
            zr = _sigmoid(a[:, : 2 * h] + b[:, : 2 * h])
            z, r, lin = zr[:, :h], zr[:, h:], b[:, 2 * h :] + c
            n = np.tanh(a[:, 2 * h :] + r * lin)
            if keep:
                saved.append((state, z, r, lin, n))
            states[t] = state = n + z * (state - n)
        return states, saved

    @staticmethod
    def _flipped(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each sequence reversed within its own length (an involution)."""
        t = np.arange(len(x))[:, None]
        index = np.where(t < lengths, lengths - 1 - t, t)
        return np.take_along_axis(x, index if x.ndim == 2 else index[:, :, None], 0)

    def _logits(self, d: str, flat: np.ndarray, first: np.ndarray, lead: np.ndarray, size: int) -> np.ndarray:
        """What one layer adds to the logits of ``size`` positions from each ``first`` on (d: f forwards, b
        backwards), after reading ``lead`` positions on the way there."""
        p, h, n, step = self.p, self.hidden, len(first), 1 if d == "f" else -1
        # sigmoid(x) is (tanh(x / 2) + 1) / 2; halves are taken out of the loop, and gates stand one below the other.
        halves = np.repeat(np.float32([0.5, 0.5, 1]), h)[:, None]
        table = np.ascontiguousarray((p["emb"] @ p[f"{d}W"] + p[f"{d}b"]).T * halves)
        u, c = np.ascontiguousarray(p[f"{d}U"].T * 0.5), 0.5 * p[f"{d}c"][:, None]
        weights = np.ascontiguousarray((p["out"][:h] if d == "f" else p["out"][h:]).T)
        state, out = np.zeros((h, n), np.float32), np.empty((size, len(weights), n), np.float32)
        x, gates = np.empty((3 * h, n), np.float32), np.empty((3 * h, n), np.float32)
        zr, z, r, new = gates[: 2 * h], gates[:h], gates[h : 2 * h], gates[2 * h :]
        longest = int(lead.max())
        uneven = bool((lead != longest).any())
        for t in range(-longest, size):
            np.take(table, np.take(flat, first + step * t, mode="clip"), 1, out=x, mode="clip")
            np.dot(u, state, out=gates)
            zr += x[: 2 * h]
            np.tanh(zr, out=zr)
            zr += 1
            new += c
            new *= r
            new += x[2 * h :]
            np.tanh(new, out=new)
            z *= 0.5
            state -= new
            state *= z
            state += new
            if t >= 0:
                np.dot(weights, state, out=out[t])
            elif uneven:
                state[:, lead < -t] = 0  # not begun yet
        return out

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """For each text the sum of its positions' distributions, then their number."""
        sizes = np.array([len(t) for t in texts], np.int64)
        flat, begins = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes
        out = np.zeros((len(texts), len(self.languages) + 1))
        count = -(-sizes // WINDOW)
        doc = np.repeat(np.arange(len(texts)), count)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
        stop = np.minimum(start + WINDOW, sizes[doc])
        order = np.argsort(stop - start, kind="stable")
        for at in range(0, len(order), TOGETHER):
            w = order[at : at + TOGETHER]
            size = (stop - start)[w]
            width = int(size[-1])
            f = self._logits("f", flat, (begins[doc] + start)[w], np.minimum(start[w], CONTEXT), width)
            b = self._logits("b", flat, (begins[doc] + stop)[w] - 1, np.minimum(sizes[doc[w]] - stop[w], CONTEXT), width)
            place = size[None, :] - 1 - np.arange(width)[:, None]
            f += b[::-1] if size[0] == width else np.take_along_axis(b, np.maximum(place, 0)[:, None, :], 0)
            f += self.p["out_b"][:, None]
            f -= f.max(1, keepdims=True)
            np.exp(f, out=f)
            f *= ((place >= 0) / f.sum(1))[:, None, :]
            np.add.at(out[:, :-1], doc[w], f.sum(0, dtype=np.float64).T)
        out[:, -1] = sizes
        return out

    def gradients(self, seqs: list[bytes], labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of the positions and its gradients, by backpropagation through time."""
        p, h = self.p, self.hidden
        x, lengths = _padded(seqs)
        back = self._flipped(x, lengths)
        f, f_saved = self._run("f", x, True)
        b, b_saved = self._run("b", back, True)
        both = np.concatenate([f, self._flipped(b, lengths)], 2)
        logits = both @ p["out"] + p["out_b"]
        e = np.exp(logits - logits.max(2, keepdims=True))
        probs = e / e.sum(2, keepdims=True)
        mask = (np.arange(len(x))[:, None] < lengths).astype(np.float32)
        total = mask.sum()
        rows = np.arange(len(seqs))
        loss = float(-(np.log(probs[:, rows, labels] + 1e-12) * mask).sum() / total)
        d_logits = probs.copy()
        d_logits[:, rows, labels] -= 1
        d_logits *= mask[:, :, None] / total
        g = {k: np.zeros_like(v) for k, v in p.items()}
        k = d_logits.shape[2]
        g["out"] = both.reshape(-1, 2 * h).T @ d_logits.reshape(-1, k)
        g["out_b"] = d_logits.sum((0, 1))
        d_both = d_logits @ p["out"].T
        for d, xs, saved, d_states in (("f", x, f_saved, d_both[:, :, :h]), ("b", back, b_saved, self._flipped(d_both[:, :, h:], lengths))):
            u, d_h = p[f"{d}U"], np.zeros((len(seqs), h), np.float32)
            d_table = np.zeros((256, 3 * h), np.float32)
            for t in range(len(xs) - 1, -1, -1):
                state, z, r, lin, n = saved[t]
                d_h = d_h + d_states[t]
                d_n = d_h * (1 - z) * (1 - n * n)
                d_zr = np.concatenate([d_h * (state - n) * z * (1 - z), d_n * lin * r * (1 - r)], 1)
                d_lin = d_n * r
                d_b = np.concatenate([d_zr, d_lin], 1)
                np.add.at(d_table, xs[t], np.concatenate([d_zr, d_n], 1))
                g[f"{d}U"] += state.T @ d_b
                g[f"{d}c"] += d_lin.sum(0)
                d_h = d_h * z + d_b @ u.T
            g[f"{d}b"] = d_table.sum(0)
            g[f"{d}W"] = p["emb"].T @ d_table
            g["emb"] += d_table @ p[f"{d}W"].T
        return loss, g

    def fit(self, texts: list[bytes], labels: list[int], steps: int = 300, batch: int = 128, rate: float = 0.01, seed: int = 11) -> list[float]:
        """Adam over random stretches of random texts, languages balanced; returns the losses."""
        rng = np.random.default_rng(seed)
        y = np.array(labels)
        groups = [np.flatnonzero(y == k) for k in range(len(self.languages))]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses = []
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(gp, batch // len(groups) + 1) for gp in groups if len(gp)])
            places = [int(rng.integers(0, max(1, len(texts[i]) - STRETCH + 1))) for i in pick]
            loss, g = self.gradients([texts[i][at : at + STRETCH] for i, at in zip(pick, places, strict=True)], y[pick])
            losses.append(loss)
            lr = rate * (1 - step / (steps + 1)) + 1e-4
            for k in self.p:
                m[k] += 0.1 * (g[k] - m[k])
                v2[k] += 0.01 * (g[k] * g[k] - v2[k])
                self.p[k] = (self.p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return losses


@dataclass(frozen=True)
class Sample:
    """The bounded sample that the network learns from: about ``documents`` rows of each
    language, drawn by a hash of their doc_id, with their whole texts."""

    documents: int = 600


def as_bytes(text: str | None) -> bytes:
    """The bytes to read of a text; none if it holds no letter."""
    return text.lower().encode("utf-8", "replace") if text and has_letter(text) else b""


def training_texts(labelled: DataFrame, sample: Sample) -> tuple[list[bytes], list[str]]:
    """Texts and their languages, from ``labelled(doc_id, text, lang)``."""
    counts = {r["lang"]: r["count"] for r in labelled.filter("lang is not null").groupBy("lang").count().collect()}
    if not counts:
        return [], []
    unit = (F.xxhash64(F.lit(17), "doc_id") % (1 << 20) + (1 << 20)) / (1 << 21)
    share = F.coalesce(*(F.when(F.col("lang") == k, min(1.0, sample.documents / n)) for k, n in sorted(counts.items())))
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (unit < share)).select("doc_id", "lang", "text").collect()
    pairs = [(as_bytes(r["text"]), r["lang"]) for r in sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["lang"], r["text"]))]
    pairs = [(t, k) for t, k in pairs if t]
    return [t for t, _ in pairs], [k for _, k in pairs]


def train(labelled: DataFrame, sample: Sample = Sample(), steps: int = 300) -> ByteGRU | None:  # noqa: B008
    """A network for the languages in ``labelled(doc_id, text, lang)``; None if it names none."""
    texts, langs = training_texts(labelled, sample)
    names = sorted(set(langs))
    if not names:
        return None
    net = ByteGRU(names)
    index = {k: i for i, k in enumerate(names)}
    net.fit(texts, [index[k] for k in langs], steps=steps)
    return net


def predict(docs: DataFrame, net: ByteGRU | None) -> DataFrame:
    """doc_id, lang_pred, score for each row of ``docs(doc_id, text)``.

    ``und`` with score 0 where the text is null or has no letter (or nothing was
    learnt).  Score: mean probability of the language over all positions.  Rows
    are neither dropped nor merged; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for all_rows in arrow_rows(batches, "doc_id", "text"):
            for at in range(0, len(all_rows), 250):
                rows = all_rows[at : at + 250]
                langs, scores = [UNDETERMINED] * len(rows), [0.0] * len(rows)
                if net:
                    totals = net.pooled([as_bytes(t) for _, t in rows])
                    for i, best in enumerate(totals[:, :-1].argmax(1)):
                        if totals[i, -1]:
                            langs[i], scores[i] = net.languages[best], round(min(1.0, totals[i, best] / totals[i, -1]), 6)
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out_column() -> F.Column:
    """crc32 of the doc_id as text, modulo 3, is 1 (never for a null doc_id)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, sample: Sample = Sample(), steps: int = 300) -> DataFrame:  # noqa: B008
    """Trains on the documents that are not held out, then predicts all."""
    net = train(docs.filter(~held_out_column()).select("doc_id", "text", "lang"), sample, steps)
    return predict(docs, net).select("doc_id", held_out_column().alias("held_out"), "lang_pred", "score")
