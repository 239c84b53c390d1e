"""Phrase collocations by suffix sorting (suffix-sigma).

Every word position of a piece starts a suffix of at most ``max_n`` words.
Suffixes are shuffled by language and first word, sorted in reverse order, and one
stack of open prefixes counts all phrases in a single pass; every phrase is scored
by joining it with its parts afterwards.

Two things keep the shuffle small, and neither changes a count.  A task adds up
equal suffixes before it hands them on, texts are dealt by language first, so that
few tasks meet the same suffix, and a group of one first word is dealt
over ``salts`` parts whose counts are added again.  And as no phrase is more
frequent than the shorter ones in it, suffixes end before a phrase of fewer than
``max_n`` words that is certain to be too rare: tables of counters, one for each
number of words and each of a fixed size, to which phrases are hashed, say so.  A
shared counter can only be too high, so a full table lets suffixes through whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched, compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ByKey, Written, gives_back, spaced_slices

#: A-Z to a-z, the signs that end a piece to a full stop (which no word can hold), tab to space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 46 if c in b".,;:!?\n\v\f\r" else 32 if c == 9 else c for c in range(256))
_STOP = b"."
_CHUNK = 1 << 16
_STEP = np.uint64(0x9E3779B97F4A7C15)
_HELD = 400_000  # suffixes that a task holds, of all languages
_KNOWN = 1 << 18  # words whose hashes a task holds, of all languages
_WORDS = 1 << 25  # words of the texts that are dealt to a task, about


@dataclass(frozen=True)
class Mining:
    """``least``: occurrences a phrase needs; ``within_percent``: a phrase goes if a longer one around
    it has that share of its occurrences; ``top``: rows per language; ``word_slots``, ``phrase_slots``:
    counters of the table for words and of those for longer phrases (powers of two)."""

    max_n: int = 4
    least: int = 30
    within_percent: int = 80
    top: int = 2000
    salts: int = 32
    word_slots: int = 1 << 23
    phrase_slots: int = 1 << 25

    def slots(self, size: int) -> int:
        return self.word_slots if size == 1 else self.phrase_slots


PRODUCTION = Mining()


def _runs(batch: pa.RecordBatch, overlap: int, together: int = 1 << 19) -> Iterator[tuple[str, list[bytes], int]]:
    """(language, words and stops, how many of them are not new): the whole texts of a batch, short ones
    together, long ones a slice at a time; the last ``overlap`` words of a slice stand before the next."""
    rows_of: dict[str, list[int]] = {}
    for i, lang in enumerate(batch.column(0).to_pylist()):
        rows_of.setdefault(lang, []).append(i)

    def joined(rows: list[int]) -> Iterator[bytes]:
        held, size = [], 0
        for i in rows:
            held.append(batch.column(1)[i].as_py().translate(_FOLD))
            size += len(held[-1])
            if size >= together:
                yield _STOP.join([*held, b""])
                held, size = [], 0
        yield _STOP.join([*held, b""])

    for lang, rows in rows_of.items():
        before: list[bytes] = []
        for text in joined(rows):
            for words in spaced_slices(text.replace(_STOP, b" . ")):
                yield lang, before + words, len(before)
                before = (before + words)[-overlap:] if overlap else []
        yield lang, before + [_STOP] * overlap, len(before)


class _Hashes:
    """Hashes of words (0: stop), apart by language; what is held of all languages together is bounded."""

    def __init__(self, most: int = _KNOWN):
        self.of: dict[str, ByKey] = {}
        self.most = most

    def __call__(self, lang: str, words: list[bytes]) -> np.ndarray:
        if lang not in self.of:
            seed = xxhash.xxh64_intdigest(lang.encode())
            self.of[lang] = ByKey(lambda w: 0 if w == _STOP else xxhash.xxh64_intdigest(w, seed) | 1, self.most)
        out = np.fromiter(map(self.of[lang].__getitem__, words), np.uint64, len(words))
        if sum(map(len, self.of.values())) > self.most:
            self.of.clear()
        return out


def _slot(hashes: np.ndarray, slots: int) -> np.ndarray:
    return ((hashes >> np.uint64(7)) & np.uint64(slots - 1)).astype(np.int64)


def _grow(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of the phrases of one word more; ``words`` are the hashes of the words that come to them."""
    out = hashes[: len(words)] * _STEP + (words + (words << np.uint64(17)))
    return out ^ (out >> np.uint64(29))


def _open(words: np.ndarray, often: list[np.ndarray], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, whether it may be frequent) of the phrase of 1, 2, ... ``size`` words that starts at each position:
    those without a stop in which no shorter phrase, and for which no table that is there, says no."""
    hashes, fine = words, words != 0
    for n in range(1, size + 1):
        if n > 1:
            hashes = _grow(hashes, words[n - 1 :])
            fine = fine[:-1] & fine[1:]
        told = fine & _told(often[n - 1], hashes) if n <= len(often) else fine
        yield hashes, told
        fine = told


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def _tables(packed: list[bytes]) -> list[np.ndarray]:
    """The tables of bits as they were sent, eight counters to a byte."""
    return [np.frombuffer(b, np.uint8) for b in packed]


def _told(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Of each phrase whether its counter reached ``least``."""
    at = _slot(hashes, 8 * len(table))
    return (table[at >> 3] >> (~at & 7).astype(np.uint8) & 1).astype(bool)


def _add(table: np.ndarray, at: np.ndarray, least: int) -> None:
    """Counts the places in a table whose counters stop at ``least``."""
    places, n = np.unique(at, return_counts=True)
    table[places] = np.minimum(table[places] + n, least)


def survey(docs: DataFrame, spec: Mining, sizes: tuple[int, ...], known: list[bytes]) -> tuple[DataFrame, list[bytes]]:
    """(lang, n) rows, and ``known`` with a new table for each of ``sizes``: a bit for each counter, whether it reached ``least``.

    Counters stop at ``least``, so a byte or four hold one; they are added up
    chunk by chunk on the executors and come back as one bit each.  Where pairs are
    known already, words are counted as parts of pairs that may be frequent: a word in
    no frequent pair is in no candidate, nor a part of one.
    """
    dtype = np.uint8 if spec.least < 256 else np.uint32
    shared = docs.sparkSession.sparkContext.broadcast(known)
    chunks_of = {n: -(-spec.slots(n) // _CHUNK) for n in sizes}

    @gives_back
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = _tables(shared.value)
        tables = {n: np.zeros(spec.slots(n), dtype) for n in sizes}
        total: Counter = Counter()
        hashes = _Hashes()
        for batch in batches:
            for lang, words, old in _runs(batch, sizes[-1] - 1):
                of_words = hashes(lang, words)
                total[lang] += int(np.count_nonzero(of_words[old:]))
                for n, (found, fine) in enumerate(_open(of_words, often, sizes[-1]), 1):
                    new = max(0, old - n + 1)  # phrases before it were counted with the slice before
                    if n in tables and (n > 1 or not often):
                        _add(tables[n], _slot(found[new:][fine[new:]], spec.slots(n)), spec.least)
                    elif n == 2 and 1 in tables:
                        starts = new + np.flatnonzero(fine[new:])
                        _add(tables[1], _slot(of_words[np.concatenate((starts, starts + 1))], spec.slots(1)), spec.least)
        del hashes

        def rows() -> Iterator[tuple]:
            yield from ((-1, lang, k, None) for lang, k in total.items())
            parts = (tables[n][start : start + _CHUNK] for n in sizes for start in range(0, spec.slots(n), _CHUNK))
            yield from ((at, None, None, part.tobytes()) for at, part in enumerate(parts) if part.any())

        for some in batched(rows(), 64):
            chunk, lang, k, data = zip(*some, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int32()), pa.array(lang, pa.string()), pa.array(k, pa.int64()), pa.array(data, pa.binary())], names=["chunk", "lang", "n", "data"])

    @gives_back
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, chunk in enumerate(batch.column(0).to_pylist()):
                part = np.frombuffer(batch.column(1)[i].as_py(), dtype)
                sums[chunk] = np.minimum(sums[chunk].astype(np.uint32) + part, spec.least).astype(dtype) if chunk in sums else part
        for chunk, total in sums.items():
            bits = np.packbits(total >= spec.least).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([bits], pa.binary())], names=["chunk", "bits"])

    out = Written(docs.sparkSession, "phrases")
    counted = out.table(_texts(docs).mapInArrow(count, "chunk int, lang string, n long, data binary"), "counters")
    words = out.table(counted.filter("chunk < 0").groupBy("lang").agg(F.sum("n").alias("n")), "words")
    chunks = counted.filter("chunk >= 0").select("chunk", "data").repartition("chunk").mapInArrow(add, "chunk int, bits binary")
    bits = {chunk: bytes(b) for chunk, b in chunks.collect()}  # one bit a counter, whatever the data
    out.drop(counted)
    tables, at = dict(enumerate(known, 1)), 0
    for n in sizes:
        size = min(_CHUNK, spec.slots(n))
        tables[n] = b"".join(bits.get(c, bytes(size // 8)) for c in range(at, at + chunks_of[n]))
        at += chunks_of[n]
    return words, [tables[n] for n in sorted(tables)]


def by_language(docs: DataFrame, words: DataFrame) -> DataFrame:
    """The documents dealt in ranges of their language, as many to a task: a frequent suffix comes out of every task
    that reads its language, so these are few, whatever files the texts stand in; a large language fills several."""
    total = words.agg(F.sum("n")).first()[0] or 0  # one number
    parts = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-total // _WORDS))
    return docs.select("lang", "text", F.monotonically_increasing_id().alias("at")).repartitionByRange(parts, F.coalesce(F.col("lang").cast("string"), F.lit("und")), "at")


def suffixes(docs: DataFrame, spec: Mining, often_packed: list[bytes]) -> DataFrame:
    """lang, first, suffix (words joined by spaces), n: the suffixes of every word position, ended
    before the first phrase that is too rare, equal ones of a task added up."""
    shared = docs.sparkSession.sparkContext.broadcast(often_packed)

    def rows(lang: str, counts: Counter) -> Iterator[pa.RecordBatch]:
        keys = list(counts)
        for at in range(0, len(keys), 50_000):
            part = keys[at : at + 50_000]
            texts = [k.decode("utf-8", "replace") for k in part]
            columns = [[lang] * len(part), [t.split(" ", 1)[0] for t in texts], texts]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array([counts[k] for k in part], pa.int64())], names=["lang", "first", "suffix", "n"])

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = _tables(shared.value)
        hashes = _Hashes()
        held: dict[str, Counter] = {}
        for batch in batches:
            for lang, words, _ in _runs(batch, spec.max_n - 1):
                starts = len(words) - spec.max_n + 1
                if starts <= 0:
                    continue
                length = np.zeros(starts, np.int64)
                for n, (_, fine) in enumerate(_open(hashes(lang, words), often, spec.max_n), 1):
                    length += (length == n - 1) & fine[:starts]
                counts = held.setdefault(lang, Counter())
                counts.update(compress(words, (length == 1).tolist()))
                longer = np.flatnonzero(length > 1)
                counts.update(b" ".join(words[i:end]) for i, end in zip(longer.tolist(), (longer + length[longer]).tolist(), strict=True))
                if sum(map(len, held.values())) > _HELD:
                    full = max(held, key=lambda x: len(held[x]))
                    yield from rows(full, held.pop(full))
        for lang, counts in held.items():
            yield from rows(lang, counts)

    return _texts(docs).mapInArrow(run, "lang string, first string, suffix string, n long")


@gives_back
def prefix_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, n) of every prefix of suffixes (lang, suffix, n) that stand in reverse order: one stack of open prefixes.

    Where control signs in words part suffixes with a common prefix, it comes in
    several rows, as it does from several parts; they are added up afterwards.
    """
    stack: list[list] = []  # [word, occurrences] of each open prefix
    language, out = None, []

    def close(depth: int) -> None:
        while len(stack) > depth:
            phrase = " ".join(w for w, _ in stack)
            _, n = stack.pop()
            out.append((language, phrase, n))
            if stack:
                stack[-1][1] += n

    def taken() -> pa.RecordBatch:
        columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "n"])

    for batch in batches:
        for lang, suffix, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            words = suffix.split(" ")
            same = 0
            if lang == language:
                for (open_word, _), word in zip(stack, words, strict=False):
                    if open_word != word:
                        break
                    same += 1
            close(same)
            language = lang
            stack.extend([w, 0] for w in words[same:])
            stack[-1][1] += n
        if out:
            yield taken()
    close(0)
    if out:
        yield taken()


def phrase_counts(docs: DataFrame, spec: Mining, often: list[bytes]) -> DataFrame:
    """lang, phrase, n of every phrase of 1 to ``max_n`` words with at least ``least`` occurrences."""
    found = suffixes(docs, spec, often)
    dealt = found.repartition("lang", "first", F.pmod(F.xxhash64("suffix"), F.lit(spec.salts))).select("lang", "suffix", "n")
    stacked = dealt.sortWithinPartitions("lang", F.col("suffix").desc()).mapInArrow(prefix_counts, "lang string, phrase string, n long")
    return stacked.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= spec.least)


def _part(first: F.Column | int, size: F.Column | int) -> F.Column:
    return F.array_join(F.slice("words", first, size), " ")


def scored(found: DataFrame, spec: Mining) -> DataFrame:
    """lang, phrase, a, l, r, score of the phrases of two words and more in ``found(lang, phrase, n)``
    that stay beside the longer ones.

    Products are decimals of 38 digits, the division is that of whole numbers.
    """
    wide = "decimal(38,0)"
    parts = found.select("lang", F.split("phrase", " ").alias("words"), "phrase", F.col("n").alias("a")).filter(F.size("words") > 1)
    known = found.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    cuts = parts.select("*", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("first"), _part(F.col("k") + 1, F.size("words") - F.col("k")).alias("rest"))
    cuts = cuts.join(known.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(known.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr(f"(2000000 * cast(a as {wide})) div (cast(l as {wide}) + cast(r as {wide}))").cast("long")
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inner = parts.filter(F.size("words") > 2).select("lang", "words", "a", F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("size"))
    inner = inner.select("lang", "words", "a", "size", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)).alias("at"))
    inside = inner.select("lang", _part(F.col("at"), F.col("size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    stays = F.col("longer").isNull() | F.expr(f"100 * cast(longer as {wide}) < {spec.within_percent} * cast(a as {wide})")
    return lowest.join(inside, ["lang", "phrase"], "left").filter(stays).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, spec: Mining = PRODUCTION) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language of ``docs(text, lang)``.

    A null lang counts as ``und``; a null or empty text has no words; repeated
    rows count again; an empty table gives no rows.  Equal scores are ordered by
    frequency, then by the UTF-8 bytes of the phrase, which are different within
    a language.  Other columns are ignored.
    """
    out = Written(docs.sparkSession, "phrases")
    words, often = survey(docs, spec, (1, 2), [])
    for size in range(3, spec.max_n):
        again, often = survey(docs, spec, (1, size) if size == 3 else (size,), often)
        out.drop(again)
    found = out.table(phrase_counts(by_language(docs, words), spec, often), "counts")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(64))
    first = scored(found, spec).withColumn("salt", salt).withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("place") <= spec.top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= spec.top)
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle_sql(spec: Mining = PRODUCTION) -> str:
    """The same rows in DuckDB, from all n-grams."""
    return rf"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
grams as (select lang, size, array_to_string(w[i:i + size - 1], ' ') as phrase from (select lang, w, size, unnest(range(1, len(w) - size + 2)) as i from w, range(1, {spec.max_n + 1}) as s(size))),
f as (select lang, size, phrase, count(*) as f from grams group by all having count(*) >= {spec.least}),
total as (select lang, sum(len(w))::bigint as n from w group by lang),
c as (select lang, phrase, size, f as a, string_split(phrase, ' ') as w from f where size > 1),
cuts as (select lang, phrase, size, w, a, unnest(range(1, size)) as k from c),
marked as (
  select x.lang, x.phrase, a, k, p.f as l, q.f as r, ((2000000::hugeint * a) // (p.f + q.f))::bigint as score
  from cuts x join f p on p.lang = x.lang and p.phrase = array_to_string(w[1:k], ' ') join f q on q.lang = x.lang and q.phrase = array_to_string(w[k + 1:x.size], ' ')),
lowest as (select * from marked qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inside as (
  select lang, phrase, max(a) as longer
  from (select lang, a, array_to_string(w[i:i + s - 1], ' ') as phrase from (select lang, a, w, s, unnest(range(1, size - s + 2)) as i from (select lang, a, w, size, unnest(range(2, size)) as s from c)))
  group by lang, phrase),
kept as (select l.* from lowest l left join inside i using (lang, phrase) where longer is null or 100::hugeint * longer < {spec.within_percent}::hugeint * a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from kept join total using (lang) qualify rank <= {spec.top}
"""
