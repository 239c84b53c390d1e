"""Near-duplicate documents: a chosen-path similarity join over minwise tokens.

A document's set of word shingles is turned into ``TOKENS`` minwise tokens.  Each of
``TREES`` independent trees has ``DEPTH`` positions of its own, so its nodes hold the
documents that agree on ``DEPTH`` tokens; a pair at 0.8 meets in a tree with a chance
of 0.51 and in none with (1 - 0.8 ** 3) ** 25 = 2e-8.  In every node all members are
compared with a few of them, its pivots.  Nodes of at most ``SMALL`` sets are
compared exhaustively, a pair in the first of them where it meets; larger ones that
hold more than one component branch on, each on two positions that a hash of the node
chooses.  Two are more than the 1 / 0.8 that
keep one path of a pair at 0.8 on average, so paths multiply on the way down instead
of dying out: at most 8e-8 of such pairs lose all of them after any number of
descents.  What is large after ``ROUNDS`` descents is compared exhaustively as well,
in blocks, but for pairs within a node's largest component.

Documents with equal sets are one from the start, so a node holds different sets
only.  A pair that is in one component already is never compared, nor one whose set
sizes rule it out or whose tokens agree so seldom that the threshold is out of reach
(chance below 1e-7 to err).  Links are confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import Written, arrow_rows, gives_back

TREES = 25
DEPTH = 3  # positions of a tree
TOKENS = TREES * DEPTH
SMALL = 128
ROUNDS = 1
PIVOTS = 2
BLOCK = 2048  # sets in a block of a large node, on average, and at most
BLOCK_SHINGLES = 1 << 21  # shingles in it
TILE = 1024
BITMAP = 1 << 25

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15
_FACTORS = _rng.integers(1, 1 << 63, TOKENS, dtype=np.uint64) | np.uint64(1)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p)
    return _POWERS[0], _POWERS[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word (a run of anything but space and \\x09-\\x0D), A-Z lower-cased."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    gap = np.concatenate(([True], _SPACE[raw], [True]))
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _powers(len(raw) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * power[: len(raw)])))
    return _mix((sums[ends] - sums[starts]) * inverse[starts])


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles; with fewer words one of the whole sequence."""
    words = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(words):
        return words
    size = min(k, len(words))
    h = words[: len(words) - size + 1].copy()
    for i in range(1, size):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[i : len(words) - size + 1 + i]
    return np.unique(_mix(h + np.uint64(size)))


def tokens(shingles: np.ndarray) -> np.ndarray:
    """The minwise tokens: for each of TOKENS permutations the top bits of the least image."""
    least = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 8192):
        least = np.minimum(least, np.multiply.outer(_FACTORS, shingles[at : at + 8192]).min(1))
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, f1, f2 (fingerprint of the set), tokens; for the empty set the last three are null."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in arrow_rows(batches, "doc_id", "text"):
            for at in range(0, len(rows), 1000):
                n, f1, f2, sig = [], [], [], []
                for _, text in rows[at : at + 1000]:
                    s = shingle_set(text, k)
                    n.append(len(s))
                    if len(s):
                        a, b = np.frombuffer(xxhash.xxh3_128_digest(s), np.int64)
                        f1.append(int(a))
                        f2.append(int(b))
                        sig.append(tokens(s))
                    else:
                        f1.append(None)
                        f2.append(None)
                        sig.append(None)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows[at : at + 1000]], pa.int64()), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sig, pa.list_(pa.int32()))],
                    names=["doc_id", "n_shingles", "f1", "f2", "tokens"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, tokens array<int>")


def _slot(column: str) -> F.Column:
    return F.pmod(F.xxhash64(F.lit(5), column), F.lit(BITMAP))


def full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(doc_id, shingles) for the documents in ``wanted(doc_id)`` and some others.

    A bitmap of fixed size, addressed by a hash of doc_id, says which texts to
    shingle again; when it fills up, more texts are shingled than needed, never fewer.
    """
    words = wanted.select(_slot("doc_id").alias("s")).groupBy(F.expr("s div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("b")).toArrow()
    bitmap = np.zeros(BITMAP // 64, np.int64)
    bitmap[words.column("w").to_numpy()] = words.column("b").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        for batch in batches:
            slots = batch.column(2).to_numpy(zero_copy_only=False)
            hit = np.flatnonzero(marks[slots >> 6] >> (slots & 63) & 1)
            for at in range(0, len(hit), 250):
                part = batch.take(pa.array(hit[at : at + 250]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([shingle_set(t, k).view(np.int64) for t in part.column(1).to_pylist()], pa.list_(pa.int64()))], names=["doc_id", "shingles"]
                )

    picked = docs.filter("doc_id is not null").select("doc_id", "text", _slot("doc_id").alias("s"))
    return picked.mapInArrow(run, "doc_id long, shingles array<long>")


def _first_nodes(sets: DataFrame) -> DataFrame:
    """(tree, node, rep, n): the nodes of all trees at their full depth, each position used once."""
    keys = [F.xxhash64(F.lit(i), *(F.get("tokens", F.lit(DEPTH * i + d)) for d in range(DEPTH))) for i in range(TREES)]
    return sets.select(F.posexplode(F.array(*keys)).alias("tree", "node"), "rep", "n")


def _lower_nodes(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(tree, node, rep, n): the documents of inner nodes in the children at both positions of each; tree is null there."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                node = part.column(0).to_numpy().view(np.uint64)
                toks = np.asarray(part.column(2).flatten()).reshape(len(node), TOKENS).astype(np.int64).view(np.uint64)
                row = np.arange(len(node))
                h = _mix(node)
                one = (h % np.uint64(TOKENS)).astype(np.int64)
                two = (one + 1 + (h >> np.uint64(8)).astype(np.int64) % (TOKENS - 1)) % TOKENS
                nodes = [_mix(node + np.uint64(0x632BE59BD9B4E019) * (pos.astype(np.uint64) + np.uint64(1)) ^ _mix(toks[row, pos])) for pos in (one, two)]
                both = pa.array(np.concatenate((row, row)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes).view(np.int64)), part.column(1).take(both), part.column(3).take(both)], names=["node", "rep", "n"])

    full = members.select("node", "rep", "n").join(sets.select("rep", "tokens"), "rep").select("node", "rep", "tokens", "n")
    return full.mapInArrow(run, "node long, rep long, n long").select(F.lit(None).cast("int").alias("tree"), "node", "rep", "n")


def _sized(rows: DataFrame) -> DataFrame:
    """tree, node, rep, n, size of the nodes that hold two sets at least."""
    return rows.withColumn("size", F.count("*").over(W.partitionBy("node"))).filter("size > 1")


def _with_pivots(rows: DataFrame) -> DataFrame:
    """tree, node, rep, n, size, pivots of the nodes that hold two sets at least.

    A pivot is the member that comes first in one of PIVOTS orders of all doc_ids.
    """
    node = W.partitionBy("node")
    first = [F.min(F.col("rep").bitwiseXOR(F.lit(m))).over(node).bitwiseXOR(F.lit(m)) for m in (0, 0x2545F4914F6CDD1D, 0x5DEECE66DAB54F07, 0x1A2B3C4D5E6F7081)[:PIVOTS]]
    return _sized(rows.withColumn("pivots", F.array(*first)))


def _starred(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of each member and the pivots of its node."""
    star = members.select("rep", F.explode(F.array_distinct("pivots")).alias("p")).filter("rep <> p")
    return star.select(F.least("rep", "p").alias("a"), F.greatest("rep", "p").alias("b"))


def _least(percent: int) -> int:
    """How many tokens of a pair that may reach the threshold agree.

    At the threshold t the number that agree is binomial; five and a half
    standard deviations below its mean stays in.
    """
    t = percent / 100
    return int(max(0.0, TOKENS * t - 5.5 * (TOKENS * t * (1 - t)) ** 0.5))


def _agreeing(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, best): of ``pairs(a, b)`` those that may reach the threshold; with the best a of each b most tokens agree."""
    side = lambda c: sets.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("tokens").alias(f"t_{c}"))
    agree = F.size(F.filter(F.zip_with("t_a", "t_b", lambda x, y: x == y), lambda x: x))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    told = joined.select("a", "b", agree.alias("agree")).filter(F.col("agree") >= _least(percent))
    return told.select("a", "b", (F.row_number().over(W.partitionBy("b").orderBy(F.col("agree").desc(), F.col("a").desc())) == 1).alias("best"))


def _confirmed(pairs: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs(a, b)`` those whose full sets reach the threshold, as (u, v)."""
    side = lambda c: shingles.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"s_{c}"))
    both = F.size(F.array_intersect("s_a", "s_b"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.size("s_a").alias("n_a"), F.size("s_b").alias("n_b"), both.alias("both"))
    return joined.filter(100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _open(tree: int | None, n: np.ndarray, label: np.ndarray, tok: np.ndarray, small: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of a node's members may link, are apart, and meet in no small node of the first level before this one."""
    open_ = (label[:, None] != label[None, :]) & (100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :]))
    if open_.any():
        same = tok[:, None, :] == tok[None, :, :]
        open_ &= same.sum(2) >= _least(percent)
        met = same.reshape(len(n), len(n), TREES, DEPTH).all(3)
        before = (small[:, None] >> np.arange(TREES) & 1).astype(bool)
        before[:, TREES if tree is None else tree :] = False
        open_ &= ~(met & before[:, None, :]).any(2)
    return open_


def _undecided(small: DataFrame, sets: DataFrame, first: DataFrame, percent: int) -> DataFrame:
    """(node, rep, n, component) of the members of nodes of bounded size that full sets must be compared for.

    ``first(rep, small)`` says in which trees a set is in a node that is compared at the first level.
    """

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, ...]] = []
            for tree, node, members in zip(*(c.to_pylist() for c in batch.columns[:2]), batch.column(2), strict=True):
                rows = members.values
                rep, label, n, mask = (rows.field(c).to_numpy() for c in ("rep", "component", "n", "small"))
                tok = rows.field("tokens").flatten().to_numpy().reshape(len(rep), TOKENS)
                keep = np.flatnonzero(_open(tree, n, label, tok, mask, percent).any(1))
                found += [(node, int(rep[x]), int(n[x]), int(label[x])) for x in keep]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(4)], names=["node", "rep", "n", "component"])

    known = sets.select("rep", "tokens").join(first, "rep", "left").withColumn("small", F.coalesce("small", F.lit(0)))
    full = small.select("tree", "node", "rep", "n", "component").join(known, "rep")
    listed = full.groupBy("node").agg(F.first("tree").alias("tree"), F.collect_list(F.struct("rep", "component", "n", "small", "tokens")).alias("all"))
    return listed.select("tree", "node", "all").mapInArrow(run, "node long, rep long, n long, component long")


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set on the left shares with each on the right."""
    every = [np.concatenate(side) for side in (left, right)]
    vocabulary = np.intersect1d(*every)
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(vocabulary):
        return out.astype(np.int64)
    cells = []
    for sets, flat in zip((left, right), every, strict=True):
        at = np.minimum(np.searchsorted(vocabulary, flat), len(vocabulary) - 1)
        known = vocabulary[at] == flat
        cells.append((np.repeat(np.arange(len(sets)), [len(s) for s in sets])[known], at[known]))
    for lo in range(0, len(vocabulary), 4096):
        sides = []
        for row, at in cells:
            here = (at >= lo) & (at < lo + 4096)
            dense = np.zeros((row.max() + 1 if len(row) else 0, min(4096, len(vocabulary) - lo)), np.float32)
            dense[row[here], at[here] - lo] = 1
            sides.append(dense)
        out[: len(sides[0]), : len(sides[1])] += sides[0] @ sides[1].T
    return out.astype(np.int64)


def links_between(sets: list[np.ndarray], label: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links enough to join all that any links of left with right members (indices) join, found exhaustively.

    ``label`` holds the components so far and is brought up to date.
    """
    n = np.array([len(s) for s in sets])
    sig = np.stack([tokens(s) for s in sets])
    out: list[tuple[int, int]] = []
    for i in range(0, len(left), TILE):
        for j in range(0, len(right), TILE):
            a, b = left[i : i + TILE], right[j : j + TILE]
            na, nb = n[a][:, None], n[b][None, :]
            open_ = (label[a][:, None] != label[b][None, :]) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
            if not open_.any():
                continue
            agree = np.zeros(open_.shape, np.uint8)
            for t in range(TOKENS):
                agree += sig[a, t][:, None] == sig[b, t][None, :]
            open_ &= agree >= _least(percent)
            row, col = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
            if not len(row):
                continue
            a, b, open_ = a[row], b[col], open_[np.ix_(row, col)]
            both = _common([sets[x] for x in a], [sets[x] for x in b])
            x, y = np.nonzero(open_ & (100 * both >= percent * (n[a][:, None] + n[b][None, :] - both)))
            _, first = np.unique(np.stack((label[a[x]], label[b[y]])), axis=1, return_index=True)
            for u, v in zip(a[x[first]], b[y[first]], strict=True):
                if label[u] != label[v]:
                    label[label == label[v]] = label[u]
                    out.append((int(u), int(v)))
    return out


def _linked_in_blocks(members: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) that join what nodes of any size hold apart, compared on full sets.

    What belongs to the largest component of its node is compared with all the rest
    of the node, and the rest with itself.  Both sides are dealt into blocks of
    bounded size, and each pair of blocks is compared in one task.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        rep, label, left, right = (table.column(c).to_numpy(zero_copy_only=False).copy() for c in ("rep", "component", "left", "right"))
        lists = table.column("shingles").chunk(0)
        flat, at = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
        sets = [flat[x:y] for x, y in zip(at, at[1:], strict=False)]
        found = links_between(sets, label, np.flatnonzero(left), np.flatnonzero(right), percent)
        return pa.table({"u": pa.array([int(rep[u]) for u, _ in found], pa.int64()), "v": pa.array([int(rep[v]) for _, v in found], pa.int64())})

    counts = members.groupBy("node", "component").agg(F.count("*").alias("sets"), F.sum("n").alias("n"))
    nodes = counts.groupBy("node").agg(F.max(F.struct("sets", "component", "n")).alias("top"), F.sum("sets").alias("sets"), F.sum("n").alias("n"))
    blocks = lambda sets, n: F.ceil(F.greatest(sets / BLOCK, n / BLOCK_SHINGLES)).cast("int")
    plan = nodes.select("node", F.col("top.component").alias("top"), blocks(F.col("sets"), F.col("n")).alias("all_blocks"), blocks(F.col("sets") - F.col("top.sets"), F.col("n") - F.col("top.n")).alias("rest_blocks")).filter("rest_blocks > 0")
    block = lambda of: F.expr(f"cast(pmod(xxhash64(17, rep), {of}) as int)")
    dealt = members.select("node", "rep", "component").join(plan, "node").withColumns({"is_rest": F.col("component") != F.col("top"), "bi": block("rest_blocks"), "bj": block("all_blocks")})
    across = dealt.select("node", F.explode(F.expr("sequence(0, rest_blocks - 1)")).alias("i"), F.col("bj").alias("j"), "is_rest", "bi", "rep", "component")
    across = across.select("node", "i", "j", (F.col("is_rest") & (F.col("bi") == F.col("i"))).alias("left"), F.lit(True).alias("right"), "rep", "component")
    down = dealt.filter("is_rest and all_blocks > 1").select("node", F.col("bi").alias("i"), F.explode(F.expr("filter(sequence(0, all_blocks - 1), j -> j <> bj)")).alias("j"), F.lit(True).alias("left"), F.lit(False).alias("right"), "rep", "component")
    tiles = across.unionByName(down)
    full = tiles.join(shingles.withColumnRenamed("doc_id", "rep"), "rep").select("node", "i", "j", "left", "right", "rep", "component", "shingles")
    return full.groupBy("node", "i", "j").applyInArrow(run, "u long, v long")


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` that are in different components so far."""
    label = lambda c: comp.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
    joined = pairs.join(label("a"), "a", "left").join(label("b"), "b", "left")
    return joined.filter(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")


def _mixed(members: DataFrame, comp: DataFrame) -> DataFrame:
    """The members, with their components so far, of nodes that hold more than one."""
    placed = members.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("tree", "node", "rep", "n", "size", F.coalesce("component", "rep").alias("component"))
    node = W.partitionBy("node")
    return placed.withColumns({"lo": F.min("component").over(node), "hi": F.max("component").over(node)}).filter("lo <> hi").drop("lo", "hi")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs(doc_id, text)``.

    Two documents are linked if 100 * |A & B| >= percent * |A | B| for their
    shingle sets; component_id is the smallest doc_id reachable over links, and
    kept says that it is the document's own.  A text that is null or holds no
    word has the empty set and is linked with nothing.  A row without doc_id is
    linked with nothing: component_id null, kept true.  Rows that share a doc_id
    are one document, linked if any of its texts is.  Other columns are ignored.
    """
    spark = docs.sparkSession
    out = Written(spark, "neardup")
    sigs = out.table(signatures(docs, k), "signatures")
    sets = out.table(sigs.filter("n_shingles > 0 and doc_id is not null").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("tokens").alias("tokens")), "sets")
    members = out.table(_with_pivots(_first_nodes(sets)), "nodes")
    pairs = out.table(_agreeing(_starred(members).distinct(), sets, percent), "pairs")
    ends = lambda p: p.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    shingles = out.table(full_sets(docs, ends(pairs), k), "shingles")
    written = [pairs, shingles]  # read until the last link is found
    # First each set against the pivot that its tokens agree with most, later what that leaves apart.
    links = out.table(_confirmed(pairs.filter("best").select("a", "b"), shingles, percent), "links")
    comp = out.table(connected_components(links, out.table, out.drop), "components")
    more = out.table(_apart(pairs.filter("not best").select("a", "b"), comp), "more")
    written += [links, more]
    # All levels are dealt before anything is compared, so full sets are made and moved, and components joined, once.
    small, first = None, None
    for descents in range(ROUNDS + 1):
        active = out.table(_mixed(members, comp), "active")
        out.drop(members)
        written.append(active)
        here = active.filter(F.col("size") <= SMALL)
        if first is None:
            first = here.groupBy("rep").agg(F.expr("bit_or(shiftleft(1, tree))").alias("small"))
        small = here if small is None else small.unionByName(here)
        large = active.filter(F.col("size") > SMALL)
        if descents == ROUNDS or large.first() is None:
            break
        members = out.table(_sized(_lower_nodes(large, sets)), "nodes")
    undecided = out.table(_undecided(small, sets, first, percent).union(large.select("node", "rep", "n", "component")), "undecided")
    wanted = undecided.select(F.col("rep").alias("doc_id")).union(ends(more)).distinct().join(shingles.select("doc_id"), "doc_id", "left_anti")
    written.append(undecided)
    if undecided.first() is not None or more.first() is not None:
        written.append(out.table(full_sets(docs, wanted, k), "shingles"))
        shingles = shingles.union(written[-1])
        found = out.table(_linked_in_blocks(undecided, shingles, percent).union(_confirmed(more, shingles, percent)), "links")
        written.append(found)
        if found.first() is not None:
            # What is known already stands as stars, which settle in fewer rounds than the links behind them.
            known = comp.select(F.col("node").alias("u"), F.col("component").alias("v"))
            comp = out.table(connected_components(known.union(found), out.table, out.drop), "components")

    for t in written:
        out.drop(t)
    named = sets.join(comp, sets.rep == comp.node, "left").select("f1", "f2", F.coalesce("component", "rep").alias("component"))
    joined = sigs.select("doc_id", "n_shingles", "f1", "f2").join(named, ["f1", "f2"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.least("doc_id", F.coalesce("component", "doc_id")))
    return joined.select("doc_id", "n_shingles", own.alias("component_id"), (F.coalesce(own == F.col("doc_id"), F.lit(True))).alias("kept"))
