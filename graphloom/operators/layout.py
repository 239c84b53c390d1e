"""Placements of nodes: levels, rows, bands, grids and the extents of a view.

Windows run within a module, layer and level; offsets of bands run over modules,
whose number is the number of modules, not of nodes.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.work import cut, drop

ROW = 76


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level): edges of the longest way to a node within its own module and layer.

    Circles are cut as a depth-first walk against the edges cuts them, that starts each
    strongly connected part at its smallest id and takes predecessors by id: an edge
    from a node that is still being walked counts as one from level 0.  Runs of nodes
    with one edge in and one out are passed in a number of rounds that grows with
    the logarithm of their length; elsewhere a round carries on the nodes whose level rose.
    """
    where = lambda c: nodes.select(F.col("id").alias(c), F.struct("module", "layer").alias(f"g_{c}"))
    own = cut(edges.select("src", "dst").join(where("src"), "src").join(where("dst"), "dst").filter("g_src = g_dst and src <> dst").select("src", "dst").distinct())
    back = cut(_back_edges(own))
    level = cut(_longest(own.join(back, ["src", "dst"], "left_anti"), back.select(F.col("dst").alias("id")).distinct()))
    drop(own, back)
    return nodes.select("id").join(level, "id", "left").select("id", F.coalesce("level", F.lit(0)).alias("level"))


def _runs(edges: DataFrame, fixed: DataFrame | None = None) -> DataFrame:
    """(id, head, steps, low) of the nodes with one edge in and one out (none of ``fixed``): the first node before them that
    is no such node, how far it is, and the smallest id between; head is null where the run is a circle of its own."""
    one = lambda c: edges.groupBy(F.col(c).alias("id")).count().filter("count = 1").select("id")
    inner = one("src").join(one("dst"), "id")
    inner = inner if fixed is None else inner.join(fixed, "id", "left_anti")
    inner = cut(inner)
    now = cut(edges.join(inner.withColumnRenamed("id", "dst"), "dst").select(F.col("dst").alias("id"), F.col("src").alias("head"), F.lit(1).cast("long").alias("steps"), F.col("dst").alias("low")))
    done = now.join(inner.withColumnRenamed("id", "head"), "head", "left_anti").select("id", "head", "steps", "low")
    rest = cut(now.join(inner.withColumnRenamed("id", "head"), "head", "left_semi").select("id", "head", "steps", "low"))
    out, n = cut(done), rest.count()
    most, rounds = n, 0
    while n and (1 << rounds) <= 2 * most:
        ahead = out.union(rest).select(F.col("id").alias("head"), F.col("head").alias("further"), F.col("steps").alias("more"), F.col("low").alias("other"))
        moved = cut(rest.join(ahead, "head").select("id", F.col("further").alias("head"), (F.col("steps") + F.col("more")).alias("steps"), F.least("low", "other").alias("low")))
        out = cut(out.union(moved.join(inner.withColumnRenamed("id", "head"), "head", "left_anti").select("id", "head", "steps", "low")))
        before, rest = rest, cut(moved.join(inner.withColumnRenamed("id", "head"), "head", "left_semi").select("id", "head", "steps", "low"))
        drop(before, moved)
        n, rounds = rest.count(), rounds + 1
    return out.union(rest.select("id", F.lit(None).cast("string").alias("head"), "steps", "low"))


def _short(edges: DataFrame, runs: DataFrame) -> DataFrame:
    """(src, dst, w): the edges with every run as one edge of its length; circles of their own are left out."""
    end = lambda c: runs.select(F.col("id").alias(c), F.col("head").alias(f"h_{c}"), F.col("steps").alias(f"s_{c}"), F.lit(True).alias(f"in_{c}"))
    joined = edges.join(end("src"), "src", "left").join(runs.select(F.col("id").alias("dst")), "dst", "left_anti").filter("in_src is null or h_src is not null")
    return joined.select(F.coalesce("h_src", "src").alias("src"), "dst", (F.coalesce("s_src", F.lit(0)) + 1).alias("w")).groupBy("src", "dst").agg(F.max("w").alias("w"))


def _longest(edges: DataFrame, raised: DataFrame) -> DataFrame:
    """(id, level) over edges without circles; ``raised`` nodes have level 1 at least."""
    edges = cut(edges)
    runs = cut(_runs(edges, raised))
    steps = cut(_short(edges, runs))
    ends = steps.select(F.col("src").alias("id")).union(steps.select("dst")).union(edges.select("src").join(runs.select(F.col("id").alias("src")), "src", "left_anti")).union(edges.select("dst").join(runs.select(F.col("id").alias("dst")), "dst", "left_anti")).distinct()
    heads = runs.filter("head is not null").select(F.col("head").alias("id"))
    start = ends.union(heads).distinct().join(raised.withColumn("up", F.lit(1).cast("long")), "id", "left").select("id", F.coalesce("up", F.lit(0).cast("long")).alias("level"))
    parts = [cut(start)]
    rose = parts[0]
    while True:
        pushed = rose.select(F.col("id").alias("src"), "level").join(steps, "src").groupBy(F.col("dst").alias("id")).agg(F.max(F.col("level") + F.col("w")).alias("level"))
        known = parts[0]
        for p in parts[1:]:
            known = known.union(p)
        had = known.select("id", F.lit(None).cast("long").alias("level"), F.col("level").alias("had"))
        both = pushed.select("id", "level", F.lit(None).cast("long").alias("had")).union(had).groupBy("id").agg(F.max("level").alias("level"), F.max("had").alias("had"))
        rose = cut(both.filter("level > had").select("id", "level"))
        if rose.first() is None:
            break
        parts.append(rose)
        if len(parts) > 6:
            whole = cut(known.union(rose).groupBy("id").agg(F.max("level").alias("level")))
            drop(*parts[:-1])
            parts = [whole]
    known = parts[0]
    for p in parts[1:]:
        known = known.union(p)
    best = cut(known.groupBy("id").agg(F.max("level").alias("level")))
    drop(*parts)
    return best.union(runs.join(best.withColumnRenamed("id", "head"), "head").select("id", (F.col("level") + F.col("steps")).alias("level")))


def _back_edges(edges: DataFrame) -> DataFrame:
    """(src, dst): edges that lead, in a depth-first walk against the edges within a strongly connected part, to a node from
    one that is still being walked.  A part is walked by one task; parts are dealt out by their size."""
    ring = cut(_rings(edges))
    named = lambda c: ring.select(F.col("id").alias(c), F.col("ring").alias(f"r_{c}"))
    inner = edges.join(named("src"), "src").join(named("dst"), "dst").filter("r_src = r_dst").select(F.col("r_src").alias("ring"), "src", "dst")
    return inner.groupBy("ring").applyInPandas(lambda part: pd.DataFrame(walked(zip(part.src, part.dst, strict=True)), columns=["src", "dst"]), "src string, dst string")


def walked(edges: Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
    """The edges that a depth-first walk against them finds to come from a node that is still being walked."""
    before: dict[str, list[str]] = {}
    for a, b in edges:
        before.setdefault(b, []).append(a)
    state: dict[str, int] = {}  # 1: being walked, 2: done
    out = []
    for start in sorted(before):
        if start in state:
            continue
        state[start] = 1
        path = [(start, iter(sorted(before[start])))]
        while path:
            at, rest = path[-1]
            for p in rest:
                if state.get(p) == 1:
                    out.append((p, at))
                elif p not in state:
                    state[p] = 1
                    path.append((p, iter(sorted(before.get(p, ())))))
                    break
            else:
                state[at] = 2
                path.pop()
    return out


def _rings(edges: DataFrame) -> DataFrame:
    """(id, ring) of the nodes on circles: ring is the smallest id that a node reaches and is reached from, runs left out.

    Runs count as one edge, and nodes without an edge in or out of what is left
    cannot be on a circle and are peeled off; both are repeated while they help.
    What remains is coloured forwards and backwards until no colour falls, and
    nodes whose two colours agree with a root's form its ring.  A run between two
    nodes of a ring belongs to it.
    """
    left, n, layers, alone = edges.select("src", "dst"), -1, [], None
    while n != (n := left.count()) and n:
        runs = cut(_runs(left))
        circles = runs.filter("head is null").select("id", F.col("low").alias("ring"))
        alone = circles if alone is None else alone.union(circles)
        short = cut(_short(left, runs).select("src", "dst"))
        # Of a run that ends nowhere else: the node that its last one leads to.
        last = left.join(runs.select(F.col("id").alias("src"), "head"), "src").join(runs.select(F.col("id").alias("dst")), "dst", "left_anti").filter("head is not null").select("head", F.col("src").alias("tail"), F.col("dst").alias("end"))
        layers.append(cut(runs.filter("head is not null").select("id", "head", "steps").join(last, "head")))
        loops = short.filter("src = dst").select(F.col("src").alias("id"), F.col("src").alias("ring"))
        alone = cut(alone.union(loops)) if alone is not None else cut(loops)
        left = short.filter("src <> dst")
        for _ in range(3):
            left = cut(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
    out = _coloured(left)
    out = cut(out.unionByName(alone).groupBy("id").agg(F.min("ring").alias("ring"))) if alone is not None else out
    for layer in reversed(layers):
        at = lambda c, out=out: out.select(F.col("id").alias(c), F.col("ring").alias(f"r_{c}"))
        within = layer.join(at("head"), "head").join(at("end"), "end").filter("r_head = r_end").select("id", F.col("r_head").alias("ring")).distinct()
        out = cut(out.unionByName(within))
    return out


def _coloured(left: DataFrame) -> DataFrame:
    """(id, ring) of the nodes on circles of the edges, by colours."""
    edges, out = left, None
    while left.first() is not None:
        colour = _lowest_reaching(left)
        # A ring of the root of a colour: what leads back to the root within the colour.
        same = left.join(colour.withColumnRenamed("id", "src").withColumnRenamed("low", "c_src"), "src").join(colour.withColumnRenamed("id", "dst").withColumnRenamed("low", "c_dst"), "dst").filter("c_src = c_dst")
        same = cut(same.select("src", "dst", F.col("c_src").alias("root")))
        back = cut(colour.filter("id = low").select("id", F.col("low").alias("ring")))
        fresh = back
        while True:
            more = same.join(fresh.select(F.col("id").alias("dst"), F.col("ring").alias("root")), ["dst", "root"]).select(F.col("src").alias("id"), F.col("root").alias("ring")).distinct()
            fresh = cut(more.join(back.select("id"), "id", "left_anti"))
            if fresh.first() is None:
                break
            back = cut(back.union(fresh))
        rings = cut(back.join(back.groupBy("ring").count().filter("count > 1").select("ring"), "ring", "left_semi").select("id", "ring"))
        out = rings if out is None else out.union(rings)
        done = back.select("id")
        left = cut(left.join(done.withColumnRenamed("id", "src"), "src", "left_anti").join(done.withColumnRenamed("id", "dst"), "dst", "left_anti"))
    return out if out is not None else edges.select(F.col("src").alias("id"), F.col("dst").alias("ring")).limit(0)


def _lowest_reaching(edges: DataFrame) -> DataFrame:
    """(id, low): the smallest id from which a node can be reached, itself included."""
    now = cut(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().withColumn("low", F.col("id")))
    fell = now
    while True:
        offered = fell.select(F.col("id").alias("src"), "low").join(edges.select("src", "dst"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("low").alias("low"))
        fell = cut(offered.join(now.select("id", F.col("low").alias("had")), "id").filter("low < had").select("id", "low"))
        if fell.first() is None:
            return now
        now = cut(now.join(fell.select("id"), "id", "left_anti").union(fell))


def rows(nodes: DataFrame) -> DataFrame:
    """id, row, y of nodes(id, label, module, layer): their place within module and layer, ROW apart."""
    place = F.row_number().over(W.partitionBy("module", "layer").orderBy("label", "id")) - 1
    return nodes.select("id", "module", "layer", place.alias("row")).withColumn("y", F.col("row") * ROW)


def bands(placed: DataFrame) -> DataFrame:
    """module, height, top: bands of modules one below the other, as high as their longest layer."""
    tall = placed.groupBy("module").agg(((F.max("row") + 1) * ROW).alias("height"))
    top = F.coalesce(F.sum("height").over(W.partitionBy(F.lit(0)).orderBy("module").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return tall.select("module", "height", top.alias("top"))


def grid(items: DataFrame, key: str, columns: int, width: int, height: int) -> DataFrame:
    """key, x, y: cards in rows of ``columns``, in the order of the key."""
    i = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(key)) - 1
    return items.select(key, ((i % columns) * width).alias("x"), (F.floor(i / columns) * height).alias("y"))


def viewport(placed: DataFrame, width: float, height: float, low: float = 0.2, high: float = 1.0) -> DataFrame:
    """One row: extents of x and y and the zoom that fits them."""
    ext = placed.agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))
    fit = F.least(F.lit(width) / F.greatest(F.lit(1.0), F.col("max_x") - F.col("min_x")), F.lit(height) / F.greatest(F.lit(1.0), F.col("max_y") - F.col("min_y")))
    return ext.withColumn("zoom", F.greatest(F.lit(low), F.least(F.lit(high), fit)))


def limited(nodes: DataFrame, most: int, always: DataFrame) -> DataFrame:
    """The first ``most`` ids, and those of ``always`` that are not among them."""
    first = nodes.select("id").orderBy("id").limit(most)
    return first.union(always.select("id").distinct().join(first, "id", "left_anti"))
