"""Cheapest ways from many starts to the nearest goal, where the starts of a group pay the same prices.

What a group's starts reach is written once for the group, edge by edge; back from the
goals each of these nodes learns what the rest of its way costs; then each start follows
only edges of which no cheaper way leads past.  Tables are written by the parts that
types of nodes fall into, so a step reads the edges of its own types and not all.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.work import cut, drop
from . import trace

#: How many parts there are, and how many tables of one size become one.
PARTS = 16
MOST = 7


def part_of(kind: Column) -> Column:
    return F.pmod(F.hash(F.coalesce(kind, F.lit(""))), F.lit(PARTS))


def _reversed(steps: DataFrame) -> DataFrame:
    return steps.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "base", F.col("far").alias("near"), F.col("near").alias("far"))


def _parts(table: DataFrame, column: str) -> list[int]:
    """Values of a column by which a table is written, as its folders name them."""
    return sorted({int(v) for file in table.inputFiles() for v in re.findall(rf"/{column}=(\d+)/", file)})


class Pile:
    """Written tables of the same columns, each with the parts that may be looked for in it; they are merged by size, so plans stay short."""

    def __init__(self, *by: str) -> None:
        self.by, self.tables = by, []

    def add(self, table: DataFrame, parts: Collection[int]) -> None:
        """Takes the table over: it may be gone afterwards."""
        self.tables.append((0, table, frozenset(parts)))
        while len(last := self.tables[-MOST:]) == MOST and len({size for size, _, _ in last}) == 1:
            one = cut(trace.united([t for _, t, _ in last]), *self.by)
            drop(*(t for _, t, _ in last))
            self.tables[-MOST:] = [(last[0][0] + 1, one, frozenset().union(*(p for _, _, p in last)))]

    def having(self, parts: Collection[int]) -> DataFrame | None:
        some = [t for _, t, p in self.tables if not p.isdisjoint(parts)]
        return trace.united(some) if some else None

    def parts(self) -> frozenset[int]:
        return frozenset().union(*(p for _, _, p in self.tables))

    def whole(self) -> DataFrame:
        return trace.united([t for _, t, _ in self.tables])

    def drop(self) -> None:
        drop(*(t for _, t, _ in self.tables))


def expand(starts: DataFrame, own: list[str], carried: list[str], along: Callable, left_from: Collection[int], entered: Callable, end: str) -> tuple[Pile, Pile]:
    """All nodes (own, id, part, ..) that the starts lead to, and all edges that leave them, each left once.

    ``along(nodes, parts)`` gives the edges (own, src, dst, near, far, ..) of new nodes, of which only
    those of the parts ``left_from`` have any; ``entered`` adds to new nodes what is known of them;
    edges are looked for by the parts of ``end``.
    """
    known, met = Pile("part"), Pile("near", "far")
    new = cut(entered(starts, [r[0] for r in starts.select("part").distinct().collect()]), "part")
    parts = _parts(new, "part")
    while not met.tables or not set(left_from).isdisjoint(parts):
        edges = cut(along(new, parts), "near", "far")
        known.add(new, parts)
        reached = edges.select(*own, F.col("dst").alias("id"), F.col("far").alias("part"), *carried).distinct()
        fars = _parts(edges, "far")
        if (before := known.having(fars)) is not None:
            reached = reached.join(before.filter(F.col("part").isin(fars)).select(*own, "id"), [*own, "id"], "left_anti")
        new = cut(entered(reached, fars), "part")
        met.add(edges, fars if end == "far" else parts)
        parts = _parts(new, "part")
    known.add(new, parts)
    return known, met


def _rest(goals: DataFrame, kind: int, met: Pile, made: Pile) -> tuple[DataFrame, Pile]:
    """(group, id, cost, goal), and the tables that it is read from: of all nodes from which a goal is met, the least cost and, of goals that cost the same, the
    smaller id.  Adds the edges looked at to ``made``; those of a node's final cost and goal lie on cheapest ways."""
    best, again = Pile("part"), False
    fell = cut(goals.select("group", "id", "part", "gain", "penalty", F.lit(0.0).alias("cost"), F.col("id").alias("goal")), "part")
    parts = _parts(fell, "part")
    while (edges := met.having(parts)) is not None:
        toward = fell.select("group", F.col("id").alias("dst"), F.col("cost").alias("rest"), "goal", F.col("gain").alias("less"), F.col("penalty").alias("more"))
        price = F.greatest(F.lit(0.25), F.col("base") - F.col("less")) + F.col("more")
        both = toward.join(edges.filter(F.col("far").isin(parts)), ["group", "dst"])
        offers = cut(both.select("group", "src", "dst", "base", "gain", "penalty", "rest", (F.col("rest") + price).alias("cost"), "goal", F.lit(kind).alias("kind"), "near", "far"), "near", "far")
        best.add(fell, parts)
        nears = _parts(offers, "near")
        new = offers.groupBy("group", F.col("src").alias("id"), F.col("near").alias("part")).agg(F.min(F.struct("cost", "goal")).alias("label"), F.first("gain").alias("gain"), F.first("penalty").alias("penalty"))
        if (before := best.having(nears)) is not None:
            again = True
            had = before.filter(F.col("part").isin(nears)).groupBy("group", "id").agg(F.min(F.struct("cost", "goal")).alias("had"))
            new = new.join(had, ["group", "id"], "left").filter("had is null or label < had")
        fell = cut(new.select("group", "id", "part", "gain", "penalty", "label.cost", "label.goal"), "part")
        made.add(offers, nears)
        parts = _parts(fell, "part")
    best.add(fell, parts)
    out = best.whole().select("group", "id", "cost", "goal")
    if again:
        out = out.groupBy("group", "id").agg(F.min(F.struct("cost", "goal")).alias("b")).select("group", "id", "b.cost", "b.goal")
    return out, best


@dataclass(frozen=True)
class Nearest:
    """found: (key, group, id, part, kind, cost, goal) of the starts that have a goal; made: edges that their ways may take."""

    key: list[str]
    allowed: DataFrame
    back: bool
    found: DataFrame
    made: Pile

    def ways(self) -> DataFrame:
        """(key, nodes, edges): the way of each start that is found, from it to its goal.

        Of several cheapest ways the node before that is itself nearest counts, then the smaller id, then the smaller edge id.
        """
        own = [*self.key, "group", "kind", "total", "goal"]

        def along(nodes: DataFrame, parts: list[int]) -> DataFrame:
            made = self.made.having(parts)
            made = (self.made.whole().limit(0) if made is None else made.filter(F.col("near").isin(parts))).select("group", "kind", "src", "cost", "goal", "dst", "base", "rest", "near", "far")
            out = nodes.withColumnRenamed("id", "src").drop("part").join(made, ["group", "kind", "src", "cost", "goal"])
            return out.select(*own, "src", "dst", "base", (F.col("total") - F.col("cost")).alias("c"), F.col("rest").alias("cost"), "near", "far")

        starts = self.found.select(*self.key, "group", "kind", F.col("cost").alias("total"), "goal", "id", "part", "cost")
        known, met = expand(starts, own, ["cost"], along, self.made.parts(), lambda new, parts: new, "near")
        before = met.whole().groupBy(*self.key, F.col("dst").alias("id")).agg(F.first(F.col("total") - F.col("cost")).alias("cost"), F.min(F.struct("c", "src", (-F.col("base")).alias("b"))).alias("b"))
        first = starts.select(*self.key, "id", F.lit(0.0).alias("cost"), F.lit(None).cast("string").alias("previous"), F.lit(None).cast("double").alias("edge"))
        best = before.select(*self.key, "id", "cost", F.col("b.src").alias("previous"), (-F.col("b.b")).alias("edge")).union(first)
        out = cut(_named(trace.ways(best, self.found.select(*self.key, F.col("goal").alias("id")), self.key), self.key, self.allowed, self.back))
        known.drop()
        met.drop()
        return out


def _named(ways: DataFrame, key: list[str], allowed: DataFrame, back: bool) -> DataFrame:
    """Puts ids of edges for what they cost at most: of parallel edges that are as cheap the smaller id counts."""
    ways = cut(ways)
    ends = ("dst", "src") if back else ("src", "dst")
    taken = ways.select(*key, "nodes", F.posexplode("edges").alias("place", "most")).select(*key, "place", "most", F.get("nodes", F.col("place")).alias(ends[0]), F.get("nodes", F.col("place") + 1).alias(ends[1]))
    named = taken.join(allowed.select("src", "dst", "base", F.col("id").alias("edge")), ["src", "dst"]).filter("base <= most").groupBy(*key, "place").agg(F.min("edge").alias("edge"))
    listed = named.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "edge"))), lambda x: x["edge"]).alias("ids"))
    return ways.join(listed, key, "left").select(*key, "nodes", F.coalesce("ids", F.array().cast("array<string>")).alias("edges"))


def nearest(starts: DataFrame, key: list[str], allowed: DataFrame, entered: Callable, kinds: int = 1, back: bool = False) -> Nearest:
    """The nearest goals of ``starts(key, group, id, part)`` over the edges ``allowed(id, src, dst, base, near, far)``, written by near and far, or back over them.

    ``entered(nodes(group, id, part), parts)`` adds gain, penalty and goal: an edge to the node costs its base less
    the gain, 0.25 at least, and the penalty more; goals are numbered by kind, and a start has one of the first kind that
    it reaches.  Gains, penalties and bases are multiples of a quarter, so sums are exact in any order.
    """

    steps = _reversed(allowed) if back else allowed

    def along(nodes: DataFrame, parts: list[int]) -> DataFrame:
        leaving = nodes.select("group", F.col("id").alias("src"), "gain", "penalty")
        return leaving.join(steps.filter(F.col("near").isin(parts)), "src").select("group", "src", "dst", "base", "gain", "penalty", "near", "far")

    known, met = expand(starts.select("group", "id", "part").distinct(), ["group"], [], along, _parts(allowed, "far" if back else "near"), entered, "far")
    made, found, left = Pile("near", "far"), [], starts.select(*key, "group", "id", "part")
    for kind in range(kinds):
        goals = known.whole().filter(F.col("goal") == kind)
        if kind:
            goals = goals.join(left.select("group").distinct(), "group", "left_semi")
        best, tables = _rest(goals, kind, met, made)
        found.append(cut(left.join(best, ["group", "id"]).select(*key, "group", "id", "part", F.lit(kind).alias("kind"), "cost", "goal")))
        tables.drop()
        left = cut(left.join(found[-1].select(*key), key, "left_anti"))
        if left.first() is None:
            break
    if not made.tables:
        made.add(cut(_no_offers(met), "near", "far"), [])
    known.drop()
    met.drop()
    return Nearest(key, allowed, back, trace.united(found), made)


def _no_offers(met: Pile) -> DataFrame:
    zero = F.lit(0.0)
    return met.whole().limit(0).select("group", "src", "dst", "base", "gain", "penalty", zero.alias("rest"), zero.alias("cost"), F.lit("").alias("goal"), F.lit(0).alias("kind"), "near", "far")
