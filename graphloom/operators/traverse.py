"""Bounded subgraphs: selectors, breadth-first hops, boundaries, access, differences.

Hops are loops on the driver over distributed frontiers.  The adjacency is written
once, before the first hop, and never sorted as a whole: each hop joins the frontier
with it and leaves out what is known, which is kept in few tables.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import submap_glob
from ..sources.work import cut, written

LEVELS = ("forbidden", "generated", "editable", "readable", "external")


@dataclass(frozen=True)
class Selector:
    """Nodes named by id, by path glob, or by module and layer and type together."""

    node_ids: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()
    modules: tuple[str, ...] = ()
    layers: tuple[str, ...] = ()
    types: tuple[str, ...] = ()

    def condition(self) -> Column:
        out = F.col("id").isin(*self.node_ids) if self.node_ids else F.lit(False)
        for p in self.paths:
            out = out | F.coalesce(F.replace(F.col("path"), F.lit("\\"), F.lit("/")).rlike(submap_glob(p)), F.lit(False))
        named = [(c, v) for c, v in (("module", self.modules), ("layer", self.layers), ("type", self.types)) if v]
        if named:
            every = F.lit(True)
            for c, v in named:
                every = every & F.col(c).isin(*v)
            out = out | every
        return out

    def ids(self, nodes: DataFrame) -> DataFrame:
        return nodes.filter(self.condition()).select("id")


@dataclass(frozen=True)
class Traversal:
    """How far and along what to go from the seeds."""

    direction: str = "both"
    max_depth: int = 1
    edge_types: tuple[str, ...] = ()
    excluded_edge_types: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.direction not in ("incoming", "outgoing", "both") or self.max_depth < 0:
            raise ValueError("direction must be incoming, outgoing or both, and max_depth 0 or more")


@dataclass(frozen=True)
class Request:
    """A subgraph request: seeds, exclusions, traversal and access by selectors."""

    seeds: Selector
    exclusions: Selector = Selector()
    traversal: Traversal = Traversal()
    access: dict[str, Selector] = field(default_factory=dict)
    default_access: str = "readable"


class SelectionConflict(ValueError):
    """Seeds that are excluded, or nodes that are both editable and forbidden."""


def allowed(edges: DataFrame, t: Traversal) -> DataFrame:
    out = edges
    if t.excluded_edge_types:
        out = out.filter(~F.col("type").isin(*t.excluded_edge_types))
    return out.filter(F.col("type").isin(*t.edge_types)) if t.edge_types else out


def adjacency(edges: DataFrame, direction: str) -> DataFrame:
    """(a, b): from where, to where one may go."""
    out = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    back = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    return {"outgoing": out, "incoming": back, "both": out.union(back)}[direction]


def hops(seeds: DataFrame, adjacent: DataFrame, max_depth: int, excluded: DataFrame | None = None, blocked: DataFrame | None = None, stored: bool = False) -> DataFrame:
    """(id, depth) of all that is reached within ``max_depth`` hops, with the least depth.

    ``excluded`` nodes are never entered; ``blocked`` ones are entered but not left.
    ``stored`` says that the adjacency is read from a written table as it is.
    """
    if max_depth <= 0:
        return seeds.select("id").distinct().withColumn("depth", F.lit(0))
    near = adjacent.select("a", "b").filter("a <> b")
    near = near if stored or max_depth == 1 else cut(near)
    barred, ends = (None if t is None else cut(t.select("id")) for t in (excluded, blocked))
    known = frontier = cut(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    parts = [known]
    for depth in range(1, max_depth + 1):
        leaving = frontier if ends is None else frontier.join(ends, "id", "left_anti")
        found = leaving.select(F.col("id").alias("a")).join(near, "a").select(F.col("b").alias("id")).distinct()
        found = (found if barred is None else found.join(barred, "id", "left_anti")).join(known.select("id"), "id", "left_anti")
        frontier = cut(found.withColumn("depth", F.lit(depth)))
        if frontier.first() is None:
            break
        parts.append(frontier)
        known = known.union(frontier)
        if len(parts) > 6:  # one table again, so that plans do not grow with the depth
            known = cut(known)
            parts = [known]
    return known


@dataclass(frozen=True)
class Submap:
    """A bounded subgraph as tables."""

    nodes: DataFrame
    edges: DataFrame
    boundaries: DataFrame
    access: DataFrame


def create(nodes: DataFrame, edges: DataFrame, request: Request) -> Submap:
    """Selects, traverses and cuts out a subgraph; raises SelectionConflict where the request contradicts itself.

    Nodes and edges are written once, unless they have been, and read from there in every step.
    """
    nodes, edges = written(nodes), written(edges)
    excluded = cut(request.exclusions.ids(nodes))
    seeds = cut(request.seeds.ids(nodes))
    if seeds.join(excluded, "id", "left_semi").first() is not None:
        raise SelectionConflict("a seed is excluded")
    forbidden = request.access["forbidden"].ids(nodes) if "forbidden" in request.access else None
    usable = allowed(edges, request.traversal)
    found = hops(seeds, adjacency(usable, request.traversal.direction), request.traversal.max_depth, excluded, forbidden, stored=True)
    inside = cut(nodes.join(found.select("id"), "id", "left_semi"))
    reached = inside.select("id").distinct()
    return Submap(inside, induced(usable, reached), boundaries(usable, nodes, reached, excluded), access(inside, request))


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends inside."""
    end = lambda c: ids.select(F.col("id").alias(c))
    return edges.join(end("src"), "src", "left_semi").join(end("dst"), "dst", "left_semi")


def boundaries(edges: DataFrame, nodes: DataFrame, inside: DataFrame, excluded: DataFrame) -> DataFrame:
    """edge_id, inside_id, outside_id, direction, reason of the edges with exactly one end inside."""
    mark = lambda c: inside.select(F.col("id").alias(c), F.lit(True).alias(f"in_{c}"))
    both = edges.join(mark("src"), "src", "left").join(mark("dst"), "dst", "left").filter(F.col("in_src").isNull() != F.col("in_dst").isNull())
    out = F.col("in_src").isNotNull()
    named = both.select(F.col("id").alias("edge_id"), F.when(out, F.col("src")).otherwise(F.col("dst")).alias("inside_id"), F.when(out, F.col("dst")).otherwise(F.col("src")).alias("outside_id"), F.when(out, "outgoing").otherwise("incoming").alias("direction"))
    flagged = named.join(excluded.select(F.col("id").alias("outside_id"), F.lit(True).alias("x")).distinct(), "outside_id", "left")
    known = flagged.join(nodes.select(F.col("id").alias("outside_id")), "outside_id", "left_semi")
    return known.select("edge_id", "inside_id", "outside_id", "direction", F.when(F.col("x"), "excluded").otherwise("depth-limit").alias("reason"))


def access(inside: DataFrame, request: Request) -> DataFrame:
    """id, level: the first level in order of precedence whose selector matches, else the default."""
    rules = request.access
    if "editable" in rules and "forbidden" in rules and inside.filter(rules["editable"].condition() & rules["forbidden"].condition()).first() is not None:
        raise SelectionConflict("SUBMAP_ACCESS_CONFLICT")
    level = F.lit(request.default_access)
    for name in reversed(LEVELS):
        if name in rules:
            level = F.when(rules[name].condition(), F.lit(name)).otherwise(level)
    return inside.select("id", level.alias("level"))


def changes(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """(change, key): what was added and what was removed."""
    old, new = before.select(key).distinct(), after.select(key).distinct()
    gone = old.join(new, key, "left_anti").select(F.lit("removed").alias("change"), key)
    return new.join(old, key, "left_anti").select(F.lit("added").alias("change"), key).union(gone)


def access_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, previous, current where the access level differs; null where there was or is none."""
    joined = before.withColumnRenamed("level", "previous").join(after.withColumnRenamed("level", "current"), "id", "full")
    return joined.filter(~F.col("previous").eqNullSafe(F.col("current"))).select("id", "previous", "current")


def availability(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, available: whether a stored node is in the current graph."""
    return ids.select("id").join(nodes.select("id", F.lit(True).alias("a")), "id", "left").select("id", F.coalesce("a", F.lit(False)).alias("available"))


def combined(left: DataFrame, right: DataFrame, mode: str) -> DataFrame:
    """Ids of two selections put together: replace, add or toggle."""
    a, b = left.select("id").distinct(), right.select("id").distinct()
    if mode == "replace":
        return b
    if mode == "add":
        return a.union(b).distinct()
    if mode == "toggle":
        return a.union(b).groupBy("id").count().filter("count = 1").select("id")
    raise ValueError(mode)


def any_of(conditions: Iterable[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out
