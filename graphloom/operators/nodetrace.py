"""Traces of nodes: the way back to where a front begins, the way on to a table, and all between.

Many nodes are traced at once.  Every table carries the node it belongs to as
``source``; costs, ways and reach are kept apart by it, so one set of joins serves all.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.work import cut
from . import trace
from .nearest import nearest, part_of
from .trace import REACH

#: Types that may go on from an ancestor, and types of ancestors that may carry them on.
CONTINUED = ("component", "subcomponent", "hook")
CONTAINERS = ("route", "page", "main-component", "component", "subcomponent")


@dataclass(frozen=True)
class Traces:
    """paths: a row a source with both ways and what is missing; members: (source, id) of all on any way;
    member_edges: (source, edge) between members."""

    paths: DataFrame
    members: DataFrame
    member_edges: DataFrame


def spread(starts: DataFrame, adjacent: DataFrame, bound: int = REACH) -> DataFrame:
    """(source, id) of all that ``starts(source, id)`` reach within the bound over ``adjacent(a, b)``, each source for itself."""
    known = frontier = cut(starts.select("source", "id").distinct())
    for n in range(bound):
        found = frontier.withColumnRenamed("id", "a").join(adjacent, "a").select("source", F.col("b").alias("id")).distinct().join(known, ["source", "id"], "left_anti")
        frontier = cut(found)
        if frontier.first() is None:
            break
        known = known.union(frontier)
        if n % 6 == 5:
            known = cut(known)
    return cut(known)


def node_paths(nodes: DataFrame, edges: DataFrame, selected: DataFrame, entry_paths: tuple[str, ...] = ()) -> DataFrame:
    """The ways of node_traces() alone: its ``paths`` without the counts of members, which cost a search from and to all stores."""
    return _sides(nodes, edges, selected, entry_paths)[0]


def node_traces(nodes: DataFrame, edges: DataFrame, selected: DataFrame, entry_paths: tuple[str, ...] = ()) -> Traces:
    """The traces of ``selected(id)``; ids that are no nodes have none.

    The way back leads over edges of the least cost to the nearest route (one of the
    entries, if any are named).  The way on leads to the cheapest table, else entity,
    where nodes that share words with the source, and with those of its ancestors that
    contain it, cost less.  If there is none, components, subcomponents and hooks go on from
    the nearest such ancestor that has one.
    """
    sides, allowed, kinds, origins = _sides(nodes, edges, selected, entry_paths)
    members = cut(_members(sides, allowed, kinds, origins))
    counts = members.join(kinds, "id").groupBy("source").agg(F.count_if(F.col("type") == "table").alias("n_tables"), F.count_if(F.col("type") == "endpoint").alias("n_endpoints"))
    paths = sides.join(counts, "source", "left").withColumn("path_count", F.greatest(F.lit(1), "n_endpoints", "n_tables"))
    end = lambda c: members.select("source", F.col("id").alias(c))
    inner = allowed.select(F.col("id").alias("edge"), "src", "dst").join(end("src"), "src").join(end("dst"), ["source", "dst"]).select("source", "edge")
    return Traces(paths, members, inner)


def _sides(nodes: DataFrame, edges: DataFrame, selected: DataFrame, entry_paths: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Both ways of each source; and allowed edges, types of nodes, origins, all from written tables."""
    optional = lambda c: F.col(c) if c in nodes.columns else F.lit(None).cast("string")
    known = cut(nodes.select("id", "type", "module", "label", "path", optional("action").alias("action"), optional("method").alias("method"), part_of(F.col("type")).alias("part")), "part")
    ends = [part_of(F.col("src_type")).alias("near"), part_of(F.col("dst_type")).alias("far")]
    allowed = cut(trace.trace_edges(edges, known).withColumn("base", trace.edge_weight()).select("id", "src", "dst", "base", *ends), "near", "far")
    chosen = cut(known.join(selected.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("source"), "type", "module", "label", "part"))
    origin = (F.col("type") == "route") & (F.coalesce(F.col("path").isin(*entry_paths), F.lit(False)) if entry_paths else F.lit(True))
    starts = chosen.select("source", F.col("source").alias("id"), "part")
    none, free = F.array().cast("array<string>"), F.lit(0.0)

    def behind(new: DataFrame, parts: list[int]) -> DataFrame:
        of = known.filter(F.col("part").isin(parts)).select("id", F.when(origin, 0).alias("goal"))
        return new.join(of, "id").select("group", "id", "part", free.alias("gain"), free.alias("penalty"), "goal")

    left = nearest(starts.withColumn("group", F.lit("")), ["source"], allowed, behind, back=True).ways()

    holds = known.filter(F.col("part").isin(*(part_of(F.lit(t)) for t in CONTAINERS))).filter(~origin & F.col("type").isin(*CONTAINERS)).select("id", F.col("module").alias("their"), F.col("label").alias("name"), "part")
    above = left.select("source", F.posexplode("nodes").alias("at", "id")).filter("at > 0").join(holds, "id")
    containers = cut(above.join(chosen.select("source", "module", "type"), "source").filter("their <=> module").select("source", "at", "id", "type", "name", "part"))
    named = containers.groupBy("source").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", trace.token_column(F.col("name")).alias("t")))), lambda x: x["t"])).alias("more"))
    tokens = F.array_sort(F.array_distinct(F.concat(trace.token_column(F.col("label")), F.coalesce("more", none))))
    asked = chosen.join(named, "source", "left").select("source", tokens.alias("tokens"))
    groups = cut(asked.groupBy("tokens").agg(F.min("source").alias("group")).withColumn("singles", trace.singulars(F.col("tokens"))))
    grouped = cut(asked.join(groups, "tokens").select("source", "group"))
    words, hay = trace.boost_parts(F.col("kind"), F.col("label"), F.col("path"), F.col("action"))

    def ahead(new: DataFrame, parts: list[int]) -> DataFrame:
        of = known.filter(F.col("part").isin(parts)).select("id", F.col("type").alias("kind"), "label", "path", "action", "method")
        # whatever gains holds a token; only then its words are taken apart
        gain = F.when(F.exists("singles", lambda t: F.contains(hay, t)), trace.boost_of(F.col("kind"), words, hay, F.col("tokens"), F.col("singles"))).otherwise(0.0)
        penalty = trace.intent_penalty(F.col("kind"), F.col("action"), F.col("method"), F.col("tokens"))
        goal = F.when(F.col("kind") == "table", 0).when(F.col("kind") == "entity", 1)
        return new.join(of, "id").join(groups, "group").select("group", "id", "part", gain.alias("gain"), penalty.alias("penalty"), goal.alias("goal"))

    kinds = known.select("id", "type")
    right = nearest(starts.join(grouped, "source"), ["source"], allowed, ahead, kinds=2).ways()

    lost = cut(containers.filter(F.col("type").isin(*CONTINUED)).join(right.select("source"), "source", "left_anti").join(grouped, "source").select("source", "at", "group", "id", "part"))
    carried = lost.select("source", F.col("id").alias("continued_from"), none.alias("c_nodes"), none.alias("c_edges"))
    if lost.first() is not None:
        wide = nearest(lost, ["source", "at"], allowed, ahead, kinds=2)
        first = wide.found.groupBy("source").agg(F.min("at").alias("at"))
        ways = replace(wide, found=cut(wide.found.join(first, ["source", "at"]))).ways()
        carried = ways.select("source", F.get("nodes", F.lit(0)).alias("continued_from"), F.col("nodes").alias("c_nodes"), F.col("edges").alias("c_edges"))

    alone = F.array("source")
    joined = chosen.select("source").join(left.select("source", F.col("nodes").alias("l"), F.col("edges").alias("l_edges")), "source", "left").join(right.select("source", F.col("nodes").alias("r"), F.col("edges").alias("r_edges")), "source", "left").join(carried, "source", "left")
    sides = joined.select(
        "source", "continued_from", F.coalesce("l", alone).alias("left_nodes"), F.coalesce("l_edges", none).alias("left_edges"), F.coalesce("r", "c_nodes", alone).alias("right_nodes"), F.coalesce("r_edges", "c_edges", none).alias("right_edges"),
        F.col("l").isNull().alias("missing_start"), F.coalesce("r", "c_nodes").isNull().alias("missing_persistence"),
    )
    onward = F.slice("right_nodes", F.lit(2), F.size("right_nodes"))
    sides = cut(sides.select("*", F.array_distinct(F.concat(F.reverse("left_nodes"), onward)).alias("primary_nodes"), F.array_distinct(F.concat("left_edges", "right_edges")).alias("primary_edges"), (~F.col("missing_start") & ~F.col("missing_persistence")).alias("complete")))
    return sides, allowed, kinds, known.filter(origin).select("id")


def _members(sides: DataFrame, allowed: DataFrame, kinds: DataFrame, origins: DataFrame) -> DataFrame:
    """(source, id): all on a way from the root on to a table (an entity, if no table is reached) or from an origin to the
    root, the root being the source or the ancestor it goes on from; and the source and its way back."""
    out = cut(allowed.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct())
    back = cut(out.select(F.col("b").alias("a"), F.col("a").alias("b")))
    roots = sides.select("source", F.coalesce("continued_from", "source").alias("id"))
    forward, backward = spread(roots, out), spread(roots, back)
    stored = cut(forward.join(kinds.filter("type in ('table', 'entity')"), "id"))
    tables = stored.filter("type = 'table'")
    stores = tables.select("source", "id").union(stored.filter("type = 'entity'").join(tables.select("source").distinct(), "source", "left_anti").select("source", "id"))
    leading = spread(stores, back)
    following = spread(backward.join(origins, "id", "left_semi"), out)
    onward = forward.join(leading, ["source", "id"], "left_semi").select("source", "id")
    inward = backward.join(following, ["source", "id"], "left_semi").select("source", "id")
    own = sides.select("source", F.explode(F.concat(F.array("source"), "left_nodes")).alias("id"))
    return onward.union(inward).union(own).union(roots).distinct()
