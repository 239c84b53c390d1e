"""Connected components of an undirected graph, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _with_lowest(pairs: DataFrame) -> DataFrame:
    """u, v, m of the pairs: m is the smallest node among u and the v of its pairs.  One shuffle; a hub's pairs are sorted and spill."""
    return pairs.select("u", "v", F.least("u", F.min("v").over(W.partitionBy("u"))).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # Strictly larger neighbours move to the lowest node of the neighbourhood.
    return _with_lowest(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    # The node itself and its other smaller neighbours move to the lowest one.
    moved = _with_lowest(down).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return moved.filter("u <> v").distinct()


def connected_components(edges: DataFrame, write: Callable[[DataFrame], DataFrame], drop: Callable[[DataFrame], None] = lambda t: None, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(u, v)``; component is the smallest node reachable.

    ``write`` cuts the lineage (a checkpoint or a written table) after each round
    and ``drop`` may remove a table of an earlier round.  Loops and repeated edges
    do no harm; null ends are ignored; no edges give an empty table.  Each round
    halves paths, so long chains end after few of them; nothing is collected but
    a count and a checksum.
    """
    mark = lambda t: tuple(t.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())
    now = write(edges.select("u", "v").filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = mark(now)
    for _ in range(rounds if seen[0] else 0):
        after = write(_small_star(_large_star(now)))
        drop(now)
        now, last = after, seen
        seen = mark(now)
        if seen == last:
            break
    else:
        if seen[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
