"""Templates of any number of projects: the order in which they apply, circles and unknown names, and what they add up to.

A template comes after all that it requires, as in a depth-first walk over each project's list.  That order needs no
walk: a template is reached first on the smallest of its ways, compared place by place, and is finished after
everything whose way begins with its own.  So each way ends in a mark above all places, and ways in order are templates
in order.  Smallest ways are found for all projects at once, a round for each step, by joins on the template; the first
circle or unknown name that the walk would meet is the smallest of the ways that end so.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.work import cut, drop

#: Above every place in a list; a way that ends in it comes after those that lead on.
LAST = 2**31 - 1


class Expanded(NamedTuple):
    """ordered(project, template, at): ``at`` sorts a project's templates; faults(project, message): one row a project."""

    ordered: DataFrame
    faults: DataFrame


def expanded(wanted: DataFrame, templates: DataFrame, requires: DataFrame) -> Expanded:
    """What projects want, ``(project, pos, template)``, with all that it requires, ``(template, pos, needs)``, in order.

    ``templates(template)`` are those that exist.  A project whose list leads to a circle or to an unknown template has the
    first such fault, named with the way, and no order.  Positions count from any number and may have gaps; repeated rows
    count once, rows with a null are left out, a project without rows has none in either table.
    """
    known = templates.select("template").filter("template IS NOT NULL").distinct()
    steps = requires.select(F.col("template").alias("by"), F.col("pos").cast("int").alias("step"), "needs").dropna().distinct()
    start = wanted.select("project", F.col("pos").cast("int").alias("step"), "template").dropna()
    way = F.struct(F.array("step").alias("places"), F.array("template").alias("names")).alias("way")
    front = cut(start.groupBy("project", "template").agg(F.min("step").alias("step")).select("project", "template", way))
    best, failed = front, []
    while not front.isEmpty():
        here = cut(front.join(known.withColumn("known", F.lit(True)), "template", "left"))
        unknown = here.filter("known IS NULL").select("project", "way", F.lit("unknown").alias("why"))
        on = here.filter("known").join(steps, F.col("template") == F.col("by"))
        longer = F.struct(F.array_append("way.places", F.col("step")).alias("places"), F.array_append("way.names", F.col("needs")).alias("names"))
        reached = cut(on.select("project", F.col("needs").alias("template"), longer.alias("way"), F.array_contains("way.names", F.col("needs")).alias("circle")))
        circles = reached.filter("circle").select("project", "way", F.lit("circle").alias("why"))
        failed.append(cut(unknown.unionByName(circles).groupBy("project").agg(F.min(F.struct("way", "why")).alias("first"))))
        new = reached.filter("NOT circle").groupBy("project", "template").agg(F.min("way").alias("way"))
        old = best.withColumnRenamed("way", "old")
        better = cut(new.join(old, ["project", "template"], "left").filter("old IS NULL OR way < old").select("project", "template", "way"))
        grown = cut(best.unionByName(better).groupBy("project", "template").agg(F.min("way").alias("way")))
        drop(here, reached, front, best)
        front, best = better, grown
    ordered = best.select("project", "template", F.array_append("way.places", F.lit(LAST)).alias("at"))
    if not failed:
        return Expanded(ordered, best.select("project", F.lit("").alias("message")).limit(0))
    drop(front)
    first = failed[0]
    for more in failed[1:]:
        first = first.unionByName(more)
    faults = cut(first.groupBy("project").agg(F.min("first").alias("first")).select("project", _message(F.col("first")).alias("message")))
    drop(*failed)
    return Expanded(ordered.join(faults, "project", "left_anti"), faults)


def _message(first: Column) -> Column:
    names = first["way"]["names"]
    last, owner = F.element_at(names, -1), F.try_element_at(names, F.lit(-2))
    ring = F.slice(names, F.array_position(names, last).cast("int"), F.size(names))
    unknown = F.concat(F.lit("Unknown template: "), last, F.coalesce(F.concat(F.lit(" required by "), owner), F.lit("")))
    return F.when(first["why"] == "unknown", unknown).otherwise(F.concat(F.lit("Template dependency cycle: "), F.array_join(ring, " -> ")))


def lists(ordered: DataFrame) -> DataFrame:
    """project, templates of ``ordered``: each project's templates as one list, for display (its length is that of the list)."""
    return ordered.groupBy("project").agg(F.array_sort(F.collect_list(F.struct("at", "template"))).alias("all")).select("project", F.col("all.template").alias("templates"))


def enabled(maps: DataFrame) -> DataFrame:
    """(project, pos, template) of normalised project maps: ``base`` first, then the list without it; an empty list is the default one."""
    from .projectmaps import TEMPLATES

    listed = F.when(F.coalesce(F.size("templates"), F.lit(0)) > 0, F.col("templates")).otherwise(F.array(*map(F.lit, TEMPLATES)))
    whole = F.concat(F.array(F.lit("base")), F.array_remove(listed, "base"))
    return maps.select(F.col("repo").alias("project"), F.posexplode(whole).alias("pos", "template"))


def _placed(ordered: DataFrame, parts: DataFrame, own: DataFrame | None, columns: list[str]) -> DataFrame:
    """Rows of templates at the place of their template, and the projects' own rows behind all of them."""
    rows = ordered.join(parts.select("template", *columns), "template").select("project", "at", *columns)
    if own is None:
        return rows
    return rows.unionByName(own.select("project", F.array(F.lit(LAST), F.lit(LAST)).alias("at"), *columns))


def entries(ordered: DataFrame, parts: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """project, section, id, field, value, first: catalogue entries of ``(template, section, pos, id, field, value)`` laid one on another.

    Of a field the value of the last template counts (in one template, of the last position, then the greater value), a null as
    well; fields that only earlier ones have stay.  ``first`` (at, pos) sorts a section's entries: an entry stays where it came
    first.  ``own`` has the project's own entries, which come last, with ``project`` in the place of ``template``.
    Rows without section, id or field are left out.
    """
    columns = ["section", "pos", "id", "field", "value"]
    rows = _placed(ordered, parts, own, columns).dropna(subset=["section", "id", "field"])
    last = F.max(F.struct("at", "pos", F.struct("value").alias("v"))).alias("last")
    fields = rows.groupBy("project", "section", "id", "field").agg(last, F.min(F.struct("at", "pos")).alias("first"))
    places = fields.groupBy("project", "section", "id").agg(F.min("first").alias("first"))
    return fields.drop("first").join(places, ["project", "section", "id"]).select("project", "section", "id", "field", F.col("last.v.value").alias("value"), "first")


def options(ordered: DataFrame, parts: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """project, path, value: nested options of ``(template, path array, value)`` laid one on another, objects merged by name.

    ``path`` leads to a value, JSON text; the value ``{}`` is an object, which its own rows may fill.  A later value takes the
    place of an earlier one and of all below it; a later object takes the place of an earlier value, not of an object.
    Of equal paths in one template the greater value counts.  Objects that hold nothing are rows of value ``{}``.
    Null values are JSON's null; rows without path are left out.
    """
    given = _placed(ordered, parts, own, ["path", "value"]).filter("path IS NOT NULL AND size(path) > 0")
    given = given.select("project", "at", "path", F.coalesce("value", F.lit("null")).alias("value"))
    above = F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", 1, n))
    # Every object on the way to a value is one that its template gives.
    spread = given.select("project", "at", F.size("path").alias("depth"), F.col("value").alias("leaf"), F.explode(above).alias("path"))
    spread = spread.select("project", "path", "at", F.when(F.size("path") == F.col("depth"), F.col("leaf")).otherwise("{}").alias("value"))
    plain = F.col("value") != "{}"
    by_path = spread.groupBy("project", "path").agg(
        F.max(F.struct("at", plain.alias("plain"), "value")).alias("last"), F.max(F.when(plain, F.col("at"))).alias("wall"),
    )
    # What stands below a value that came later is gone, be an object there again or not.
    prefixes = by_path.select("project", "path", "last", F.explode(above).alias("up"))
    walls = by_path.filter("wall IS NOT NULL").select("project", F.col("path").alias("up"), "wall")
    hidden = prefixes.filter("size(up) < size(path)").join(walls, ["project", "up"]).filter("last.at < wall").select("project", "path").distinct()
    alive = by_path.select("project", "path", F.col("last.value").alias("value")).join(hidden, ["project", "path"], "left_anti")
    filled = alive.filter("size(path) > 1").select("project", F.expr("slice(path, 1, size(path) - 1)").alias("path")).distinct()
    return alive.filter("value <> '{}'").unionByName(alive.filter("value = '{}'").join(filled, ["project", "path"], "left_anti"))


def rules(ordered: DataFrame, parts: DataFrame) -> DataFrame:
    """project, rule, first: the rules of ``(template, pos, rule)``, each once, at the place where it came first; empty names go."""
    rows = _placed(ordered, parts, None, ["pos", "rule"]).filter("rule <> ''")
    return rows.groupBy("project", "rule").agg(F.min(F.struct("at", "pos")).alias("first"))
