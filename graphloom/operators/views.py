"""Views of a graph: filtered nodes, what a node's measures mean in words, internal parts, orders, places."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.files import MOST_BYTES
from ..sources.work import cut
from ..functions.text import health_key, title_case
from .components import connected_components
from .rules import positioned

PARTS = ("component", "main-component", "subcomponent", "page")
PARENTS = ("main-component", "component", "page", "route")
CONTAINERS = ("components", "pages")


@dataclass(frozen=True)
class Filter:
    """What nodes must meet, all of it; what is not set holds for every node.

    among are tables of ids (a subgraph, a domain, a module's trace, orphans, reviewed
    nodes), each of which must hold the node; health needs a score.
    """

    types: tuple[str, ...] | None = None
    text: str = ""
    health: tuple[str, ...] | None = None
    hide_auxiliary: bool = False
    among: tuple[DataFrame, ...] = ()
    lacking: tuple[DataFrame, ...] = ()


def filtered(nodes: DataFrame, f: Filter) -> DataFrame:
    """The nodes that meet the filter; the text is looked for in any case in label, path, id, module, layer, type and the type's name."""
    out = nodes
    if f.types is not None:
        out = out.filter(F.col("type").isin(*f.types))
    if f.hide_auxiliary:
        out = out.filter(F.coalesce(F.col("type") != "auxiliary", F.lit(True)))
    if f.health is not None:
        out = out.filter(F.col("score").isNotNull() & health_key(F.col("score")).isin(*f.health))
    if wanted := f.text.strip().lower():
        hay = F.concat_ws("\n", F.col("label"), F.col("path"), F.col("id"), F.col("module"), F.col("layer"), F.col("type"), title_case(F.col("type")))
        out = out.filter(F.contains(F.lower(hay), F.lit(wanted)))
    for ids in f.among:
        out = out.join(ids.select("id").distinct(), "id", "left_semi")
    for ids in f.lacking:
        out = out.join(ids.select("id").distinct(), "id", "left_anti")
    return out


def inside_rectangle(placed: DataFrame, left: float, top: float, right: float, bottom: float) -> DataFrame:
    """id of ``placed(id, x, y, width, height)`` whose centre is within the rectangle, its edges included."""
    x, y = F.col("x") + F.col("width") / 2, F.col("y") + F.col("height") / 2
    return placed.filter(x.between(left, right) & y.between(top, bottom) & F.col("id").isNotNull()).select("id")


def narratives(nodes: DataFrame, edges: DataFrame, evidence: DataFrame, related: int = 8, named: int = 6, write=cut) -> DataFrame:
    """id, cohesion, coupling, related: measures in words, and the first related nodes by id.

    ``evidence(id, internal_relations, external_relations, outgoing, incoming, inside_folder)``.
    External modules are named in order; of outgoing dependencies on other modules the
    first labels are.  The first few of a node's neighbours are found with a ranked window,
    which Spark cuts down before it shuffles.  The edges with both ends' names are joined
    and written once, as all three lists read them from either side.
    """
    module = nodes.select("id", "module", "label")
    end = lambda c: module.select(F.col("id").alias(c), F.col("module").alias(f"{c}_module"), F.col("label").alias(f"{c}_label"))
    joined = write(edges.select("src", "dst").filter("src <> dst").distinct().join(end("src"), "src").join(end("dst"), "dst"))
    side = lambda a, b, out: F.struct(F.col(a).alias("id"), F.col(b).alias("other"), F.col(f"{a}_module").alias("own"), F.col(f"{b}_module").alias("module"), F.col(f"{b}_label").alias("label"), F.lit(out).alias("out"))
    both = joined.select(F.inline(F.array(side("src", "dst", True), side("dst", "src", False))))
    outside = both.filter("own <> module")
    modules = outside.groupBy("id").agg(F.array_sort(F.collect_set("module")).alias("modules"))  # as many as there are modules at most
    first = lambda df, key, n, name: df.withColumn("__n", F.row_number().over(W.partitionBy("id").orderBy(*key))).filter(F.col("__n") <= n).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("__n", key[0]))).alias("__l")).select("id", F.transform("__l", lambda x: x[key[0]]).alias(name))
    labels = first(outside.filter("out").select("id", "label", "other"), ["label", "other"], named, "labels")
    near = first(both.select("id", "other").distinct(), ["other"], related, "related")
    e = evidence.join(module.select("id", "module"), "id").join(modules, "id", "left").join(labels, "id", "left").join(near, "id", "left")
    text = lambda c: F.col(c).cast("string")
    cohesion = F.concat(text("internal_relations"), F.lit(" relations inside module "), F.coalesce("module", F.lit("")), F.lit("; "), text("external_relations"), F.lit(" relations outside module; "), text("outgoing"), F.lit(" outgoing dependencies; "), text("incoming"), F.lit(" detected usages"), F.when(F.col("inside_folder"), "; located inside its feature folder").otherwise(""))
    n = F.coalesce(F.size("modules"), F.lit(0))
    n = F.when(n > 0, n).otherwise(0)
    coupling = F.concat(text("outgoing"), F.lit(" outgoing dependencies; "), n.cast("string"), F.lit(" external modules: "), F.when(n > 0, F.array_join("modules", ", ")).otherwise("none"), F.coalesce(F.concat(F.lit("; external deps: "), F.array_join("labels", ", ")), F.lit("")))
    return e.select("id", cohesion.alias("cohesion"), coupling.alias("coupling"), F.coalesce("related", F.array().cast("array<string>")).alias("related"))


def _container(segments: Column) -> Column:
    """Place, from 0, of the last container folder among the first ones of each name; -1 if there is none."""
    return F.greatest(*(F.array_position(segments, F.lit(c)) for c in CONTAINERS)).cast("int") - 1


def _below(path: Column) -> Column:
    """The folders below the container folder."""
    segments = F.split(path, "/")
    at = _container(segments)
    return F.when(at >= 0, F.slice(segments, at + 2, F.greatest(F.size(segments) - at - 2, F.lit(0))))


def is_internal(kind: Column, path: Column) -> Column:
    """Whether a component or page lies in a folder below components or pages whose name begins with an underscore."""
    return F.coalesce(kind.isin(*PARTS) & F.exists(_below(path), lambda s: s.startswith("_")), F.lit(False))


def internal_parents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, parent, tier for internal parts: what they belong to.

    Tier 0: the entry (index file) of the nearest folder above the underscored one, the
    first path of several; tier 1: a neighbour of the same module, by kind (main
    component, component, page, route), then id; tier 2: any such node of the module, by
    kind, then path.  Internal parts are no parents.  Without any, parent and tier are null.
    """
    marked = nodes.select("id", "type", "module", "path", is_internal(F.col("type"), F.col("path")).alias("internal"))
    parts, open_ = marked.filter("internal").select("id", "module", "path"), marked.filter("not internal")
    segments = F.split("path", "/")
    head = F.slice(segments, F.lit(1), _container(segments) + 1)
    below = _below(F.col("path"))
    first = F.array_position(F.transform(below, lambda s: s.startswith("_")), F.lit(True)).cast("int") - 1
    bases = F.when(first > 0, F.transform(F.sequence(F.lit(1), first), lambda k: F.array_join(F.concat(head, F.slice(below, F.lit(1), k)), "/")))
    tried = parts.select("id", F.posexplode(bases).alias("depth", "folder"))
    entries = open_.filter(F.col("path").rlike(r"/index\.[^/]*\z")).groupBy(F.regexp_replace("path", r"/index\.[^/]*\z", "").alias("folder")).agg(F.min(F.struct("path", "id")).alias("e"))
    by_path = tried.join(entries, "folder").groupBy("id").agg(F.max_by("e.id", "depth").alias("p0"))
    able = open_.filter(F.col("type").isin(*PARENTS))
    rank = (F.array_position(F.array(*map(F.lit, PARENTS)), F.col("type"))).alias("rank")
    near = edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).union(edges.select("dst", "src")).join(parts.select("id", F.col("module").alias("own")), "id")
    by_edge = near.join(able.select(F.col("id").alias("other"), "module", rank), "other").filter("own = module and id <> other").groupBy("id").agg(F.min(F.struct("rank", "other")).alias("m")).select("id", F.col("m.other").alias("p1"))
    by_module = able.groupBy("module").agg(F.min(F.struct(rank, F.coalesce("path", F.lit("")).alias("path"), "id")).alias("m")).select("module", F.col("m.id").alias("p2"))
    found = parts.join(by_path, "id", "left").join(by_edge, "id", "left").join(by_module, "module", "left")
    tier = F.when(F.col("p0").isNotNull(), 0).when(F.col("p1").isNotNull(), 1).when(F.col("p2").isNotNull(), 2)
    return found.select("id", F.coalesce("p0", "p1", "p2").alias("parent"), tier.alias("tier"))


def domain_order(nodes: DataFrame, relations: DataFrame, write, drop=lambda t: None) -> DataFrame:
    """id, component, position of nodes joined by relations.

    Components with more neighbours come first, then those with the smaller first label;
    within one, nodes with more neighbours, with more outgoing and fewer incoming
    relations, then by label and id.  Nodes without relations are components of their own.
    """
    named = write(nodes.select("id", "label"))
    end = lambda c: named.select(F.col("id").alias(c))
    inner = write(relations.select("src", "dst").join(end("src"), "src", "left_semi").join(end("dst"), "dst", "left_semi").select("src", "dst"))
    side = lambda a, b, out: F.struct(F.col(a).alias("id"), F.col(b).alias("other"), F.lit(out).alias("o"), F.lit(1 - out).alias("i"))
    both = inner.select(F.inline(F.array(side("src", "dst", 1), side("dst", "src", 0))))
    comp = connected_components(inner.select(F.col("src").alias("u"), F.col("dst").alias("v")), write, drop)
    # What is known of a node is added up by id and joined once.
    none = F.lit(None).cast("string")
    near = both.filter("id <> other").select("id", "other").distinct()
    told = near.select("id", F.lit(1).alias("degree"), F.lit(0).alias("outgoing"), F.lit(0).alias("incoming"), none.alias("component"))
    told = told.union(both.select("id", F.lit(0), "o", "i", none)).union(comp.select("node", F.lit(0), F.lit(0), F.lit(0), F.col("component").cast("string")))
    told = told.groupBy("id").agg(*(F.sum(c).alias(c) for c in ("degree", "outgoing", "incoming")), F.max("component").alias("component"))
    known = named.join(told, "id", "left").select("id", "label", F.coalesce("component", "id").alias("component"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("degree", "outgoing", "incoming")))
    whole = known.groupBy("component").agg(F.sum("degree").alias("whole"), F.min("label").alias("first_label"))
    order = [F.col("whole").desc(), F.col("first_label"), F.col("component"), F.col("degree").desc(), F.col("outgoing").desc(), F.col("incoming"), F.col("label"), F.col("id")]
    # Written first, since ranges are drawn by reading the rows once more.
    return positioned(write(known.join(whole, "component")), order).select("id", "component", "position")


def skipped_warning(skipped: DataFrame, limit_mib: int = MOST_BYTES >> 20) -> str | None:
    """A sentence on files that were too large to read: how many, and the first five by path; None if there are none."""
    n = skipped.count()
    if not n:
        return None
    shown = [r.path for r in skipped.select("path").orderBy("path").limit(5).collect()]
    rest = f", and {n - len(shown)} more" if n > len(shown) else ""
    return f"{n} source file{'s' if n > 1 else ''} larger than {limit_mib} MiB {'were' if n > 1 else 'was'} skipped: {', '.join(shown)}{rest}."
