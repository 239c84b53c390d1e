"""Mixing sources to target weights by hierarchical budgeting.

Leaves are sources within a language within a domain.  A token budget goes down
that tree: among siblings it is shared in proportion to their weights, none
above what its subtree can supply (its tokens times the epochs allowed), and
what one cannot take goes to its siblings; only what all siblings together
cannot take is left to the level above, whose node is capped by the same supply.
Shares are whole tokens, rounded down.

A leaf with a share of e whole epochs and a rest takes each document e times,
and of the next epoch's order, which is seeded by the epoch and differs from
leaf to leaf, the prefix of documents that begin within the rest.

Leaves are few; documents are never sorted.  A leaf's order is cut into
``SLOTS`` slots by hash, the tokens of each slot are summed, and only the slot
where the rest ends is put in order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Written

LEVELS = ("domain", "lang", "source")
SLOT_DIGITS = 3
NONE = "(none)"


@dataclass(frozen=True)
class Mixture:
    """Weights by name at each level (1 if not named), the share of all supplied tokens
    that is the budget, and how often a document may be taken at most."""

    domain: dict[str, int] = field(default_factory=dict)
    lang: dict[str, int] = field(default_factory=dict)
    source: dict[str, int] = field(default_factory=dict)
    budget_percent: int = 60
    epochs: int = 2
    seed: int = 11

    def weight(self, level: str) -> Column:
        named = getattr(self, level)
        out = F.lit(1)
        for name, w in sorted(named.items()):
            out = F.when(F.col(level) == name, F.lit(w)).otherwise(out)
        return out.cast("long")


#: The production mixture: two of four domains count more, English counts for less than its share.
PRODUCTION = Mixture(domain={"d0": 3, "d1": 2}, lang={"en": 4, "de": 2, "fr": 2, "es": 2})


def domain_of(source: Column) -> Column:
    """The domain of a source: d0 .. d3 by the number at the end of its name, else d0."""
    digits = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.concat(F.lit("d"), (F.when(digits == "", F.lit(0)).otherwise(digits.cast("long")) % 4).cast("string"))


def token_count(text: Column) -> Column:
    """Words of a whole text: runs of anything but space and \\x09-\\x0D; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _order(seed: int, epoch: Column, source: str, lang: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), source, lang).cast("binary"))


def shared_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``given`` to ``nodes(parent.., name, weight, supply, budget)``: shares of the parent's budget.

    With siblings in order of supply / weight, those that their supply limits come
    first; each is limited if its supply is not above its share of what those
    before it leave.  The tables have one row per node, not per document.
    """
    w = W.partitionBy(*parent).orderBy(F.col("supply") / F.col("weight"), name) if parent else W.partitionBy(F.lit(0)).orderBy(F.col("supply") / F.col("weight"), name)
    before = F.coalesce(F.sum("supply").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(w.rowsBetween(0, W.unboundedFollowing))
    left = F.greatest(F.col("budget") - before, F.lit(0))
    n = nodes.withColumn("left_", left).withColumn("rest_", rest)
    limited = F.col("supply").cast("decimal(38,0)") * F.col("rest_") <= F.col("left_").cast("decimal(38,0)") * F.col("weight")
    first_free = F.min(F.when(~limited, F.struct(F.col("supply") / F.col("weight"), F.col(name), F.col("left_"), F.col("rest_")))).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    n = n.withColumn("free_", first_free)
    share = F.expr("cast(floor(cast(free_.left_ as decimal(20,0)) * cast(weight as decimal(10,0)) / cast(free_.rest_ as decimal(10,0))) as long)")
    is_before = F.col("free_").isNull() | (F.struct(F.col("supply") / F.col("weight"), F.col(name)) < F.struct(F.col("free_.col1"), F.col(f"free_.{name}")))
    return n.withColumn("given", F.when(is_before, F.col("supply")).otherwise(F.least(share, F.col("supply")))).drop("left_", "rest_", "free_")


def budgets(sizes: DataFrame, mixture: Mixture) -> DataFrame:
    """(domain, lang, source, tokens, given) from ``sizes(domain, lang, source, tokens)``."""
    leaves = sizes.withColumn("supply", F.col("tokens") * mixture.epochs)
    total = F.expr(f"(sum(tokens) over ()) * {int(mixture.budget_percent)} div 100")
    level = leaves.groupBy("domain").agg(F.sum("supply").alias("supply"), F.sum("tokens").alias("tokens")).withColumn("budget", total).withColumn("weight", mixture.weight("domain"))
    given = shared_out(level, [], "domain").select("domain", F.col("given").alias("budget"))
    for depth in (1, 2):
        keys = list(LEVELS[: depth + 1])
        level = leaves.groupBy(*keys).agg(F.sum("supply").alias("supply"), F.sum("tokens").alias("tokens")).join(given.select(*keys[:-1], "budget"), keys[:-1]).withColumn("weight", mixture.weight(keys[-1]))
        given = shared_out(level, keys[:-1], keys[-1]).select(*keys, "tokens", F.col("given").alias("budget"))
    return given.withColumnRenamed("budget", "given")


def _leaf_table(leaves: DataFrame, most: int = 20_000) -> DataFrame:
    """A table with a row per leaf, broadcast if it is checked to have few; else joined by shuffling."""
    return F.broadcast(leaves) if leaves.limit(most + 1).count() <= most else leaves


def _keyed(docs: DataFrame, mixture: Mixture, *keep: str) -> DataFrame:
    """keep.., and the leaf and tokens of each document, under names of this module's own."""
    leaf = {"__loom_lang": F.coalesce("lang", F.lit(NONE)), "__loom_source": F.coalesce("source", F.lit(NONE)), "__loom_n": token_count(F.col("text"))}
    return docs.select(*keep, *(c.alias(k) for k, c in leaf.items()), domain_of(leaf["__loom_source"]).alias("__loom_domain"))


def _marks(docs: DataFrame, mixture: Mixture) -> DataFrame:
    """For each leaf: whole epochs, the rest, and the last place of its order that is taken in the last epoch."""
    out = Written(docs.sparkSession, "mixing")
    named = _keyed(docs, mixture, "doc_id").select("doc_id", *(F.col(f"__loom_{k}").alias(k) for k in LEVELS), F.col("__loom_n").alias("n_tokens"))
    named = out.table(named, "sizes")
    plan = budgets(named.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), mixture)
    whole = F.when(F.col("tokens") > 0, F.expr("given div tokens")).otherwise(F.lit(0))
    plan = plan.select(*LEVELS, whole.alias("whole"), (F.col("given") - whole * F.col("tokens")).alias("rest"))
    plan = _leaf_table(out.table(plan, "plan"))
    placed = named.join(plan, list(LEVELS)).withColumn("place", _order(mixture.seed, F.col("whole"), "source", "lang")).withColumn("slot", F.substring("place", 1, SLOT_DIGITS))
    slots = placed.groupBy(*LEVELS, "slot").agg(F.sum("n_tokens").alias("t"))
    w = W.partitionBy(*LEVELS).orderBy("slot")
    slots = slots.withColumn("before", F.sum("t").over(w) - F.col("t"))
    cut = slots.join(plan, list(LEVELS)).filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("t") >= F.col("rest")))
    cut = cut.groupBy(*LEVELS).agg(F.min(F.struct("slot", "before")).alias("c")).select(*LEVELS, F.col("c.slot").alias("cut"), F.col("c.before").alias("before"))
    # Only documents of the slots where a rest ends are put in order, by their distinct places.
    last = placed.join(_leaf_table(out.table(cut, "cuts")), list(LEVELS)).filter("slot = cut").groupBy(*LEVELS, "place", "before", "rest").agg(F.sum("n_tokens").alias("t"))
    within = last.withColumn("from", F.col("before") + F.sum("t").over(W.partitionBy(*LEVELS).orderBy("place")) - F.col("t")).filter("from < rest")
    edge = within.groupBy(*LEVELS).agg(F.max("place").alias("edge"))
    return _leaf_table(out.table(plan.join(edge, list(LEVELS), "left").select(*(F.col(k).alias(f"__loom_{k}") for k in LEVELS), F.col("whole").alias("__loom_whole"), F.col("rest").alias("__loom_rest"), F.col("edge").alias("__loom_edge")), "marks"))


def _with_copies(docs: DataFrame, mixture: Mixture, *keep: str) -> DataFrame:
    joined = _keyed(docs, mixture, *keep).join(_marks(docs, mixture), [f"__loom_{k}" for k in LEVELS])
    place = _order(mixture.seed, F.col("__loom_whole"), "__loom_source", "__loom_lang")
    taken = F.when((F.col("__loom_rest") > 0) & (place <= F.col("__loom_edge")), 1).otherwise(0)
    return joined.withColumn("__loom_copies", (F.col("__loom_whole") + taken).cast("long"))


def mixed(docs: DataFrame, mixture: Mixture = PRODUCTION) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, copies for each row of ``docs(doc_id, text, lang, source)``.

    copies is how often the document is taken.  A null lang or source counts as
    a leaf of its own, named "(none)".  A document without tokens is taken as
    often as whole epochs are, and in the last one if it begins within the rest.
    Repeated rows are separate documents with the same place in the order, and
    are taken together.  Other columns are ignored.
    """
    return _with_copies(docs, mixture, "doc_id").select("doc_id", *(F.col(f"__loom_{k}").alias(k) for k in LEVELS), F.col("__loom_n").alias("n_tokens"), F.col("__loom_copies").alias("copies"))


def mixed_documents(docs: DataFrame, mixture: Mixture = PRODUCTION) -> DataFrame:
    """The rows of ``docs`` as often as the mixture takes them, with all their columns.

    Whether a row is taken follows from its leaf's marks alone, so no text is shuffled.
    """
    rows = _with_copies(docs, mixture, *docs.columns).filter("__loom_copies > 0")
    return rows.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__loom_copies"))).alias("__loom_copy")).select(*docs.columns)


def oracle_sql(mixture: Mixture = PRODUCTION) -> str:
    """DuckDB SQL for the rows of :func:`mixed` over the table ``documents``."""
    weight = lambda level: "CASE " + " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in sorted(getattr(mixture, level).items())) + " ELSE 1 END" if getattr(mixture, level) else "1"

    def level(name: str, depth: int) -> str:
        keys = LEVELS[: depth + 1]
        parent = ", ".join(keys[:-1])
        part = f"PARTITION BY {parent} " if parent else ""
        budget = f"(SELECT CAST(SUM(tokens) AS HUGEINT) * {mixture.budget_percent} // 100 FROM sizes)" if not depth else "p.given"
        source = f"sizes s JOIN l{depth - 1} p USING ({parent})" if parent else "sizes s"
        k = ", ".join(keys)
        return f"""
n{depth} AS (SELECT {k}, SUM(s.tokens) AS tokens, SUM(s.tokens) * {mixture.epochs} AS supply, {"any_value(" + budget + ")" if depth else budget} AS budget, {weight(name)} AS weight FROM {source} GROUP BY {k}),
o{depth} AS (SELECT *, row_number() OVER ({part}ORDER BY CAST(supply AS DOUBLE) / weight, {name}) AS i,
  GREATEST(budget - COALESCE(SUM(supply) OVER ({part}ORDER BY CAST(supply AS DOUBLE) / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS lft,
  SUM(weight) OVER ({part}ORDER BY CAST(supply AS DOUBLE) / weight, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rst FROM n{depth}),
f{depth} AS (SELECT *, MIN(CASE WHEN supply * rst > lft * weight THEN i END) OVER ({part}) AS fi FROM o{depth}),
l{depth} AS (SELECT {", ".join("a." + x for x in keys)}, a.tokens, CASE WHEN a.fi IS NULL OR a.i < a.fi THEN a.supply ELSE LEAST(b.lft * a.weight // b.rst, a.supply) END AS given
  FROM f{depth} a LEFT JOIN f{depth} b ON b.i = a.fi {"AND " + " AND ".join(f"a.{x} = b.{x}" for x in keys[:-1]) if parent else ""})"""

    return f"""WITH named AS (SELECT doc_id, COALESCE(lang, '{NONE}') AS lang, COALESCE(source, '{NONE}') AS source,
  CAST(COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents),
docs AS (SELECT *, concat('d', CAST(CASE WHEN regexp_extract(source, '([0-9]{{1,9}})$', 1) = '' THEN 0 ELSE CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS BIGINT) END % 4 AS VARCHAR)) AS domain FROM named),
sizes AS (SELECT domain, lang, source, SUM(n_tokens) AS tokens FROM docs GROUP BY ALL),
{level("domain", 0).strip()},{level("lang", 1)},{level("source", 2)},
plan AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END AS whole, given - CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END * tokens AS rest FROM l2),
placed AS (SELECT d.*, whole, rest, md5(concat_ws(':', '{mixture.seed}', CAST(whole AS VARCHAR), COALESCE(CAST(doc_id AS VARCHAR), ''), source, lang)) AS place FROM docs d JOIN plan USING (domain, lang, source)),
begun AS (SELECT *, SUM(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place) - SUM(n_tokens) OVER (PARTITION BY domain, lang, source, place) AS begins FROM placed)
SELECT doc_id, domain, lang, source, n_tokens, CAST(whole + CASE WHEN rest > 0 AND begins < rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM begun"""
