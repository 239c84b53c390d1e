"""Architecture rules over files, their types and the facts read from them.

Each rule gives rule_id, path, line, evidence.  Files are ``(path, type)``, imports and
usings ``(path, name, line)``, calls ``(path, name)``, signals ``(path, name, line)``.
Rows with a null path or name break no rule.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rules by name, with their severity.
RULES = {
    "framework.react.component-folder-entry": "warning", "architecture.mvvm.thin-view-entry": "error", "architecture.feature-sliced.no-cross-feature-internals": "warning",
    "architecture.mvvm.viewmodel-hook-naming": "warning", "architecture.layered.no-ui-imports-in-data-adapters": "error", "architecture.clean-architecture.layer-boundaries": "error",
}
COMPONENTS = ("component", "main-component", "subcomponent")


@dataclass(frozen=True)
class Options:
    """What a project may set; the defaults are fixed values.

    allowed_edges are (from feature, to feature, specifier patterns; none: all);
    layers are (path pattern, forbidden namespaces).
    """

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    entry_names: tuple[str, ...] = ("index.tsx", "index.jsx")
    view_types: tuple[str, ...] = ("main-component",)
    component_suffix: str = "Main"
    hook_prefix: str = "use"
    hook_suffix: str = ""
    specifier_patterns: tuple[str, ...] = ("^@/features/([^/]+)", "^@features/([^/]+)")
    public_segments: tuple[str, ...] = ("", "public")
    shared_segments: tuple[str, ...] = ("types", "schemas", "constants", "config")
    allowed_edges: tuple[tuple[str, str, tuple[str, ...]], ...] = ()
    adapter_types: tuple[str, ...] = ("repository",)
    ui_patterns: tuple[str, ...] = ("/components(?:/|$)", "/pages(?:/|$)", "/routes(?:/|$)", "^react$", "^react-router-dom$")
    namespace_prefix: str | None = None
    layers: tuple[tuple[str, tuple[str, ...]], ...] | None = None


def matches_any(value: Column, patterns: tuple[str, ...]) -> Column:
    """Whether one of the patterns is found; a null value matches none."""
    out = F.lit(False)
    for p in patterns:
        out = out | F.coalesce(value.rlike(p), F.lit(False))
    return out


def in_scope(path: Column, o: Options) -> Column:
    inside = matches_any(path, o.include) if o.include else F.lit(True)
    return inside & ~matches_any(path, o.exclude)


def is_entry(path: Column, o: Options) -> Column:
    return matches_any(path, tuple(f"/{re.escape(name)}\\z" for name in o.entry_names))


def _hit(df: DataFrame, rule: str, line: Column, evidence: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule_id"), "path", line.cast("int").alias("line"), evidence.alias("evidence"))


def folder_entries(files: DataFrame, o: Options) -> DataFrame:
    """Component files that are not the entry of a folder of their own."""
    broken = files.filter(F.col("type").isin(*COMPONENTS) & F.col("path").rlike(r"\.[jt]sx\z") & in_scope(F.col("path"), o) & ~is_entry(F.col("path"), o))
    return _hit(broken, "framework.react.component-folder-entry", F.lit(1), F.regexp_extract("path", r"([^/]*)\z", 1))


def thin_views(files: DataFrame, signals: DataFrame, o: Options) -> DataFrame:
    """View entries that hold state, route, call services or touch the browser; the first place of each."""
    views = files.filter(matches_any(F.col("type"), o.view_types) & in_scope(F.col("path"), o) & is_entry(F.col("path"), o)).select("path")
    return _hit(signals.join(views, "path", "left_semi"), "architecture.mvvm.thin-view-entry", F.col("line"), F.col("name"))


def hook_names(files: DataFrame, calls: DataFrame, o: Options) -> DataFrame:
    """View entries that do not call the hook named after their folder."""
    folder = F.regexp_extract("path", r"([^/]+)/[^/]*\z", 1)
    views = files.filter(matches_any(F.col("type"), o.view_types) & is_entry(F.col("path"), o) & (folder != "") & folder.endswith(o.component_suffix))
    expected = views.select("path", F.concat(F.lit(o.hook_prefix), folder, F.lit(o.hook_suffix)).alias("name"))
    return _hit(expected.join(calls.select("path", "name").distinct(), ["path", "name"], "left_anti"), "architecture.mvvm.viewmodel-hook-naming", F.lit(1), F.col("name"))


def target_feature(specifier: Column, o: Options) -> Column:
    """The feature that a specifier leads into, by the first pattern that names one; else null."""
    return F.coalesce(*(F.nullif(F.regexp_extract(specifier, p, 1), F.lit("")) for p in o.specifier_patterns), F.lit(None).cast("string"))


def cross_features(imports: DataFrame, feature_pattern: str, o: Options) -> DataFrame:
    """Imports of another feature's inner files: not its public entry, a shared segment or an allowed edge."""
    name, source, target = F.col("name"), F.col("source"), F.col("target")
    led = imports.select("path", "name", "line", F.nullif(F.regexp_extract("path", feature_pattern, 1), F.lit("")).alias("source"), target_feature(name, o).alias("target"))
    fine = F.lit(False)
    for segment in o.public_segments:
        for start in ("@/features/", "@features/"):
            fine = fine | (name == F.concat(F.lit(start), target, F.lit(f"/{segment}" if segment else "")))
    fine = fine | matches_any(name, tuple(f"^@/?features/[^/]+/{re.escape(segment)}(?:/|$)" for segment in o.shared_segments))
    for a, b, patterns in o.allowed_edges:
        fine = fine | ((source == a) & (target == b) & (matches_any(name, patterns) if patterns else F.lit(True)))
    return _hit(led.filter((source != target) & ~fine), "architecture.feature-sliced.no-cross-feature-internals", F.col("line"), name)


def ui_imports(files: DataFrame, imports: DataFrame, o: Options) -> DataFrame:
    """Imports of what shows things, by files that only fetch data."""
    adapters = files.filter(F.col("type").isin(*o.adapter_types)).select("path")
    return _hit(imports.filter(matches_any(F.col("name"), o.ui_patterns)).join(adapters, "path", "left_semi"), "architecture.layered.no-ui-imports-in-data-adapters", F.col("line"), F.col("name"))


def layers_of(o: Options) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """The layers as set, or those that follow from the namespace prefix."""
    if o.layers is not None or not o.namespace_prefix:
        return o.layers or ()
    p = o.namespace_prefix
    outer = (f"{p}.API",)
    return ((f"/{re.escape(p)}\\.Domain/", (f"{p}.API", f"{p}.Application", f"{p}.Infrastructure")), (f"/{re.escape(p)}\\.(?:Application|Infrastructure)/", outer))


def layer_boundaries(usings: DataFrame, o: Options) -> DataFrame:
    """For each namespace that a file's layer forbids the first using of it or of one below it."""
    layers = layers_of(o)
    if not layers:
        return _hit(usings.limit(0), "architecture.clean-architecture.layer-boundaries", F.col("line"), F.col("name"))
    named = [F.when(F.col("path").rlike(p), F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>")) for p, names in layers if names]
    forbidden = F.array_distinct(F.concat(*named))
    hit = usings.select("path", "name", F.col("line").cast("int").alias("line"), F.explode(forbidden).alias("item")).filter((F.col("name") == F.col("item")) | F.col("name").startswith(F.concat("item", F.lit("."))))
    first = hit.groupBy("path", "item").agg(F.min("line").alias("line"))
    return _hit(first, "architecture.clean-architecture.layer-boundaries", F.col("line"), F.concat(F.lit("using "), F.col("item")))
