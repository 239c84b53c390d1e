"""Column functions for names, paths, globs, endpoints and scores."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def kebab(c: Column) -> Column:
    """camelCase, spaces and underscores to lower-case words joined by hyphens."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1-$2"), r"[\s_]+", "-"))


def display_label(path: Column) -> Column:
    """The file name; of an index file the folder above it."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    return F.when(last.rlike(r"\Aindex\.[^.]+\z") & (F.size(parts) > 1), F.try_element_at(parts, F.lit(-2))).otherwise(last)


def normalize_endpoint(raw: Column) -> Column:
    """A path that begins with /api: one /api where two stand first, single slashes, none at the end, a
    version parameter as v1; null for anything else.  A query stays."""
    path = F.regexp_replace(F.regexp_replace(raw, r"\A/api/api/", "/api/"), "/+", "/")
    path = F.replace(F.regexp_replace(path, r"/\z", ""), F.lit("/v{version:apiVersion}"), F.lit("/v1"))
    return F.when(raw.startswith("/api"), path)


def endpoint_id(url: Column, method: Column) -> Column:
    """endpoint:METHOD url, every parameter ({x}, or :x up to the next slash) written as {}."""
    return F.concat(F.lit("endpoint:"), F.upper(method), F.lit(" "), F.regexp_replace(F.regexp_replace(url, r"\{[^}]+\}", "{}"), ":[^/]+", "{}"))


def clean_url(url: Column) -> Column:
    """What two urls share that are the same endpoint: parameters of any form are one, case counts."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"\$?\{[^}]+\}", "{}"), "/:[^/]+", "/{}"), r"/+\z", "")


def rest_method(name: Column) -> Column:
    return F.when(F.upper(name).isin("GET", "POST", "PUT", "PATCH", "DELETE"), F.upper(name)).otherwise("ANY")


def round_half_up(c: Column) -> Column:
    return F.floor(c + F.lit(0.5))


def clamp(c: Column, low: int = 1, high: int = 10) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def title_case(c: Column) -> Column:
    """Words parted by hyphens, underscores or spaces, each with its first letter in upper case."""
    words = F.filter(F.split(c, r"[-_\s]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


def truncated(c: Column, most: int) -> Column:
    """At most ``most`` characters, the last of them an ellipsis where something is left out."""
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most - 1)), F.lit("…"))).otherwise(c)


def slug(c: Column) -> Column:
    """Lower-case letters and digits of any script, all else as single hyphens, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "-"), r"\A-|-\z", "")


def html_escaped(c: Column) -> Column:
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    for sign, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def health_key(score: Column) -> Column:
    levels = [(9.5, "excellent"), (8.5, "very-good"), (7.5, "good"), (6.5, "fair"), (5.0, "low")]
    out = F.when(score.isNull(), F.lit(None).cast("string"))
    for least, name in levels:
        out = out.when(score >= least, name)
    return out.otherwise("critical")


def submap_glob(pattern: str) -> str:
    """The anchored regular expression of a submap path glob: ``**/`` any folders, ``**`` anything, ``*`` and ``?`` within one segment."""
    out, i, p = [], 0, pattern.replace("\\", "/")
    while i < len(p):
        if p.startswith("**/", i):
            out.append("(?:[^/]*/)*")
            i += 3
        elif p.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(p[i]) or re.sub(r"([^\w/ -])", r"\\\1", p[i]))
            i += 1
    return r"\A(?s:" + "".join(out) + r")\z"


def suppression_glob(pattern: str) -> str:
    """The anchored regular expression of a suppression glob: ``**`` anything, ``*`` within one segment, no other sign is special."""
    parts = [{"**": ".*", "*": "[^/]*"}.get(x) or re.sub(r"([^\w/ -])", r"\\\1", x) for x in re.split(r"(\*\*|\*)", pattern)]
    return r"\A(?s:" + "".join(parts) + r")\z"


def line_of(text: Column, position: Column) -> Column:
    """Line number of a 1-based character position."""
    before = F.substring(text, F.lit(1), position - 1)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def canonical_line(*columns: str) -> Column:
    """Columns as one text with unit separators, null apart from empty."""
    return F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns))
