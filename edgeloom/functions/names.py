"""Names of graph nodes: predicates as Columns. All matching is on lower-cased names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _has_short(name: Column) -> Column:
    return ~name.contains("/") & (F.locate(".", name, 2) > 0)


def short_name(name: Column) -> Column:
    """What follows the last dot, unless the name has a slash or no dot after its first character."""
    return F.when(_has_short(name), F.substring_index(name, ".", -1)).otherwise(name)


def short_of(name: str) -> str:
    return name.rsplit(".", 1)[1] if "/" not in name and name.rfind(".") > 0 else name


def matches_node(target: Column, needle: str) -> Column:
    """The full name, its last path segments, or the short name of a method."""
    t, n = F.lower(target), needle.lower()
    return (t == n) | t.endswith("/" + n) | (_has_short(t) & (F.substring_index(t, ".", -1) == n))


def aliases_for(needle: str, unique: str | None) -> list[str]:
    """Names that stand for a target: its own, its node's, and their short names."""
    names = [needle.lower(), *([unique.lower()] if unique else [])]
    return list(dict.fromkeys([*names, *(short_of(n) for n in names)]))


def targets_symbol(target: Column, symbol: str) -> Column:
    """The symbol itself or a suffix of the target after a slash or dot."""
    t, s = F.lower(target), symbol.lower()
    return (t == s) | t.endswith("/" + s) | t.endswith("." + s)


def matches_alias(target: Column, aliases: list[str]) -> Column:
    out = F.lit(False)
    for a in aliases:
        out = out | targets_symbol(target, a)
    return out


def matches_import(target: Column, needle: str) -> Column:
    """Import targets are files: the whole path or its last segments, never an extension alone."""
    t, n = F.lower(target), needle.lower()
    return (t == n) | t.endswith("/" + n)


def symbol_keys(target: Column, dots: bool) -> Column:
    """All symbols that a target answers to: its suffixes after slashes (and dots). A join on them is an equi-join."""
    t = F.lower(target)
    marks = ["/", "."] if dots else ["/"]
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.length(t) - 1, F.lit(0))), lambda i: (i == 0) | F.substr(t, i, F.lit(1)).isin(marks))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(t, i + 1)))


def caller_symbol(source: Column) -> Column:
    """The symbol that a file defines: its lower-cased base name without the last extension."""
    return F.lower(F.regexp_replace(F.substring_index(source, "/", -1), r"\.[^.]+$", ""))


def caller_of(source: str) -> str:
    return re.sub(r"\.[^.]+$", "", source.rsplit("/", 1)[-1]).lower()


def is_test_path(path: Column) -> Column:
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.split(p, "/")
    return F.array_contains(parts, "tests") | F.array_contains(parts, "__tests__") | F.substring_index(p, "/", -1).rlike(r"(?i)\.(spec|test)\.")


def wanted_kinds(mode: str, relation: str | None) -> tuple[str, ...]:
    """The kinds of edges that a query is about."""
    if relation:
        return (relation,)
    return ("call", "definition") if mode == "callers" else ("definition", "import")
