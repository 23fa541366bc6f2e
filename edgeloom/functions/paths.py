"""POSIX paths as Columns."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import EXTENSION_LANGUAGE


def forward(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def directory(path: Column) -> Column:
    """The path without its last segment; `.` if there is only one."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def normalized(path: Column) -> Column:
    """The path without `.` and empty segments, and with `..` applied; leading `..` stay; `.` if nothing is left."""

    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != "..")
        return (
            F.when(part.isin("", "."), done)
            .when(up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
            .otherwise(F.concat(done, F.array(part)))
        )

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.when(F.size(parts) == 0, ".").otherwise(F.array_join(parts, "/"))


def normalize(path: str) -> str:
    """The plain twin of `normalized` for relative paths."""
    return posixpath.normpath(path.lstrip("/")) if path else "."


def extension(path: Column) -> Column:
    """The lower-cased extension of the last segment, with its dot; empty without one (as for dot files)."""
    return F.regexp_extract(F.lower(F.substring_index(path, "/", -1)), r"^.+(\.[^.]*)$", 1)


def language(path: Column) -> Column:
    """The language label of a path; an unknown extension is its own label."""
    ext = F.lower(F.substring_index(path, ".", -1))
    labels = F.create_map(*(F.lit(x) for ext_, name in EXTENSION_LANGUAGE.items() for x in (ext_[1:], name)))
    return F.coalesce(F.try_element_at(labels, ext), ext)


def under(path: Column, prefix: str) -> Column:
    return path.startswith(prefix + "/")
