"""Target resolution: a file and line, a path, or a name; a node, candidates, or a miss."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import is_test_path, matches_node
from ..functions.paths import forward, language
from ..messages import message
from ..model import Answer, diagnostic


@dataclass(frozen=True)
class Resolved:
    """kind: node, candidates or miss. name: the node's name; definitions: of the candidates or the node."""

    kind: str
    needle: str = ""
    name: str | None = None
    definitions: DataFrame | None = None


def parse_file_line(target: str) -> tuple[str, int] | None:
    """`path:12` as (lower-cased path, 12)."""
    found = re.fullmatch(r"(.+):([0-9]+)", target.replace("\\", "/"), re.DOTALL)
    return (found[1].lower(), int(found[2])) if found else None


def definitions(edges: DataFrame) -> DataFrame:
    return edges.where("kind = 'definition'")


def at_line(edges: DataFrame, file: str, line: int) -> DataFrame:
    """Definitions that start at a line of a file (any case)."""
    return definitions(edges).where((F.lower(forward(F.col("file"))) == file.lower()) & (F.col("line") == line))


def under_path(edges: DataFrame, target: str) -> DataFrame | None:
    """Definitions in a file or below a directory; None if no edge is there, so that the target is no path."""
    path = target.replace("\\", "/").removesuffix("/").lower()
    if not path:
        return None
    file = F.lower(forward(F.col("file")))
    there = edges.where((file == path) | file.startswith(path + "/"))
    return None if there.isEmpty() else definitions(there)


def named(edges: DataFrame, needle: str) -> DataFrame:
    return definitions(edges).where(matches_node(F.col("target"), needle))


def locations(defs: DataFrame) -> DataFrame:
    """Distinct (name, file) of definitions; one name twice in a file is one place."""
    return defs.select(F.lower("target").alias("name"), F.lower("file").alias("file")).distinct()


def resolve(edges: DataFrame, target: str) -> Resolved:
    """What a target stands for. Scope and other filters play no part."""
    place = parse_file_line(target)
    if place:
        hits = at_line(edges, *place)
        some = hits.limit(2).collect()
        if not some:
            return Resolved("miss")
        if len(some) > 1:
            return Resolved("candidates", definitions=hits)
        return Resolved("node", some[0].target.lower(), some[0].target, hits)
    inside = under_path(edges, target)
    if inside is not None:
        return Resolved("miss") if inside.isEmpty() else Resolved("candidates", definitions=inside)
    found = named(edges, target)
    places = locations(found).limit(2).count()
    if places > 1:
        return Resolved("candidates", definitions=found)
    if not places:
        return Resolved("miss", target.lower())
    return Resolved("node", target.lower(), found.orderBy("ord").first().target, found)


def candidates(defs: DataFrame) -> DataFrame:
    """name, path, language, line of distinct definitions, and `is_test`; order: rank()."""
    each = Window.partitionBy(F.lower("target"), F.lower("file")).orderBy("ord")
    first = defs.withColumn("_n", F.row_number().over(each)).where("_n = 1")
    return first.select(F.col("target").alias("name"), F.col("file").alias("path"), language(F.col("file")).alias("language"), "line", "ord", is_test_path(F.col("file")).alias("is_test"))


def ranked(found: DataFrame, limit: int) -> DataFrame:
    """The first candidates: no tests first, then by path (in the order of a dictionary), then by line."""
    return found.orderBy("is_test", F.collate(forward(F.col("path")), "UNICODE"), "line", "ord").limit(limit)


def candidate_answer(defs: DataFrame, target: str, limit: int) -> Answer:
    found = candidates(defs)
    total = found.count()
    notes = []
    if total > 1:
        notes.append(diagnostic("ambiguous_target", message("ambiguous_target", n=total, target=target)))
    if total > limit:
        notes.append(diagnostic("truncated", message("more_candidates", n=total - limit)))
    rows = [{"name": r.name, "path": r.path, "language": r.language, "line": r.line} for r in ranked(found, limit).collect()]
    return Answer(candidates=rows, truncated=total > limit, total=total, diagnostics=notes)
