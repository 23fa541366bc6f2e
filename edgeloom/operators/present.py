"""What a selection of edges looks like in an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..messages import message
from ..model import DEFAULT_LIMIT, LIMIT_CAP, SNIPPET_CHARS, SNIPPET_LINES, diagnostic


def clamp_limit(requested: int | None, notes: list[dict]) -> int:
    """The limit in force; a larger one than the cap is noted, a smaller one than 1 counts as 1."""
    limit = DEFAULT_LIMIT if requested is None else requested
    if limit > LIMIT_CAP:
        notes.append(diagnostic("partial", message("limit_clamped", limit=limit, cap=LIMIT_CAP)))
    return max(1, min(limit, LIMIT_CAP))


def snippet(text: Column, line: Column) -> Column:
    """The lines of a text from a place on, three at most, each cut to a length."""
    lines = F.slice(F.split(text, "\r?\n"), F.greatest(line, F.lit(1)), F.lit(SNIPPET_LINES))
    return F.transform(lines, lambda x: F.substring(x, 1, SNIPPET_CHARS))


def with_snippets(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges with `lines` from files (path, text); null where the file isn't there."""
    return edges.join(files.select(F.col("path").alias("file"), "text"), "file", "left").withColumn("lines", snippet(F.col("text"), F.col("line"))).drop("text")


def edge_dict(row, lines: list[str] | None = None) -> dict:
    out = {"kind": row["kind"], "source": row["source"], "target": row["target"], "confidence": row["confidence"], "location": {"file": row["file"], "line": row["line"], "col": row["col"]}}
    return out if lines is None else {**out, "snippet": {"lines": lines}}


def scope_prefix(scope: str, packages: dict[str, str] | list[str]) -> str:
    """The directory that a scope names: a package whose directory is or ends with it, else itself."""
    prefix = scope.replace("\\", "/").removesuffix("/")
    return next((d for d in packages if d == prefix or d.endswith("/" + prefix)), prefix)
