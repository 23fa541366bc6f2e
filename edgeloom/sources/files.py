"""Scans of source trees: a listing, rules on paths, budgets, and a reason for every file that is left out."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import replace
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import extension
from ..messages import message
from ..model import EXCLUDED_DIRECTORIES, SCANNED_EXTENSIONS, ScanLimits, diagnostic

LISTING = "path string, size long, mtime_ms double"
#: Entries of a listing that are judged at once.
CHUNK = 65_536
PROBE = 8192
#: The skip reason of a file that couldn't be opened; it gives no diagnostic and is tried again by each refresh.
UNREADABLE = "unreadable"
CONTROL_SHARE = 0.06


def _wildcard(pattern: str) -> str:
    """`*` stands for any text; the pattern also covers everything below what it names."""
    return "^" + ".*".join(re.escape(p).replace("/", r"\/") for p in pattern.split("*")) + "(/.*)?$"


def _on_path_or_segment(path: Column, regex: str) -> Column:
    return path.rlike(regex) | F.exists(F.split(path, "/"), lambda s: s.rlike(regex))


def glob_rule(path: Column, rule: str) -> Column:
    """Whether a path falls under a rule: `**/*.ext` is a suffix, a rule with `*` a wildcard on the path or any of its
    segments, any other rule a file or directory."""
    rule = rule.replace("\\", "/").removeprefix("./")
    if rule.startswith("**/*."):
        return F.lower(path).endswith(rule[4:].lower())
    if "*" in rule:
        return _on_path_or_segment(path, _wildcard(rule))
    rule = rule.removesuffix("/")
    return path.startswith(rule + "/") | (path == rule)


def any_rule(path: Column, rules: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for rule in rules:
        out = out | glob_rule(path, rule)
    return out


def ignore_rule(directory: Column, line: str) -> Column:
    """Whether a line of an ignore file names a directory. Negations and anchors aren't known to it."""
    if "*" in line:
        return _on_path_or_segment(directory, _wildcard(line))
    name = line.replace("\\", "/").removesuffix("/")
    return (directory == name) | directory.startswith(name + "/") | F.array_contains(F.split(directory, "/"), name.rsplit("/", 1)[-1])


def ignore_lines(text: str) -> tuple[str, ...]:
    return tuple(x for x in (line.strip() for line in text.splitlines()) if x and not x.startswith("#"))


def directories(path: Column) -> Column:
    """All directories above a path, from the root down."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n - 1), "/"))


def in_excluded_directory(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, EXCLUDED_DIRECTORIES)))


def ignored(path: Column, lines: tuple[str, ...]) -> Column:
    """Whether a directory above a path is ignored; rules don't apply to files."""
    if not lines:
        return F.lit(False)

    def hit(d: Column) -> Column:
        out = F.lit(False)
        for line in lines:
            out = out | ignore_rule(d, line)
        return (d != "") & out

    return F.exists(directories(path), hit)


def scanned_extension(path: Column) -> Column:
    return extension(path).isin(*SCANNED_EXTENSIONS)


def looks_binary(content: Column) -> Column:
    """A NUL in the first bytes, or too many control characters."""
    probe = F.substring(content, 1, PROBE)
    text = F.decode(probe, "ISO-8859-1")
    control = F.regexp_count(text, F.lit(r"[\x00-\x06\x0e-\x1f]"))
    return text.contains("\x00") | (control / F.greatest(F.octet_length(probe), F.lit(1)) > CONTROL_SHARE)


def undecodable(content: Column) -> Column:
    """Bytes without a byte order mark that aren't UTF-8, or hold the replacement character."""
    head = F.hex(F.substring(content, 1, 3))
    marked = (head == "EFBBBF") | head.startswith("FFFE") | head.startswith("FEFF")
    text = content.cast("string")
    return ~marked & (~F.is_valid_utf8(text) | text.contains("�"))


def eligible(listing: DataFrame, limits: ScanLimits, lines: tuple[str, ...] = ()) -> DataFrame:
    """Files that count against the budget: outside ignored directories, not excluded, and of a known extension or included."""
    path = F.col("path")
    known = scanned_extension(path) | any_rule(path, limits.include)
    return listing.where(~in_excluded_directory(path) & ~ignored(path, lines) & ~any_rule(path, limits.exclude) & known)


def within_budget(files: DataFrame, limits: ScanLimits) -> DataFrame:
    """The first max_files in the order of paths (a top-k, without a global sort)."""
    return files.orderBy("path").limit(limits.max_files)


def skip_code(size: Column, content: Column, limits: ScanLimits) -> Column:
    """Why a file isn't indexed; null if it is. The content isn't looked at if the file is too large."""
    return F.when(size > limits.max_file_bytes, "file_oversize").when(looks_binary(content), "file_binary").when(undecodable(content), "file_decode_failed")


def skip_message(code: str, path: str, size: int, limits: ScanLimits) -> str:
    return message(code, path=path, size=size, cap=limits.max_file_bytes)


def walk_tree(root: str, lines: tuple[str, ...] = ()) -> Iterator[tuple[str, int, float]]:
    """(path, size, mtime in ms) of the regular files below a root, in the order of paths, so that a reader may stop.
    Excluded directories are not entered, so a large tree of dependencies costs nothing; what can't be read is left out."""
    names = [line for line in lines if "*" not in line]
    wild = [re.compile(_wildcard(line)) for line in lines if "*" in line]

    def skipped(rel: str, name: str) -> bool:
        if name in EXCLUDED_DIRECTORIES:
            return True
        parts = rel.split("/")
        for line in names:
            n = line.replace("\\", "/").removesuffix("/")
            if rel == n or rel.startswith(n + "/") or n.rsplit("/", 1)[-1] in parts:
                return True
        return any(r.match(rel) or any(map(r.match, parts)) for r in wild)

    def walk(folder: str, rel: str) -> Iterator[tuple[str, int, float]]:
        try:
            # A directory sorts as its name with a slash, as the paths below it do.
            entries = sorted(((e.name + "/" * e.is_dir(follow_symlinks=False), e) for e in os.scandir(folder)), key=lambda x: x[0])
        except OSError:
            return
        for name, e in entries:
            at = f"{rel}/{e.name}" if rel else e.name
            try:
                if name.endswith("/"):
                    if not skipped(at, e.name):
                        yield from walk(e.path, at)
                elif e.is_file(follow_symlinks=False):
                    stat = e.stat(follow_symlinks=False)
                    yield at, stat.st_size, stat.st_mtime * 1000
            except OSError:
                continue

    return walk(root, "")


def list_tree(root: str, lines: tuple[str, ...] = ()) -> list[tuple[str, int, float]]:
    """The whole of `walk_tree`."""
    return list(walk_tree(root, lines))


def read_contents(files: DataFrame, root: str, max_bytes: int) -> DataFrame:
    """files (path, size, ...) with their content, read on the executors from a mounted root; null if it is too large or
    can't be read."""

    def run(batches):
        for pdf in batches:
            found = []
            for path, size in zip(pdf["path"], pdf["size"], strict=True):
                try:
                    if size > max_bytes:
                        raise OSError
                    with open(os.path.join(root, path), "rb") as f:
                        found.append(f.read())
                except OSError:
                    found.append(None)
            yield pdf.assign(content=pd.Series(found, dtype=object, index=pdf.index))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema) + ", content binary"
    return files.mapInPandas(run, schema)


def listed(spark: SparkSession, root: str, limits: ScanLimits) -> tuple[DataFrame, list[dict]]:
    """Files that count (path, size, mtime_ms), without a look at their contents, and a diagnostic if the budget left files
    out. The tree is walked in the order of paths, and no further than the budget asks."""
    lines: tuple[str, ...] = ()
    try:
        with open(os.path.join(root, ".gitignore"), encoding="utf-8", errors="replace") as f:
            lines = ignore_lines(f.read())
    except OSError:
        pass
    taken: list = []
    notes: list[dict] = []
    entries = walk_tree(root, lines)
    while len(taken) < limits.max_files and (chunk := list(islice(entries, CHUNK))):
        left = replace(limits, max_files=limits.max_files - len(taken))
        taken += within_budget(eligible(spark.createDataFrame(chunk, LISTING), left, lines), left).collect()
        if len(taken) >= limits.max_files and (chunk[-1][0] > taken[-1].path or next(entries, None)):
            notes.append(diagnostic("file_count_stop", message("file_count_stop", files=limits.max_files)))
    return spark.createDataFrame(taken, LISTING), notes


def read_files(files: DataFrame, root: str, limits: ScanLimits) -> DataFrame:
    """files (path, size, mtime_ms) with `text` and `skip`: why a file has no text (`unreadable`: it couldn't be opened)."""
    from ..plans.settle import settled

    parts = max(1, min(256, files.count() // 64))
    read = read_contents(files.repartition(parts), root, limits.max_file_bytes)
    skip = F.coalesce(skip_code(F.col("size"), F.col("content"), limits), F.when(F.col("content").isNull(), UNREADABLE))
    read = read.withColumn("skip", skip)
    text = F.when(F.col("skip").isNull(), F.make_valid_utf8(F.col("content").cast("string")))
    return settled(read.select("path", "size", "mtime_ms", "skip", text.alias("text")))


def skip_notes(files: DataFrame, limits: ScanLimits) -> list[dict]:
    """A diagnostic for each file (path, size, skip) that isn't indexed, in the order of paths."""
    left_out = files.where(F.col("skip").isNotNull() & (F.col("skip") != UNREADABLE)).select("path", "size", "skip")
    return [diagnostic(r.skip, skip_message(r.skip, r.path, r.size, limits)) for r in left_out.orderBy("path").collect()]
