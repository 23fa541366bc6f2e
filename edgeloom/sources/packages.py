"""Packages of a tree: manifests at the root and in the usual package folders."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Folders whose children are packages.
PACKAGE_FOLDERS = ("packages", "libs", "apps", "pkg")
MANIFEST = "package.json"


def package_dir(path: Column) -> Column:
    """The package that a manifest at this path declares: the root, a child of a package folder, or a grandchild. Null
    for other paths."""
    parts = F.split(path, "/")
    inside = parts[0].isin(*PACKAGE_FOLDERS)
    is_manifest = F.element_at(parts, -1) == MANIFEST
    found = F.when(F.size(parts) == 1, F.lit("")).when(inside & F.size(parts).isin(3, 4), F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/"))
    return F.when(is_manifest, found)


def discover(manifests: DataFrame) -> DataFrame:
    """dir, name and ord of packages from manifests (path, text). A grandchild counts only if its parent is none."""
    found = manifests.select(package_dir(F.col("path")).alias("dir"), F.get_json_object("text", "$.name").alias("name")).where("dir is not null")
    outer = found.select(F.col("dir").alias("parent"))
    nested = F.when(F.size(F.split("dir", "/")) == 3, F.regexp_replace("dir", "/[^/]*$", ""))
    found = found.withColumn("parent", nested).join(outer, "parent", "left_anti").select("dir", "name")
    base = F.array_position(F.array(F.lit(""), *map(F.lit, PACKAGE_FOLDERS)), F.split("dir", "/")[0])
    return found.withColumn("ord", F.struct(base.alias("folder"), F.col("dir").alias("dir")))


def discover_tree(root: str) -> list[tuple[str, str | None]]:
    """(dir, name) of the packages of a mounted tree, in order."""

    def name_in(folder: str) -> tuple[bool, str | None]:
        try:
            with open(os.path.join(folder, MANIFEST), encoding="utf-8") as f:
                found = json.load(f)
            return True, found.get("name") if isinstance(found, dict) else None
        except OSError:
            return False, None
        except ValueError:
            return True, None

    def children(folder: str) -> list[str]:
        try:
            return sorted(os.listdir(folder))
        except OSError:
            return []

    out: list[tuple[str, str | None]] = []
    there, name = name_in(root)
    if there:
        out.append(("", name))
    for base in PACKAGE_FOLDERS:
        for entry in children(os.path.join(root, base)):
            there, name = name_in(os.path.join(root, base, entry))
            if there:
                out.append((f"{base}/{entry}", name))
                continue
            for sub in children(os.path.join(root, base, entry)):
                there, name = name_in(os.path.join(root, base, entry, sub))
                if there:
                    out.append((f"{base}/{entry}/{sub}", name))
    return out
