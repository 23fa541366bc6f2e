"""Snapshots of an index: Parquet tables of one generation, and a small file that names the current one.

A generation is written to a new folder and then made current by one rename, so a reader never sees half of it, and a
writer that is lost leaves the former one in place.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..model import SNAPSHOT_VERSION

FOLDER = ".edgeloom"


class SnapshotStore:
    """Snapshots below a mounted folder (default: FOLDER in the root)."""

    def __init__(self, spark: SparkSession, root: str, folder: str | None = None):
        self.spark, self.folder = spark, folder or os.path.join(root, FOLDER)

    def _current(self) -> str:
        return os.path.join(self.folder, "snapshot.json")

    def save(self, tables: dict[str, DataFrame], metadata: dict) -> None:
        generation = f"generation-{uuid.uuid4().hex[:12]}"
        for name, df in tables.items():
            df.write.parquet(f"file://{os.path.abspath(self.folder)}/{generation}/{name}")
        os.makedirs(self.folder, exist_ok=True)
        try:
            with open(self._current()) as f:
                before = json.load(f).get("generation")
        except (OSError, ValueError):
            before = None
        tmp = f"{self._current()}.{generation}"
        with open(tmp, "w") as f:
            json.dump({"version": SNAPSHOT_VERSION, "generation": generation, **metadata}, f)
        os.replace(tmp, self._current())
        if before and before != generation:
            shutil.rmtree(os.path.join(self.folder, before), ignore_errors=True)

    def load(self) -> tuple[dict, dict[str, DataFrame]] | None:
        """Metadata and tables; None if there is no snapshot, or one of another version, or a broken one."""
        try:
            with open(self._current()) as f:
                metadata = json.load(f)
        except (OSError, ValueError):
            return None
        folder = os.path.join(self.folder, str(metadata.get("generation"))) if isinstance(metadata, dict) else ""
        if not folder or metadata.get("version") != SNAPSHOT_VERSION or not os.path.isdir(folder):
            return None
        at = f"file://{os.path.abspath(folder)}"
        return metadata, {name: self.spark.read.parquet(f"{at}/{name}") for name in sorted(os.listdir(folder))}


