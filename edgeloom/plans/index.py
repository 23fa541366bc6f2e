"""The life cycle of an index: build, reuse, incremental refresh, single flight."""

from __future__ import annotations

import hashlib
import json
import os
import threading
from concurrent.futures import Future

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract.registry import extract_files
from ..functions.paths import extension
from ..messages import message
from ..model import ScanLimits, diagnostic
from ..operators.assemble import edges_of, raw_edges
from ..sources.files import UNREADABLE, listed, read_files, skip_notes
from ..sources.packages import discover_tree
from ..sources.snapshot import SnapshotStore
from .settle import settled


class SingleFlight:
    """Callers that come while a run is under way wait for it and share its result."""

    def __init__(self):
        self._lock, self._running = threading.Lock(), None

    def run(self, work):
        with self._lock:
            mine = self._running is None
            if mine:
                self._running = Future()
            flight = self._running
        if mine:
            try:
                flight.set_result(work())
            except BaseException as error:
                flight.set_exception(error)
            finally:
                with self._lock:
                    self._running = None
        return flight.result()


def fingerprint_changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """(path, change) of files that are new or differ in size or time (`changed`) or are gone (`deleted`)."""
    a = now.select("path", F.col("size").alias("size_now"), F.col("mtime_ms").alias("mtime_now"))
    b = before.select("path", F.col("size").alias("size_before"), F.col("mtime_ms").alias("mtime_before"))
    both = a.join(b, "path", "full_outer")
    change = F.when(F.col("size_now").isNull(), "deleted").when(
        F.col("size_before").isNull() | (F.col("size_now") != F.col("size_before")) | (F.col("mtime_now") != F.col("mtime_before")), "changed"
    )
    return both.select("path", change.alias("change")).where("change is not null")


def merged(old: DataFrame, new: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of old whose key isn't among the changes, and all of new."""
    return old.join(changes.select(F.col("path").alias(key)), key, "left_anti").unionByName(new)


class ProjectIndex:
    """The index of one root: raw relations and fingerprints by file, and the edges that follow from them.

    Raw relations are what is stored and refreshed by file; imports and calls are resolved anew from all of them, so an
    incremental refresh gives the same edges as a rebuild.
    """

    def __init__(self, spark: SparkSession, root: str, limits: ScanLimits = ScanLimits(), store: SnapshotStore | None = None):
        self.spark, self.root, self.limits = spark, os.path.abspath(root), limits
        self.store = store or SnapshotStore(spark, self.root)
        self.flight = SingleFlight()
        self.edges: DataFrame | None = None
        self.raw: DataFrame | None = None
        self.fingerprints: DataFrame | None = None
        self.status, self.files, self.refreshed = "built", 0, None
        self.packages: dict[str, str] = {}
        self.diagnostics: list[dict] = []

    def shape(self) -> str:
        """Identifies what a scan would take: a snapshot of another shape isn't reused."""
        parts = [self.limits.max_file_bytes, self.limits.max_files, list(self.limits.include), list(self.limits.exclude), "skip"]
        return hashlib.sha256(json.dumps(parts).encode()).hexdigest()

    def _notes(self, files: DataFrame) -> list[dict]:
        """Diagnostics of files (path, size, skip): those left out, and those of which nothing is extracted."""
        razor = files.where(F.col("skip").isNull() & (extension(F.col("path")) == ".razor")).select("path").orderBy("path").collect()
        more = [diagnostic("unsupported_language", f"Razor has markup-level capability only; {r.path} was not extracted") for r in razor]
        return skip_notes(files, self.limits) + more

    def _assemble(self, raw: DataFrame, files: DataFrame) -> None:
        packages = [(d, n, i) for i, (d, n) in enumerate(discover_tree(self.root))]
        self.packages = {d: "package" for d, _, _ in packages if d}
        table = self.spark.createDataFrame(packages, "dir string, name string, ord int")
        self.raw = raw
        failed = [r.file for r in raw.where("kind = 'failed'").select("file").orderBy("file").collect()]
        self.diagnostics += [diagnostic("partial", message("failed", path=path)) for path in failed]
        self.edges = settled(edges_of(raw_edges(raw, files, table)))

    def _save(self) -> None:
        meta = {"shape": self.shape(), "files": self.files, "packages": self.packages, "diagnostics": self.diagnostics}
        self.store.save({"raw": self.raw, "edges": self.edges, "fingerprints": self.fingerprints}, meta)

    def _install(self, raw: DataFrame, files: DataFrame) -> None:
        """Makes raw relations and their edges current, and then the fingerprints of all files, those left out too: what is
        cancelled before its end is done anew by the next refresh."""
        indexed = files.where("skip is null")
        self._assemble(raw, indexed)
        self.fingerprints, self.files = settled(files.select("path", "size", "mtime_ms", "skip")), indexed.count()

    def rebuild(self) -> None:
        listing, notes = listed(self.spark, self.root, self.limits)
        files = read_files(listing, self.root, self.limits)
        self.diagnostics = self._notes(files) + notes
        self._install(settled(extract_files(files.where("skip is null").select("path", "size", "mtime_ms", "text"))), files)
        self.status, self.refreshed = "rebuilt", None
        self._save()

    def _load(self) -> bool:
        found = self.store.load()
        if not found or found[0].get("shape") != self.shape() or not {"raw", "edges", "fingerprints"} <= set(found[1]):
            return False
        meta, tables = found
        self.raw, self.edges, self.fingerprints = (settled(tables[x]) for x in ("raw", "edges", "fingerprints"))
        self.files, self.packages, self.diagnostics = meta["files"], meta["packages"], meta["diagnostics"]
        return True

    def _refresh(self) -> None:
        """Compares sizes and times first, and reads the files that differ. Files left out before and now are no change of
        the index."""
        listing, notes = listed(self.spark, self.root, self.limits)
        before = self.fingerprints
        again = before.where(F.col("skip") == UNREADABLE).select("path", F.lit("changed").alias("change"))
        changes = settled(fingerprint_changes(listing, before).unionByName(again).distinct())
        self.refreshed = None
        if changes.isEmpty():
            self.status = "reused"
            return
        read = read_files(listing.join(changes.where("change = 'changed'").select("path"), "path", "left_semi"), self.root, self.limits)
        kept = before.join(changes, "path", "left_anti")
        files = settled(kept.unionByName(read.select(*kept.columns)))
        fresh = read.where("skip is null")
        n, had = fresh.count(), not before.where("skip is null").join(changes, "path", "left_semi").isEmpty()
        if n == 0 and not had:
            self.fingerprints, self.status = files, "reused"
            return
        self.diagnostics = self._notes(files) + notes
        new = extract_files(fresh.select("path", "size", "mtime_ms", "text"))
        self._install(settled(merged(self.raw, new, changes, "file")), files)
        self.status, self.refreshed = "incremental", n
        self._save()

    def ensure_fresh(self) -> None:
        """Builds or loads the index on first use, and brings it up to date afterwards."""

        def work():
            if self.edges is None and not self._load():
                self.rebuild()
            else:
                self._refresh()

        self.flight.run(work)

    def dirty(self) -> bool:
        """Whether an answer would need a build or a refresh."""
        if self.edges is None:
            return True
        listing, _ = listed(self.spark, self.root, self.limits)
        return not fingerprint_changes(listing, self.fingerprints).isEmpty()


