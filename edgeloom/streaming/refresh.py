"""Refresh of fingerprints from a stream of file events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.index import fingerprint_changes
from ..plans.settle import settled


class FingerprintStream:
    """Keeps the fingerprints (path, size, mtime_ms) of files that a stream of listings reports.

    Each micro-batch holds current fingerprints of some files, a null size meaning that a file is gone; `on_change` gets
    the files that changed, as an incremental refresh would see them.
    """

    def __init__(self, start: DataFrame, on_change=None):
        self.state, self.on_change = start, on_change

    def apply(self, batch: DataFrame, epoch: int = 0) -> None:
        last = batch.groupBy("path").agg(F.max_by(F.struct("size", "mtime_ms"), "mtime_ms").alias("f")).select("path", "f.*")
        touched = self.state.join(last.select("path"), "path")
        changes = settled(fingerprint_changes(last.where("size is not null"), touched))
        if self.on_change:
            self.on_change(changes)
        kept = self.state.join(last.select("path"), "path", "left_anti")
        self.state = settled(kept.unionByName(last.where("size is not null").select(*kept.columns)))

    def start(self, listings: DataFrame, **options) -> StreamingQuery:
        return listings.writeStream.options(**options).foreachBatch(self.apply).start()
