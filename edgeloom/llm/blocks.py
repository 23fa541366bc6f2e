"""Links within buckets, without all pairs.

A bucket holds ids that may be linked. Buckets with the same leader, their smallest id, are taken as one. The members of
a bucket meet in blocks of bounded size, each with the leader. In a block, a member is compared with all others
(numpy), but only links that join two parts that aren't joined yet are returned: fewer than members. Members that are
joined with the leader, directly or through others, are joined with each other, whatever their blocks. So only the open
members, those that no block joins with the leader, go on: they meet the members of the other blocks. A bucket of copies
costs as much as it has members, and the links give the same components as all pairs would.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_groups, keep_keys, stored, within_broadcast

BLOCK = 1024


def shared_buckets(members: DataFrame, total: int, what: str) -> DataFrame:
    """(bucket, id, n, low) of buckets with at least two members, n in all and the smallest one `low`, from `total` distinct
    (bucket, id). Buckets with the same smallest member become one: copies share many buckets, and nearly all of these have
    the same leader, so a copy goes on a few times, not once for each."""
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    kept = stored(sizes.where("n > 1"), f"{what}-kept", total // 2)
    if within_broadcast(kept):
        met = members.join(F.broadcast(kept), "bucket")
    else:
        met = join_groups(members, kept, ["bucket"], "n", total)
    met = stored(met.select(F.col("low").alias("bucket"), "id").distinct(), f"{what}-met", total)
    rows = met.count()
    counts = stored(met.groupBy("bucket").agg(F.count("*").alias("n")), f"{what}-sizes", rows)
    if within_broadcast(counts):
        shared = met.join(F.broadcast(counts), "bucket")
    else:
        shared = join_groups(met, counts, ["bucket"], "n", rows)
    return stored(shared.withColumn("low", F.col("bucket")), f"{what}-shared", rows)


class _Parts:
    """Which members are joined: equal labels."""

    def __init__(self, labels: np.ndarray, ids: np.ndarray):
        self.label, self.ids, self.links = labels, ids, []

    def meet(self, k: int, others: np.ndarray, match: Callable) -> None:
        others = others[self.label[others] != self.label[k]]
        if len(others):
            for m in match(k, others, self.label):
                if self.label[m] != self.label[k]:
                    self.links.append((self.ids[k], self.ids[m]))
                    self.label[self.label == self.label[m]] = self.label[k]


_LINKS = "a long, b long, bucket long"


def _table(links: list, open_: list, bucket: int | None) -> pa.Table:
    """Links, and open members (a) with the label of their part (b), told apart by `bucket`."""
    a, b = zip(*links, *open_, strict=True) if links or open_ else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "bucket": pa.array([None] * len(links) + [bucket] * len(open_), pa.int64())})


def linked(members: DataFrame, payload: list[str], matcher: Callable[[list], Callable], what: str, blocks: Column | None = None, block: int | None = None, rows: int | None = None) -> DataFrame:
    """Links (a, b) of members (bucket, id, n, low and the payload columns), stored. matcher(payload columns) gives
    match(k, others, label): which of the `others` (indices) the k-th member is linked with; members with equal labels are
    joined already. blocks: into how many blocks a bucket is cut, if more than its size asks for. rows: how many members there are, if it's known."""
    block = block or BLOCK
    size = F.ceil(F.col("n") / block)
    cut = (size if blocks is None else F.greatest(size, blocks)).cast("int")
    members = members.withColumn("_cut", cut).withColumn("_own", F.pmod(F.xxhash64("id", F.lit(3)), F.col("_cut")).cast("int"))
    everywhere = F.sequence(F.lit(0), F.col("_cut") - 1)
    dealt = members.withColumn("i", F.explode(F.when(F.col("id") == F.col("low"), everywhere).otherwise(F.array("_own"))))

    def first(table: pa.Table) -> pa.Table:
        order = np.argsort(table["id"].to_numpy(), kind="stable")  # the leader comes first
        ids = table["id"].to_numpy()[order]
        match = matcher([table[c].take(pa.array(order)) for c in payload])
        parts = _Parts(np.arange(len(ids)), ids)
        for k in range(len(ids) - 1):
            parts.meet(k, np.arange(k + 1, len(ids)), match)
        open_ = []
        if table["_cut"][0].as_py() > 1:
            names = {}  # a part is named by its first member
            for k, x in enumerate(parts.label.tolist()):
                names.setdefault(x, ids[k])
            open_ = [(ids[k], names[x]) for k, x in enumerate(parts.label.tolist()) if x != parts.label[0]]
        return _table(parts.links, open_, table["bucket"][0].as_py())

    found = dealt.select("bucket", "i", "id", "_cut", *payload).groupBy("bucket", "i").applyInArrow(first, _LINKS)
    found = stored(found, f"{what}-first", rows)
    links, open_ = found.where("bucket is null").select("a", "b"), found.where("bucket is not null").select("bucket", F.col("a").alias("id"), F.col("b").alias("label"))
    if open_.limit(1).count() == 0:
        return links

    # Open members, in blocks of their own, meet all blocks of their bucket.
    counts = open_.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("_open"))
    rest = keep_keys(members, stored(counts, f"{what}-open"), "bucket").join(open_, ["bucket", "id"], "left")
    mine = F.pmod(F.xxhash64("id", F.lit(5)), F.col("_open")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("_open") - 1))
    asking = rest.where("label is not null").withColumns({"j": mine, "asks": F.lit(True)}).withColumn("i", F.explode(everywhere))
    asked = rest.withColumns({"i": F.col("_own"), "asks": F.lit(False), "label": F.coalesce("label", "low")}).withColumn("j", every)
    columns = ["bucket", "i", "j", "id", "label", "asks", *payload]

    def second(table: pa.Table) -> pa.Table:
        ids, asks = table["id"].to_numpy(), table["asks"].to_numpy(zero_copy_only=False)
        match = matcher([table[c] for c in payload])
        parts = _Parts(np.unique(table["label"].to_numpy(), return_inverse=True)[1], ids)
        others = np.flatnonzero(~asks)
        for k in np.flatnonzero(asks):
            parts.meet(k, others, match)
        return _table(parts.links, [], None)

    more = asking.select(*columns).unionByName(asked.select(*columns)).groupBy("bucket", "i", "j").applyInArrow(second, _LINKS)
    return stored(links.unionByName(more.select("a", "b")), f"{what}-links", rows)
