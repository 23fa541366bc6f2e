"""Sharding by minimax contiguous partition.

Rows with equal texts form an atomic group; groups are ordered by their smallest doc_id. The smallest capacity for
which a greedy walk needs at most `shards` runs is found by binary search, and the order is cut there. The law is
`bytes`: no assignment of contiguous groups has a smaller largest shard.

The ordered group sizes stay in a stored table in range partitions. The driver keeps one sum per partition and
fetches a partition's prefix sums (BIN groups at most) when the greedy walk has to cut inside it.

Nulls: a null text has no bytes and size 1, and shares a group with empty texts; a null doc_id sorts first.
Repeated rows are separate rows of one group. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import global_sorted, join_groups, stored

#: Groups in a range partition, and so the most that the driver fetches at once.
BIN = 65_536


class Prefixes:
    """Ordered group sizes as prefix sums, of which the driver holds a total per bin and a few fetched bins."""

    def __init__(self, groups: DataFrame):
        self.groups = groups
        self.start([tuple(r) for r in groups.groupBy("_part").agg(F.sum("group_bytes")).orderBy("_part").collect()])

    def start(self, bins: list[tuple[int, int]]) -> None:
        """bins: (part, bytes) of all parts, in order."""
        self.parts, self.starts = [p for p, _ in bins], [0]
        for _, b in bins:
            self.starts.append(self.starts[-1] + b)
        self.total, self.fetched = self.starts[-1], {}

    def sizes(self, part: int) -> list[int]:
        rows = self.groups.where(F.col("_part") == part).select("_row", "group_bytes").collect()
        return [r.group_bytes for r in sorted(rows)]

    def reach(self, bound: int) -> tuple[int, int, int]:
        """The largest prefix sum that is at most `bound` (below the total), and part and row of the group after it."""
        i = bisect_right(self.starts, bound) - 1
        if self.starts[i] == bound:
            return bound, self.parts[i], 0
        if i not in self.fetched:
            if len(self.fetched) >= 16:
                self.fetched.pop(next(iter(self.fetched)))
            self.fetched[i] = list(accumulate(self.sizes(self.parts[i]), initial=self.starts[i]))
        k = bisect_right(self.fetched[i], bound) - 1
        return self.fetched[i][k], self.parts[i], k

    def greedy(self, capacity: int, shards: int) -> list[tuple[int, int, int]] | None:
        """Where shards begin, but for the first, if each takes all that fits; None if `shards` don't suffice."""
        cuts, at = [], 0
        while self.total - at > capacity:
            if len(cuts) == shards - 1:
                return None
            cuts.append(self.reach(at + capacity))
            if cuts[-1][0] == at:
                return None
            at = cuts[-1][0]
        return cuts


def minimax_cuts(prefixes: Prefixes, largest: int, shards: int) -> list[tuple[int, int, int]]:
    """Prefix sum, part and row at which the shards of the best contiguous partition begin, but for the first."""
    low = max(largest, -(-prefixes.total // shards))
    high = -(-prefixes.total // shards) + largest
    while low < high:
        mid = (low + high) // 2
        if prefixes.greedy(mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return prefixes.greedy(low, shards)


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row; the slots of a shard follow (group, doc_id) without gaps."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body).alias("text_crc32"), F.unhex(F.sha2(body, 256)).alias("key"))
    rows = stored(rows, "shard-rows")
    groups = rows.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.sum("size").alias("group_bytes"), F.count("*").alias("group_rows"))
    total = rows.count()
    if not total:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    groups = global_sorted(groups, ["first_id", "key"], total, "shard-groups", BIN // 2)
    prefixes = Prefixes(groups)
    firsts = [(p, r) for _, p, r in minimax_cuts(prefixes, groups.agg(F.max("group_bytes")).first()[0], shards)]
    number = sum((((F.col("_part") > p) | ((F.col("_part") == p) & (F.col("_row") >= r))).cast("int") for p, r in firsts), F.lit(0))
    placed = groups.select("key", "first_id", "group_rows", number.alias("shard"))
    rows = join_groups(rows, placed, ["key"], "group_rows", total)

    rows = global_sorted(rows.select("doc_id", "size", "text_crc32", "shard", "first_id"), ["shard", "first_id", "doc_id"], total, "shard-slots")
    counts = sorted(rows.groupBy("shard", "_part").agg(F.min("_row"), F.count("*")).collect())
    bases, at = [], {}
    for s, p, low, n in counts:
        bases.append((s, p, at.get(s, 0) - low))
        at[s] = at.get(s, 0) + n
    bases = rows.sparkSession.createDataFrame(bases, "shard int, _part int, base long")
    return rows.join(F.broadcast(bases), ["shard", "_part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("_row") + F.col("base")).alias("slot"))
