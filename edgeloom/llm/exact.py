"""Exact dedup by deterministic block naming.

A text (A-Z lower-cased, UTF-8; null is empty) is cut into blocks of fixed size. All blocks are sorted and each
distinct block gets an integer, its partition and its rank there; then adjacent pairs of names are named in the same way,
level by level, until each document has one name. Two documents have the same (levels, name) exactly if their texts are equal: names
come from sorting the contents, so no collision can merge texts.

One sort moves the contents once. The order is (64-bit hash, content, place); the range partitions are cut at (hash,
place), so the copies of a hot block spread over many partitions. Where the last hash of a partition is the first of the
next one, a join of the contents with that hash aligns their names; the driver sees the hashes at the borders only.

Nulls: a null text equals an empty one; a null doc_id is a row like any other and loses against every number; in a
group of null ids only, keep_id is null and each row stays. Repeated rows (same doc_id) with equal texts both stay if
their id is the largest. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, join_groups, partitions_for, stored, text_rows, texts_of

BLOCK = 8192

_OWN = [("row", "long", pa.int64()), ("doc_id", "long", pa.int64()), ("pos", "int", pa.int32()), ("blocks", "int", pa.int32()), ("text_sha256", "string", pa.string())]
_RANK = [("part", "int", pa.int32()), ("rank", "long", pa.int64()), ("h", "long", pa.int64()), ("edge", "binary", pa.binary())]


def _ddl(fields) -> str:
    return ", ".join(f"{name} {sql}" for name, sql, _ in fields)


def _batch(columns: list, fields) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kind) for c, (_, _, kind) in zip(columns, fields, strict=True)], [name for name, _, _ in fields])


_CUT = [*_OWN, ("block", "binary", pa.binary())]


def _cut(size: int):
    """Blocks of each text; `row` names a row of the scan, since a doc_id may repeat or be null."""

    def run(batches):
        row = (TaskContext.get().partitionId() << 40) - 1
        for batch in batches:
            out = []
            for doc, text in zip(column(batch, "doc_id").to_pylist(), texts_of(batch), strict=True):
                row += 1
                text = (text or b"").lower()
                n = max(1, -(-len(text) // size))
                sha = hashlib.sha256(text).hexdigest()
                out += [(row, doc, k, n, None if k else sha, text[k * size : (k + 1) * size]) for k in range(n)]
                if len(out) >= 2000:
                    yield _batch(list(zip(*out, strict=True)), _CUT)
                    out = []
            if out:
                yield _batch(list(zip(*out, strict=True)), _CUT)

    return run


def _ranked(batches):
    """Ranks of the distinct contents of a sorted partition. `edge` holds the contents that share their hash with the
    first or the last row: only those can go on in a neighbour."""
    part, rank, last, first_h, last_h = TaskContext.get().partitionId(), -1, None, None, None
    tail: list[tuple[int, bytes]] = []
    for batch in batches:
        ranks, edges = [], []
        hs = column(batch, "h").to_pylist()
        for h, block in zip(hs, column(batch, "block").to_pylist(), strict=True):
            new = last is None or h != last_h or block != last
            if new:
                rank += 1
                first_h = h if first_h is None else first_h
                tail = [*(tail if h == last_h else []), (rank, block)]
                last_h, last = h, block
            ranks.append(rank)
            edges.append(block if new and h == first_h else None)
        yield _batch([*(column(batch, name) for name, _, _ in _OWN), [part] * len(hs), ranks, hs, edges], _OWN + _RANK)
    if last_h != first_h:  # rows with a null `row` only carry the last contents to the driver
        none = [None] * len(tail)
        yield _batch([none, none, none, none, none, [part] * len(tail), [r for r, _ in tail], [last_h] * len(tail), [b for _, b in tail]], _OWN + _RANK)


def named(blocks: DataFrame, partitions: int, what: str) -> DataFrame:
    """The rows with an integer `name` in place of `block`: equal blocks get equal names, different ones different
    names, whatever their hashes."""
    spark = blocks.sparkSession
    ordered = blocks.select(*(name for name, _, _ in _OWN), F.xxhash64("block").alias("h"), "block")
    ordered = ordered.repartitionByRange(partitions, "h", "row", "pos").sortWithinPartitions("h", "block")
    ranked = stored(ordered.mapInArrow(_ranked, _ddl(_OWN + _RANK)), what)

    ends = sorted(ranked.groupBy("part").agg(F.min("h").alias("first"), F.max("h").alias("last")).collect())
    out, name = ranked.where("row is not null"), F.shiftleft(F.col("part").cast("long"), 40).bitwiseOR(F.col("rank"))
    if shared := sorted({b.first for a, b in zip(ends, ends[1:], strict=False) if a.last == b.first}):
        # Contents that go on from an earlier partition, a few in each, take the name that they have there.
        hashes = spark.createDataFrame([(h,) for h in shared], "h long")
        edges = ranked.where("edge is not null").join(F.broadcast(hashes), "h", "left_semi").select("part", "rank", "h", "edge", name.alias("own"))
        one = edges.groupBy("h", "edge").agg(F.min("own").alias("moved"))
        moved = edges.join(one, ["h", "edge"]).where("own <> moved").select("part", "rank", "moved")
        out, name = out.join(F.broadcast(moved), ["part", "rank"], "left"), F.coalesce("moved", name)
    return out.select(*(x for x, _, _ in _OWN), name.alias("name"))


def identities(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, text_sha256, levels and name of each row; (levels, name) is equal exactly for equal texts.

    Rows of one block are done at once. Only the blocks of the others go up the levels, stored at each so that no level
    works out the names of an earlier one again; their documents meet the names of all levels in one join.
    """
    docs = text_rows(docs)
    rows = docs.count()
    names = named(docs.mapInArrow(_cut(block), _ddl(_CUT)), min(partitions_for(docs.sparkSession, rows, 50_000), rows // 1000 + 1), "blocks")
    done = names.where("blocks = 1").select("doc_id", "text_sha256", F.lit(0).alias("levels"), "name")
    open_, level, ends = stored(names.where("blocks > 1"), "open-0"), 0, []
    facts = open_.where("pos = 0").select("row", "doc_id", "text_sha256")
    while (left := open_.count()) > 0:
        level += 1
        side = lambda k: F.max(F.when(F.col("pos") % 2 == k, F.col("name")))
        pairs = open_.groupBy("row", F.shiftright("pos", 1).alias("pos"), F.ceil(F.col("blocks") / 2).cast("int").alias("blocks")).agg(side(0).alias("a"), side(1).alias("b"))
        pairs = pairs.withColumn("block", F.concat_ws(":", "a", F.coalesce(F.col("b").cast("string"), F.lit("-"))).cast("binary"))
        pairs = pairs.select("row", F.lit(None).cast("long").alias("doc_id"), "pos", "blocks", F.lit(None).cast("string").alias("text_sha256"), "block")
        names = named(pairs, left // 200_000 + 1, f"pairs-{level}")  # pairs are a few bytes
        ends.append(names.where("blocks = 1").select("row", F.lit(level).alias("levels"), "name"))
        open_ = stored(names.where("blocks > 1"), f"open-{level}")
    if ends:
        long = facts.join(reduce(DataFrame.unionByName, ends), "row")
        done = done.unionByName(long.select("doc_id", "text_sha256", "levels", "name"))
    return stored(done, "identities")


def exact_groups(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of each row; of equal texts the largest doc_id stays."""
    rows = identities(docs, block)
    groups = rows.groupBy("levels", "name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    out = join_groups(rows, groups, ["levels", "name"], "group_size", rows.count())
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
