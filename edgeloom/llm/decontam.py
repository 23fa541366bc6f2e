"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are short sets of k-word shingles inside documents of any length. Items are partitioned by size (powers of
two). An item of q shingles that a document holds to the share t can miss at most q - ceil(t q) of them, so a sketch
of more minima than that (the smallest values of a universal hash; the length is fixed for each size partition) shares
at least `sketch - misses` minima with the document: no contained item is lost. Documents are read once; the shingles
that occur in any sketch vote for items, and an item with enough votes is verified by exact containment of the words.

An item with fewer than k words is one shingle of its own length and is found as a run of words. An item without words
is never found. Items are broadcast in blocks of a fixed number of shingles, each against all documents, so that a
benchmark of any size works.

Nulls: a null text has no shingles; a null item text has no words; null ids are kept as null. Repeated rows of
documents each get their own result, equal items (id and text) count once. Empty tables give no matches.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, mixed, packed, shingle_hashes, texts_of, words_of

#: Words of items in a block.
BLOCK_WORDS = 2_000_000
_FOUND = "array<struct<item_id:bigint,item_shingles:int,found:int>>"
_FOUND_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("item_shingles", pa.int32()), ("found", pa.int32())]))


def shingles(words: list[bytes], k: int) -> set[tuple[bytes, ...]]:
    return set(zip(*(words[i:] for i in range(k)), strict=False)) if k else set()


class Sketches:
    """Sketches of items, indexed by hash."""

    def __init__(self, items: list[tuple[int | None, bytes | None]], k: int, num: int, den: int):
        self.k, self.num, self.den = k, num, den
        self.items = []  # (item_id, length of a shingle, shingles)
        keys, owners, self.votes = [], [], []
        for item_id, text in items:
            words = words_of(text or b"")
            if not words:
                continue
            n = min(k, len(words))
            h = np.unique(shingle_hashes(words, n))
            q = len(h)
            misses = q - -(-num * q // den)
            top = 1 << (q - 1).bit_length()  # the size partition: more than top / 2, at most top shingles
            length = min(q, top - -(-num * top // den) + 1)
            sketch = h[np.argsort(mixed(h ^ np.uint64(0x5851F42D4C957F2D)), kind="stable")[: max(length, misses + 1)]]
            keys.append(sketch)
            owners.append(np.full(len(sketch), len(self.items)))
            self.votes.append(len(sketch) - misses)
            self.items.append((item_id, n, shingles(words, n)))
        self.lengths = sorted({n for _, n, _ in self.items})
        order = np.argsort(np.concatenate(keys), kind="stable") if keys else np.empty(0, int)
        self.keys = np.concatenate(keys)[order] if keys else np.empty(0, np.uint64)
        self.owners = np.concatenate(owners)[order] if keys else np.empty(0, int)
        bits = max(16, int(4 * len(self.keys)).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[(self.keys & self.mask).astype(np.int64)] = True

    def find(self, text: bytes | None) -> list[tuple[int | None, int, int]]:
        """(item_id, shingles of the item, those in the text) of each item that the text holds."""
        words = words_of(text) if text else []
        votes: Counter = Counter()
        for n in self.lengths:
            if len(words) >= n:
                h = shingle_hashes(words, n)
                h = h[self.maybe[(h & self.mask).astype(np.int64)]]
                for x in np.unique(h) if len(h) else ():
                    a, b = np.searchsorted(self.keys, x, "left"), np.searchsorted(self.keys, x, "right")
                    votes.update(self.owners[a:b].tolist())
        likely = sorted(i for i, v in votes.items() if v >= self.votes[i])
        own = {n: shingles(words, n) for n in {self.items[i][1] for i in likely}}
        out = []
        for i in likely:
            item_id, n, item = self.items[i]
            found = len(item & own[n])
            if found * self.den >= self.num * len(item):
                out.append((item_id, len(item), found))
        return out


def searched(docs: DataFrame, benchmark: DataFrame, keep: str, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The column `keep` of each row and `found`, the items that its text holds to the share num / den."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct()
    words = items.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"\s+")))).first()[0] or 0
    blocks = -(-words // BLOCK_WORDS) or 1
    out = docs.select(keep, F.col("text").cast("string"), F.lit(None).cast(_FOUND).alias("found"))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in out.schema])
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()  # about BLOCK_WORDS words
        rows = sorted((((r.item_id, None if r.text is None else r.text.encode()) for r in rows)), key=repr)
        shared = spark.sparkContext.broadcast(rows)
        last = b == blocks - 1

        def run(batches, shared=shared, last=last):
            sketches = Sketches(shared.value, k, num, den)
            for batch in batches:
                found = [sketches.find(t) for t in texts_of(batch)]
                before = column(batch, "found").to_pylist()
                both = [[*(x or []), *({"item_id": i, "item_shingles": q, "found": n} for i, q, n in y)] for x, y in zip(before, found, strict=True)]
                text = pa.nulls(batch.num_rows, pa.string()) if last else column(batch, "text")
                yield pa.RecordBatch.from_arrays([column(batch, keep), text, pa.array(both, _FOUND_TYPE)], [keep, "text", "found"])

        out = out.mapInArrow(run, schema)
    return out.select(keep, "found")


def matches(docs: DataFrame, benchmark: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, item_id, item_shingles and found of each item in each document."""
    found = searched(packed(docs.select("doc_id", "text")), benchmark, "doc_id", k, num, den)
    return found.select("doc_id", F.inline("found"))


def clean(docs: DataFrame, benchmark: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows whose texts hold no item."""
    return searched(packed(docs), benchmark, "row", k, num, den).where(F.size("found") == 0).select("row.*")
