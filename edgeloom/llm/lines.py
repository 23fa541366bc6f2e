"""Line dedup by a segment-partition edit join.

A line is a text between line feeds without surrounding white space; empty lines don't count. Two lines are linked if
their edit distance is at most t(length of the shorter one), t = min(MAX_EDITS, length // CHARS_PER_EDIT): short lines
must be equal. A line of length l with t edits is cut into t + 1 segments; a line within t edits holds one of them
unchanged, at few places: the probes (multi-match-aware, Li et al., 2011), for each length that it can be linked with.
Lines that share a key (length, segment number, content) meet in a bucket, in blocks with the bucket's leader
(blocks.py), where a bit-parallel edit distance in a band of 2 t + 1 diagonals verifies them; equal lines count once. The
classes are the components of the links. Of each class the first line stays, by (doc_id, line number).

Lines are named by 128-bit hashes (two of 10^15 different lines have the same name with probability 1e-9). Keys, and
lines in the buckets of keys, go by 64 bits: a collision there only adds candidates. Links are verified on the contents.

Nulls: a null text has no lines; a null doc_id sorts first. Repeated rows repeat their lines, of which the first stays
(rows with equal doc_id and line number count as one place). An empty table gives no rows. Long lines are taken whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import linked, shared_buckets
from .common import column, join_groups, keep_keys, only_result, packed, stored, text_rows, texts_of
from .graph import components

MAX_EDITS = 2
CHARS_PER_EDIT = 10
BLOCK = 512
#: Classes of letters that are counted before a distance is taken.
LETTERS = 64
#: Rows of the banded distance that share the masks of their letters.
ROWS = 256


def edits_for(length: int) -> int:
    return min(MAX_EDITS, length // CHARS_PER_EDIT)


def segments(length: int) -> list[tuple[int, int]]:
    """(start, size) of the segments of a line."""
    parts = edits_for(length) + 1
    size, longer = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        n = size + (i >= parts - longer)
        out.append((at, n))
        at += n
    return out


_plans: dict[int, list[tuple[int, int, int, bool]]] = {}


def keys_plan(length: int) -> list[tuple[int, int, int, bool]]:
    """(seed, start, size, index) of all keys of a line: its segments, and its probes for each length it can link with."""
    if length not in _plans:
        plan = [(length * 8 + i, start, size, True) for i, (start, size) in enumerate(segments(length))] if edits_for(length) else []
        for other in range(max(1, length - MAX_EDITS), length + 1):
            t, longer = edits_for(other), length - other
            if not t or longer > t:
                continue
            for i, (start, size) in enumerate(segments(other)):
                low = max(0, start - i, start + longer - (t - i))
                high = min(length - size, start + i, start + longer + (t - i))
                plan += [(other * 8 + i, p, size, False) for p in range(low, high + 1)]
        if len(_plans) > 50_000:
            _plans.clear()
        _plans[length] = plan
    return _plans[length]


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance is at most `edits`: common ends are cut off, then bit-parallel rows (Wu and Manber), one
    for each number of edits, move down a band of 2 edits + 1 diagonals."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > edits:
        return False
    n = len(a)
    k = 0
    while k < n and a[k] == b[k]:
        k += 1
    e = 0
    while e < n - k and a[n - 1 - e] == b[len(b) - 1 - e]:
        e += 1
    a, b = a[k : n - e], b[k : len(b) - e]
    if not a or not edits:
        return len(b) <= edits
    # Bit x stands for the diagonal x - edits: places in a ahead of those in b.
    full = (1 << (2 * edits + 1)) - 1
    # reach[d]: the diagonals (as bits) on which d edits cover the rows so far.
    reach = [((1 << (edits + d + 1)) - 1) & ~((1 << edits) - 1) & full for d in range(edits + 1)]
    for base in range(0, len(b), ROWS):  # the places of letters only near the band, so that a mask stays short
        places: dict[str, int] = {}
        low = max(0, base - edits)
        for i, c in enumerate(a[low : base + ROWS + edits], low - base + edits):
            places[c] = places.get(c, 0) | 1 << i
        for i, c in enumerate(b[base : base + ROWS]):
            equal = places.get(c, 0) >> i & full
            new = []
            for d in range(edits + 1):
                cells = reach[d] & equal
                if d:
                    cells |= reach[d - 1] | reach[d - 1] >> 1 | new[d - 1] << 1
                new.append(cells & full)
            reach = new
            if not reach[edits]:
                return False
    return bool(reach[edits] >> (len(a) - len(b) + edits) & 1)


def names(lines: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """128-bit names of lines, as digests and as two columns of signed integers."""
    digests = list(map(xxhash.xxh3_128_digest, lines))
    a, b = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2).T.copy()
    return digests, a, b


def lines_of(text: bytes | None) -> list[tuple[int, bytes]]:
    """(number, line) of the lines that count."""
    return [(i, s) for i, x in enumerate(text.split(b"\n")) if (s := x.strip())] if text else []


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, line (number) and name (a, b) of each line."""

    def run(batches):
        for batch in batches:
            doc, line, found = [], [], []
            for d, t in zip(column(batch, "doc_id").to_pylist(), texts_of(batch), strict=True):
                for i, s in lines_of(t):
                    doc.append(d)
                    line.append(i)
                    found.append(s)
            _, a, b = names(found)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(line, pa.int32()), pa.array(a), pa.array(b)], ["doc_id", "line", "a", "b"])

    return text_rows(docs).mapInArrow(run, "doc_id long, line int, a long, b long")


#: Names of lines that a task remembers, so as to send a repeated line once.
SEEN = 200_000


def _distinct(batch: pa.RecordBatch, seen: set[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Names and lines of a batch, but for those that this task has seen."""
    found = list({s for t in texts_of(batch) for _, s in lines_of(t)})
    digests, a, b = names(found)
    new = [k for k, x in enumerate(digests) if x not in seen]
    if len(seen) > SEEN:
        seen.clear()
    seen.update(digests[k] for k in new)
    return a[new], b[new], [found[k] for k in new]


def contents(docs: DataFrame) -> DataFrame:
    """Name and content of the lines, each at least once."""

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            a, b, found = _distinct(batch, seen)
            for i in range(0, len(found), 20_000):
                at = slice(i, i + 20_000)
                yield pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(b[at]), pa.array(found[at], pa.binary())], ["a", "b", "content"])

    return text_rows(docs).select("text").mapInArrow(run, "a long, b long, content binary")


def keys(docs: DataFrame) -> DataFrame:
    """bucket, a (of the name) and whether the key is a segment, for the keys of all lines."""

    def run(batches):
        digest, seen = xxhash.xxh3_64_intdigest, set()
        for batch in batches:
            buckets, counts, index = [], [], []
            a, _, found = _distinct(batch, seen)
            for raw in found:
                line = raw.decode("utf-8", "replace")
                plan = keys_plan(len(line))
                if line.isascii():
                    buckets += [digest(raw[at : at + size], seed) for seed, at, size, _ in plan]
                else:
                    buckets += [digest(line[at : at + size].encode(), seed) for seed, at, size, _ in plan]
                counts.append(len(plan))
                index += [x[3] for x in plan]
            own = np.repeat(a, counts) if counts else np.empty(0, np.int64)
            bucket = np.array(buckets, np.uint64).view(np.int64)
            for i in range(0, len(own), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000], t) for x, t in ((bucket, pa.int64()), (own, pa.int64()), (index, pa.bool_()))], ["bucket", "a", "index"])

    return text_rows(docs).select("text").mapInArrow(run, "bucket long, a long, index boolean")


def _similar(payload):
    lines = [x.decode("utf-8", "replace") for x in payload[0].to_pylist()]
    size = np.array([len(x) for x in lines])
    # How often letters occur (their codes modulo LETTERS): an edit changes two counts by one at most.
    letters = np.stack([np.bincount(np.frombuffer(x.encode("utf-32-le", "replace"), "<u4") % LETTERS, minlength=LETTERS) for x in lines]).astype(np.int32)

    def match(k, others, label):
        others = others[np.abs(size[others] - size[k]) <= MAX_EDITS]
        others = others[np.abs(letters[others] - letters[k]).sum(1) <= 2 * MAX_EDITS]
        for m in others:
            if label[m] != label[k] and within(lines[k], lines[m], edits_for(int(min(size[k], size[m])))):
                yield m

    return match


def line_links(docs: DataFrame, each: DataFrame) -> DataFrame:
    """Links (a, b) between the ids of lines: a spanning forest of all links. each: id and name (a, b) of every line."""
    rows = keys(docs)
    sizes = rows.groupBy("bucket").agg(F.min("a").alias("low"), F.max("a").alias("high"), F.max("index").alias("index"))
    open_ = stored(sizes.where("low < high and index").select("bucket"), "line-buckets")
    members = stored(keep_keys(rows.select("bucket", "a"), open_, "bucket").distinct(), "line-members")
    total = members.count()
    named = stored(keep_keys(each.select("a", "b", "id"), stored(members.select("a").distinct(), "line-names", total), "a"), "line-ids", total)
    shared = shared_buckets(keep_keys(members, named.select("a", "id"), "a").select("bucket", "id"), total, "line")
    wanted = stored(keep_keys(named, shared.select("id").distinct(), "id"), "line-wanted", total)
    texts = keep_keys(contents(docs), wanted, ["a", "b"]).select("id", "content").dropDuplicates(["id"])
    candidates = stored(shared.join(texts, "id"), "line-candidates")
    return linked(candidates, ["content"], _similar, "line-links", block=BLOCK, rows=candidates.count())


def line_classes(docs: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """Name (a, b), doc_id, line and copies of the first occurrence of each different line, and class_doc_id, class_line
    of the line that stays for its class. places: the occurrences, if they are stored."""
    first = F.min(F.struct("doc_id", "line")).alias("first")
    each = (occurrences(docs) if places is None else places).groupBy("a", "b").agg(first, F.count("*").alias("copies"))
    each = stored(each.withColumn("id", F.monotonically_increasing_id()), "lines")
    linked_ = stored(components(line_links(docs, each)).join(each.select("id", "first"), "id"), "line-roots")
    lowest = linked_.groupBy("root").agg(F.min("first").alias("stays"), F.count("*").alias("n"))
    linked_ = join_groups(linked_.select("id", "root"), lowest, ["root"], "n", linked_.count()).select("id", "stays")
    out = each.join(linked_, "id", "left").withColumn("stays", F.coalesce("stays", "first"))
    return out.select("a", "b", "first.doc_id", "first.line", "copies", F.col("stays.doc_id").alias("class_doc_id"), F.col("stays.line").alias("class_line"))


def line_members(docs: DataFrame) -> DataFrame:
    """doc_id, line and copies of each occurrence of a line, class_doc_id and class_line of the line that stays for its
    class, and kept: whether it is that line."""

    def build() -> tuple[DataFrame, int]:
        where = stored(occurrences(docs), "line-places")
        classes = stored(line_classes(docs, where), "line-classes").select("a", "b", "copies", "class_doc_id", "class_line")
        found = join_groups(where, classes, ["a", "b"], "copies", where.count())
        kept = F.col("doc_id").eqNullSafe(F.col("class_doc_id")) & (F.col("line") == F.col("class_line"))
        return found.select("doc_id", "line", "copies", "class_doc_id", "class_line", kept.alias("kept")), where.count()

    return only_result(docs.sparkSession, "line-result", build)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows with only those lines that stay for their class (empty lines stay)."""
    gone = line_members(docs).where("not kept")
    gone = gone.groupBy("doc_id").agg(F.collect_set("line").alias("gone")).withColumnRenamed("doc_id", "id")
    out = packed(docs).join(gone, F.col("doc_id").eqNullSafe(F.col("id")), "left")
    kept = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.when(~F.array_contains("gone", i), x)), lambda x: x.isNotNull())
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return out.select(F.col("row").withField("text", text).alias("row")).select("row.*")
