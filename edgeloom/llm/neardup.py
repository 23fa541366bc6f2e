"""Near-duplicate documents: MinHash, banding, verification, components.

A document is its set of distinct k-word shingles (A-Z lower-cased; the whole sequence if it has fewer words), as
64-bit hashes. Documents with equal sets form a class, of which the smallest id goes on. Each class gets HASHES
universal hash minima, of which 16 bits each are its signature, in bands of ROWS; classes that share a band meet in a
bucket. Signatures prune a bucket to links whose estimate is near the threshold or above, and the components of these
links, each a superset of final components, are verified on full sets: size(a & b) * den >= num * size(a | b). Either
step takes members in blocks with the leader of their bucket or component (blocks.py) and returns a spanning forest;
components come from alternating large-star and small-star.

At the threshold 0.8 a pair shares none of 32 bands of 4 with probability 5e-8, and falls under the estimate's floor
(75 of 128 minima or fewer, six standard deviations) with 2.7e-8 (binomial); below are no caps. Copies of a text collapse
into one class by partial aggregation before anything meets.

A text that is null or has no words has an empty set and is linked with nothing. Rows with the same doc_id count as
one document each; a null doc_id is linked with nothing and is its own (null) component. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import linked, shared_buckets
from .common import column, join_groups, keep_keys, only_result, packed, shingle_set, stored, text_rows, texts_of, within_broadcast
from .graph import components

HASHES, ROWS = 128, 4
#: Standard deviations that the estimate may fall short of the threshold.
SLACK = 6.0
#: Members and shingles of a block.
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000

_rng = np.random.default_rng(20_240_607)
_A = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def minima(hashes: np.ndarray) -> np.ndarray:
    """HASHES minima of multiply-add-shift hashes (universal on 32 bits) of a set."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint64)
    keys = hashes & np.uint64(0xFFFFFFFF)
    for i in range(0, len(keys), 256):  # a block stays in the cache
        part = (_A[:, None] * keys[None, i : i + 256] + _B[:, None]) >> np.uint64(32)
        np.minimum(low, part.min(1), out=low)
    return low.astype(np.uint32)


def _set_name(raw: bytes) -> tuple[int, int]:
    """A 128-bit name of a set from its sorted hashes."""
    h = xxhash.xxh3_128_intdigest(raw)
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


_SKETCH = "doc_id long, n_shingles long, set_a long, set_b long, signature binary"


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """Set size, a 128-bit name of the set and the signature (16 bits of each minimum) of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("signature", pa.binary())])

    def run(batches):
        for batch in batches:
            rows, cache = [], {}
            for text in texts_of(batch):
                s = shingle_set(text, k)
                name = _set_name(s.tobytes())
                if name not in cache:
                    cache[name] = minima(s).astype(np.uint16).tobytes() if len(s) else None
                rows.append((len(s), *name, cache[name]))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *(pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:], strict=True))], schema=schema)

    return text_rows(docs).mapInArrow(run, _SKETCH)


def bands(classes: DataFrame) -> DataFrame:
    """(bucket, id): a bucket for each band of a signature."""
    each = classes.select("id", "signature", F.explode(F.sequence(F.lit(0), F.lit(HASHES // ROWS - 1))).alias("band"))
    return each.select(F.xxhash64("band", F.expr(f"substring(signature, band * {2 * ROWS} + 1, {2 * ROWS})")).alias("bucket"), "id")


def _values(column: pa.ChunkedArray, kind) -> list[np.ndarray]:
    """Arrays that share the column's memory."""
    out = []
    for chunk in column.chunks:
        _, offsets, data = chunk.buffers()
        at = np.frombuffer(offsets, np.int32)[chunk.offset : chunk.offset + len(chunk) + 1].tolist()
        raw = data or b""
        out += [np.frombuffer(raw, kind, (b - a) // kind().itemsize, a) if b > a else np.empty(0, kind) for a, b in zip(at, at[1:])]
    return out


def _estimate(floor: float):
    """Matches signatures whose share of equal minima is at least floor."""

    def matcher(payload):
        sig = np.stack(_values(payload[0], np.uint16))
        need = int(np.ceil(floor * sig.shape[1]))
        return lambda k, others, label: others[(sig[others] == sig[k]).sum(1) >= need]

    return matcher


def _verified(floor: float, num: int, den: int):
    """Matches sets with the asked Jaccard similarity; signatures rule out most pairs before."""

    def matcher(payload):
        sig, sets = np.stack(_values(payload[0], np.uint16)), _values(payload[1], np.uint64)
        size = np.array([len(s) for s in sets])
        need = int(np.ceil(floor * sig.shape[1]))

        def match(k, others, label):
            others = others[np.minimum(size[others], size[k]) * den >= num * np.maximum(size[others], size[k])]
            same = (sig[others] == sig[k]).sum(1)
            for m in others[np.argsort(-same, kind="stable")][: int((same >= need).sum())]:
                if label[m] == label[k]:
                    continue
                both = len(np.intersect1d(sets[k], sets[m], assume_unique=True))
                if both * den >= num * (size[k] + size[m] - both):
                    yield m

        return match

    return matcher


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row: documents with Jaccard similarity >= num / den on k-word
    shingles are linked, component_id is the smallest reachable doc_id, and kept tells whether it is the own one."""
    rows = docs.count()
    return only_result(docs.sparkSession, "near-duplicates", lambda: (_components(docs, rows, k, num, den), rows))


def _components(docs: DataFrame, rows: int, k: int, num: int, den: int) -> DataFrame:
    s = num / den
    floor = s - SLACK * (s * (1 - s) / HASHES) ** 0.5
    sketch = stored(sketches(docs, k), "sketch")
    full = sketch.where("n_shingles > 0 and doc_id is not null")
    name = ["set_a", "set_b"]
    first = [F.first(c).alias(c) for c in ("n_shingles", "signature")]  # equal within a class
    classes = full.groupBy(*name).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), *first)
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    thin = classes.select("id", "doc_id", *name, "n_shingles", "signature")

    shared = shared_buckets(bands(classes), classes.count() * (HASHES // ROWS), "bands")
    signatures = keep_keys(thin.select("id", "signature"), shared.select("id").distinct(), "id")
    near = linked(shared.join(signatures, "id"), ["signature"], _estimate(floor), "near", block=BLOCK, rows=shared.count())

    # Each class of a component with its full set, computed anew from the text of its smallest doc_id.
    wide = stored(components(near).join(thin, "id"), "candidates")
    sizes = wide.groupBy("root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    wide = join_groups(wide, sizes, ["root"], "n", wide.count()).withColumnRenamed("root", "bucket")
    texts = text_rows(docs)
    own = ["id", "bucket", "n", "shingles", "signature"]
    sets = keep_keys(texts, wide.select("doc_id").distinct(), "doc_id").join(wide, "doc_id").select(*own, *name, "text")

    def full_sets(batches):
        for batch in batches:
            raw = [shingle_set(t, k).tobytes() for t in texts_of(batch)]
            same = [_set_name(r) == (a, b) for r, a, b in zip(raw, *(column(batch, c).to_pylist() for c in name), strict=True)]
            out = pa.RecordBatch.from_arrays([*(column(batch, c) for c in own), pa.array(raw, pa.binary())], [*own, "hashes"])
            yield out.filter(pa.array(same, pa.bool_()))  # a doc_id may have several texts

    sets = sets.mapInArrow(full_sets, "id long, bucket long, n long, shingles long, signature binary, hashes binary")
    if full.groupBy("doc_id").count().where("count > 1").limit(1).count():  # copies of a row, too many for a group perhaps
        sets = sets.dropDuplicates(["id"])
    sets = sets.withColumn("low", F.col("bucket"))  # a component has its smallest id as its name
    links = linked(sets, ["signature", "hashes"], _verified(floor, num, den), "links", F.ceil(F.col("shingles") / BLOCK_SHINGLES), BLOCK, wide.count())

    # Documents -> their class -> its component -> the smallest doc_id there.
    joined = stored(components(links).join(classes.select("id", "doc_id", "copies", *name), "id"), "joined")
    lowest = joined.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    joined = join_groups(joined, lowest, ["root"], "n", joined.count()).select(*name, "component_id")
    named = classes.select(*name, "copies", "doc_id").join(joined, name, "left").select(*name, "copies", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = join_groups(full.select("doc_id", "n_shingles", *name), named, name, "copies", rows).select("doc_id", "n_shingles", "component_id")
    rest = sketch.where("not (n_shingles > 0 and doc_id is not null)").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each component: the rows with its smallest doc_id (the first text of a repeated id, in byte
    order). Rows with a null doc_id stay."""

    def gone() -> tuple[DataFrame, int]:
        found = near_duplicates(docs, k, num, den).where("doc_id is not null")
        return found.groupBy("doc_id").agg(F.max("kept").alias("stays")).where("not stays").select("doc_id"), found.count()

    ids, rows = only_result(docs.sparkSession, "gone", gone), packed(docs)
    kept = rows.join(F.broadcast(ids) if within_broadcast(ids) else ids, "doc_id", "left_anti")
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    if repeated:
        first = kept.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("text", "row")).alias("least"))
        kept = first.select("doc_id", "least.text", "least.row").unionByName(kept.where("doc_id is null"))
    return kept.select("row.*")
