"""Language-model scoring with a weighted backoff automaton.

The unigram base counts every token of all training documents: P(w) = (c + 0.5) / (N + 0.5 (V + 1)), unknown words
sharing one place. The model is of order ORDER: every n-gram of a training document, up to that length, is in it. A state
is a history of training documents (a start of a text has only end tokens before it); its arc for the word w has the
weight P(w | h) = (c(hw) + a P(w | h')) / (c(h) + a), where h' is h without its first word and a is the strength of that
order (hierarchical Dirichlet smoothing: MacKay and Peto, 1995); its failure arc to h' has the weight a / (c(h) + a), the
mass that its arcs leave. The root has an arc for each word with the weight P(w). So each state is a distribution over
words. One pass from left to right carries the state and adds log10 of the arc, or of the failure arcs down to the first
state that has an arc, and of that arc.

Counts are exact and distributed, and the automaton is too: it grows with the corpus and is never in one place. The scan
is cut into units of about UNIT_BYTES. A unit sends its distinct n-grams, sorted by name, with its own counts to buckets
(ranges of names), which add up and answer with as many counts in the same order: no name goes back. Then the unit's
texts meet the answers and are scored. An n-gram has one entry for each unit that holds it, so none is hot: a bucket has
about as many entries as its share of the text, and one more for each unit and each word that nearly all units hold.
Names are 64-bit hashes (a vocabulary of a million has a collision with probability 3e-8, 10^9 different n-grams with 3 %).

The table is read twice and must give the same rows in the same order (files do); a unit that differs is an error.

A null text is empty and has the end token only. A null in held_out counts as false. Repeated rows are documents of their
own. Without training documents N and V are 0 and each token has P = 1. An empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, mixed, stored, text_rows, texts_of, word_hashes, words_of

ORDER = 3
#: Strength of the shorter history's distribution, by order from 2.
STRENGTH = (1000.0, 10.0)
#: Bytes of text of a unit, of a piece of it on its way, and for which there is a bucket.
UNIT_BYTES, PIECE_BYTES, BUCKET_BYTES = 12 << 20, 2 << 20, 4 << 20
#: Bytes of text for which there is a file of answers, at least: each file starts processes to set modes.
FILE_BYTES = 16 << 20
#: No word contains a line feed, so this is the end token's.
END = np.uint64(xxhash.xxh3_64_intdigest(b"\n"))


def token_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, ends included, and the offsets of the texts."""
    parts, offsets = [], [0]
    for t in texts:
        words = words_of(t) if t else []
        parts.append(np.append(word_hashes(words), END) if words else np.array([END], np.uint64))
        offsets.append(offsets[-1] + len(words) + 1)
    return np.concatenate(parts) if parts else np.empty(0, np.uint64), np.array(offsets, np.int64)


def previous(values: np.ndarray, offsets: np.ndarray, start) -> np.ndarray:
    """The value at the token before each; `start` at the first ones of the texts."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[offsets[:-1]] = start
    return out


def grams(texts: list[bytes | None], longest: int = ORDER) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each order the sorted names of the distinct n-grams and the place of each token's n-gram among them; and the
    offsets of the texts."""
    tokens, offsets = token_hashes(texts)
    out, names, start = [], tokens, END
    for order in range(1, longest + 1):
        if order > 1:  # an n-gram is named by the name of its history and its last word
            history = previous(names, offsets, start)
            names = mixed(mixed(history) + tokens)
            with np.errstate(over="ignore"):
                start = mixed(mixed(np.array([start])) + END)[0]
        out.append(np.unique(names, return_inverse=True))
    return out, offsets


def ranges(names: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted names: buckets are ranges of names."""
    bucket = (names >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    first = np.flatnonzero(np.diff(bucket, prepend=np.uint64(1 << 63))).tolist()
    return [(int(bucket[a]), a, b) for a, b in zip(first, [*first[1:], len(names)])]


def packed_names(names: np.ndarray) -> bytes:
    """Sorted names as differences, byte by byte of all: the high bytes are zeros, which compress."""
    return np.diff(names, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked_names(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel(), dtype=np.uint64)


def packed_counts(counts: np.ndarray) -> bytes:
    return counts.astype(np.min_scalar_type(int(counts.max()))).tobytes()


def unpacked_counts(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, f"<u{len(blob) // n}").astype(np.int64)


def _units(batches, unit_bytes: int):
    """(unit, doc_ids, held_out, texts) of the units of a task's rows."""
    part, number, ids, held, texts, size = TaskContext.get().partitionId() << 32, 0, [], [], [], 0
    for batch in batches:
        for row in zip(column(batch, "doc_id").to_pylist(), column(batch, "held_out").to_pylist(), texts_of(batch), strict=True):
            for values, x in zip((ids, held, texts), row):
                values.append(x)
            size += len(row[2] or b"") + 8
            if size >= unit_bytes:
                yield part + number, ids, held, texts
                number, ids, held, texts, size = number + 1, [], [], [], 0
    if ids:
        yield part + number, ids, held, texts


def _questions(longest: int, unit_bytes: int, buckets: int):
    """The distinct n-grams of each unit with their training counts, by order and bucket."""

    def run(batches):
        for unit, _, held, texts in _units(batches, unit_bytes):
            found, offsets = grams(texts, longest)
            train = np.repeat(~np.array(held, bool), np.diff(offsets))
            for order, (names, at) in enumerate(found, 1):
                counts = np.bincount(at[train], minlength=len(names))
                cuts = ranges(names, buckets)
                for i in range(0, len(cuts), 500):
                    some = cuts[i : i + 500]
                    yield pa.RecordBatch.from_pydict({
                        "ord": pa.array([order] * len(some), pa.int32()), "bucket": pa.array([b for b, _, _ in some], pa.int64()), "unit": pa.array([unit] * len(some), pa.int64()),
                        "names": pa.array([packed_names(names[a:z]) for _, a, z in some], pa.binary()), "counts": pa.array([packed_counts(counts[a:z]) for _, a, z in some], pa.binary()),
                    })

    return run


_ANSWERS = "unit long, ord int, bucket long, counts binary, total long, known long"


def _answer(table: pa.Table) -> pa.Table:
    """The counts in all units of what each unit asked for; and a row without a unit: tokens, and n-grams that occur."""
    names = [unpacked_names(x) for x in table["names"].to_pylist()]
    sizes = [len(x) for x in names]
    u, at = np.unique(np.concatenate(names), return_inverse=True)
    own = [unpacked_counts(x, n) for x, n in zip(table["counts"].to_pylist(), sizes, strict=True)]
    sums = np.bincount(at, np.concatenate(own), len(u)).astype(np.int64)
    ends = np.cumsum(sizes).tolist()
    blobs = [packed_counts(sums[at[b - n : b]]) for n, b in zip(sizes, ends)]
    rows = len(blobs)
    return pa.table({
        "unit": pa.array([*table["unit"].to_pylist(), None], pa.int64()), "ord": pa.array([table["ord"][0].as_py()] * (rows + 1), pa.int32()),
        "bucket": pa.array([table["bucket"][0].as_py()] * (rows + 1), pa.int64()), "counts": pa.array([*blobs, None], pa.binary()),
        "total": pa.array([None] * rows + [int(sums.sum())], pa.int64()), "known": pa.array([None] * rows + [int((sums > 0).sum())], pa.int64()),
    })


_PIECE = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("text", pa.binary())])


def _packed_rows(ids: list, held: list, texts: list) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids, held, texts), _PIECE, strict=True)], schema=_PIECE)
    with pa.ipc.new_stream(sink, _PIECE, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _pieces(unit_bytes: int, piece_bytes: int):
    """The rows of each unit, compressed."""

    def run(batches):
        for unit, ids, held, texts in _units(batches, unit_bytes):
            first, size = 0, 0
            for k, t in enumerate(texts, 1):
                size += len(t or b"")
                if size >= piece_bytes or k == len(texts):
                    raw = _packed_rows(ids[first:k], held[first:k], texts[first:k])
                    yield pa.RecordBatch.from_arrays([pa.array([unit], pa.int64()), pa.array([raw], pa.binary())], ["unit", "piece"])
                    first, size = k, 0

    return run


class Automaton:
    """The part of the automaton that a unit needs: the weights of its n-grams' arcs, and of the failure arcs that its
    texts take. counts: of its n-grams in all training documents, by order."""

    def __init__(self, counts: list[np.ndarray], starts: int, total: int, known: int):
        self.counts, self.starts = counts, starts
        self.root = (counts[0] + 0.5) / (total + 0.5 * (known + 1))

    def walk(self, places: list[np.ndarray], offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the root's arc of each token, and of the arcs and failure arcs from the state before it."""
        weight = self.root[places[0]]
        base = np.log10(weight)
        for order, strength in zip(range(1, len(places)), STRENGTH, strict=False):
            history = previous(self.counts[order - 1][places[order - 1]], offsets, self.starts)
            seen = self.counts[order][places[order]]
            # With an arc its weight; without one (seen = 0) the failure arc's times that of the shorter history.
            weight = (seen + strength * weight) / (history + strength)
        return base, np.log10(weight)


_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, held_out: Column, longest: int = ORDER, unit_bytes: int = UNIT_BYTES, piece_bytes: int = PIECE_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Scores of all rows (doc_id, text) under the model of those that aren't held out, of n-grams up to `longest`."""
    docs = text_rows(docs, F.coalesce(held_out, F.lit(False)).alias("held_out"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))

    asked = docs.mapInArrow(_questions(longest, unit_bytes, buckets), "ord int, bucket long, unit long, names binary, counts binary")
    answers = asked.groupBy("ord", "bucket").applyInArrow(_answer, _ANSWERS)
    answers = stored(answers.coalesce(max(1, -(-size // FILE_BYTES))), "counts")
    total, known = (int(x or 0) for x in answers.where("unit is null and ord = 1").agg(F.sum("total"), F.sum("known")).first())

    def run(pieces: pa.Table, answers: pa.Table) -> pa.Table:
        rows = pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in pieces["piece"].to_pylist()])
        texts = rows["text"].to_pylist()
        found, offsets = grams(texts, longest)
        given = {(o, b): c for o, b, c in zip(*(answers[x].to_pylist() for x in ("ord", "bucket", "counts")))}
        counts = []
        for order, (names, _) in enumerate(found, 1):
            cuts = ranges(names, buckets)
            blobs = [given.pop((order, b), b"") for b, _, _ in cuts]
            if any(len(x) not in (n, 2 * n, 4 * n, 8 * n) for x, n in zip(blobs, (z - a for _, a, z in cuts))):
                raise ValueError("the rows of a unit changed between two reads of the table")
            counts.append(np.concatenate([unpacked_counts(x, z - a) for x, (_, a, z) in zip(blobs, cuts)]))
        starts = int(counts[0][np.searchsorted(found[0][0], END)])
        places = [at for _, at in found]
        base, tokens = Automaton(counts, starts, total, known).walk(places, offsets)
        at = offsets[:-1]
        return pa.table({
            "doc_id": rows["doc_id"], "held_out": rows["held_out"], "n_tokens": pa.array(np.diff(offsets)),
            "n_known": pa.array(np.add.reduceat((counts[0] > 0).astype(np.int64)[places[0]], at)), "train_tokens": pa.array(np.full(len(texts), total), pa.int64()),
            "base_score": pa.array(np.add.reduceat(base, at)), "score": pa.array(np.add.reduceat(tokens, at)),
        })

    pieces = docs.mapInArrow(_pieces(unit_bytes, piece_bytes), "unit long, piece binary")
    kept = answers.where("unit is not null").select("unit", "ord", "bucket", "counts")
    return pieces.groupBy("unit").cogroup(kept.groupBy("unit")).applyInArrow(run, _OUT)
