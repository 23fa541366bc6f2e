"""Language identification by prediction by partial matching (PPM).

Each language has a byte context tree of order 3. Its frozen counts give every byte a probability in the longest
context that the language has; a byte that the context has not seen escapes (method C, with exclusion) to the next
shorter one, and from the empty context to the uniform distribution. So each tree is a proper distribution over bytes,
and the code length of a text is the exact sum over its bytes. The shortest code wins; `score` is its posterior
probability.

The trees are learnt from a bounded sample of the labelled rows (PER_LANGUAGE of them, expected, for each language;
counted on the executors) and hold every context of the sample, as sorted arrays. Scoring is a binary search of each
byte with its context among all that any language has seen; those that none has seen go down the trees.

A text that is null or has no letter (str.isalpha) is `und` with score 0. Ties go to the first language in byte order.
Null labels are not learnt from; a row with a null doc_id is. Without any labelled row all texts are `und`. Texts are
scored whole, in slices of a few MB.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, column, has_letter, text_rows, texts_of

ORDER = 3
PER_LANGUAGE = 600
PAD = 32
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def contexts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes, A-Z lower-cased, and the three bytes before each, as an integer; texts start after spaces."""
    data = _FOLD[data]
    ctx = np.zeros(len(data), np.int32)
    starts, ends = offsets[:-1], offsets[1:]
    for k in range(1, ORDER + 1):
        before = np.full(len(data), PAD, np.int32)
        before[k:] = data[:-k] if k < len(data) else data[:0]
        for j in range(k):
            at = starts + j
            before[at[at < ends]] = PAD
        ctx |= before << (8 * (k - 1))
    return data, ctx


_COUNTS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])


def _count(batches):
    for batch in batches:
        langs = np.array(column(batch, "lang").to_pylist(), object)
        for first, data, offsets in byte_slices(batch):
            here = langs[first : first + len(offsets) - 1]
            data, ctx = contexts(data, offsets)
            gram = ctx.astype(np.int64) << 8 | data
            lengths = np.diff(offsets)
            for lang in sorted(set(here)):
                grams, n = np.unique(gram[np.repeat(here == lang, lengths)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], schema=_COUNTS)


def learn(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> dict:
    """Frozen counts from rows (doc_id, text, lang)."""
    labelled = text_rows(labelled.where("lang is not null"), F.col("lang").cast("string"))
    sizes = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    share = F.lit(0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, int(min(1.0, per_language / n) * 1_000_000)).otherwise(share)
    sample = labelled.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(17)), F.lit(1_000_000)) < share).select("text", "lang")
    grams = sample.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rows = grams.toArrow()  # no more than the sample has bytes
    langs = sorted(sizes, key=lambda x: x.encode())
    number = {x: i for i, x in enumerate(langs)}
    lang = np.array([number[x] for x in rows["lang"].to_pylist()], np.int64)
    return {"id": uuid.uuid4().hex, "langs": langs, "lang": lang, "gram": rows["gram"].to_numpy(), "n": rows["n"].to_numpy()}


def _places(values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where sorted keys have the values, and whether they have them."""
    if not len(keys):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return at, keys[at] == values


class Tree:
    """The context tree of a language, from the counts of its bytes with ORDER bytes before each."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        counts = np.bincount(gram & 255, n, 256)
        seen = counts > 0
        total, kinds = counts.sum(), seen.sum()
        escape = kinds if kinds < 256 else 0
        p = np.where(seen, counts / max(total + escape, 1), escape / max(total + escape, 1) / max(256 - kinds, 1)) if total else np.full(256, 1 / 256)
        self.root = -np.log2(p)
        self.levels = []  # for each order: bytes with their contexts, their code lengths, contexts, what an escape costs
        shorter = np.arange(256)
        for order in range(1, ORDER + 1):
            keys, at = np.unique(gram & ((1 << 8 * order + 8) - 1), return_inverse=True)
            counts = np.bincount(at, n, len(keys))
            ctx, where = np.unique(keys >> 8, return_inverse=True)
            total, kinds = np.bincount(where, counts, len(ctx)), np.bincount(where, minlength=len(ctx))
            escape = np.where(kinds < 256, kinds, 0)
            below = p[np.searchsorted(shorter, keys & ((1 << 8 * order) - 1))]  # of the same bytes in the shorter contexts
            left = np.where(escape > 0, 1 - np.bincount(where, below, len(ctx)), 1)
            p, shorter = counts / (total + escape)[where], keys
            self.levels.append((keys, -np.log2(p), ctx, -np.log2(np.maximum(escape, 1) / (total + escape) / left)))

    def code_lengths(self, gram: np.ndarray) -> np.ndarray:
        """Bits of bytes with their contexts."""
        out, spent, open_ = np.zeros(len(gram)), np.zeros(len(gram)), np.ones(len(gram), bool)
        for order in range(ORDER, 0, -1):
            keys, bits, ctx, escape = self.levels[order - 1]
            some = gram & ((1 << 8 * order + 8) - 1)
            at, hit = _places(some, keys)
            hit &= open_
            out[hit] = spent[hit] + bits[at[hit]]
            open_ &= ~hit
            at, known = _places(some >> 8, ctx)
            known &= open_
            spent[known] += escape[at[known]]
        out[open_] = spent[open_] + self.root[gram[open_] & 255]
        return out


class Trees:
    """The trees of all languages, and for each byte with its context that any of them has seen its bits in each."""

    def __init__(self, model: dict):
        self.langs = model["langs"]
        lang, gram, n = model["lang"], model["gram"], model["n"].astype(np.float64)
        self.trees = [Tree(gram[lang == k], n[lang == k]) for k in range(len(self.langs))]
        keys = np.unique(gram)
        self.bits = [t.code_lengths(keys).astype(np.float32) for t in self.trees]
        self.keys = keys.astype(np.uint32)

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text in each language."""
        data, ctx = contexts(data, offsets)
        gram = ctx.astype(np.uint32) << np.uint32(8) | data
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        full = np.flatnonzero(np.diff(offsets))
        if len(full):
            at, hit = _places(gram, self.keys)
            odd, where = np.unique(gram[~hit], return_inverse=True)
            at[~hit] = len(self.keys) + where
            for k, tree in enumerate(self.trees):
                bits = np.concatenate([self.bits[k], tree.code_lengths(odd.astype(np.int64)).astype(np.float32)])
                out[full, k] = np.add.reduceat(bits[at], offsets[:-1][full], dtype=np.float64)
        return out


_trees: dict[str, Trees] = {}


def trees_of(model: dict) -> Trees:
    if model["id"] not in _trees:
        _trees.clear()
        _trees[model["id"]] = Trees(model)
    return _trees[model["id"]]


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred and score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        trees = trees_of(shared.value) if shared.value["langs"] else None
        for batch in batches:
            known = np.array([has_letter(t) for t in texts_of(batch)], bool) & (trees is not None)
            langs, scores = np.full(len(known), "und", object), np.zeros(len(known))
            for first, data, offsets in byte_slices(batch) if known.any() else ():
                log = trees.code_lengths(data, offsets) * -np.log(2)
                best = log.argmax(1)
                top = log[np.arange(len(log)), best]
                at = slice(first, first + len(log))
                langs[at] = np.where(known[at], np.array(trees.langs, object)[best], "und")
                scores[at] = np.where(known[at], 1 / np.exp(log - top[:, None]).sum(1), 0)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(langs.tolist(), pa.string()), pa.array(scores)], schema=schema)

    return text_rows(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
