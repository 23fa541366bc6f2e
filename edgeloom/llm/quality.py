"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a few surface features, each cut into bins. Cyclic boosting goes round the features and adds a
shallow tree on one feature's bins at a time to its lookup table; then it does the same on a few pairs of features,
chosen by the gain of the first cut. A score is the intercept plus one table entry for each feature and pair.

The model is fitted on a bounded sample of labelled rows (SAMPLE, expected); features are computed on the executors.
A doc_id with several labels counts as the mean, at least 0.5 being 1; null labels are left out. With no labelled
rows, or one class only, all texts get the (smoothed) share of class 1. A null text has the features of an empty one.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_slices, column, packed, text_rows, texts_of

SAMPLE = 20_000
BINS = 32
PAIRS = 6
ROUNDS, PAIR_ROUNDS, RATE = 60, 25, 0.2

FEATURES = (
    "log_bytes", "upper", "digit", "symbol", "pipe", "exclaim", "stop", "space", "newline", "non_ascii",
    "word_length", "log_words", "distinct_words", "short_words", "odd_ends", "upper_words", "repeated_lines", "packed",
)

_CLASS = np.zeros(256, np.uint8)
for _k, _bytes in enumerate((range(65, 91), range(97, 123), range(48, 58), b" \t\v\f\r", b"\n", b".,", b"|", b"!", range(128, 256)), 1):
    _CLASS[list(_bytes)] = _k
_ODD = frozenset(b"!#$%&*+/<=>@\\^_`{|}~")


def text_features(text: bytes) -> tuple:
    """Features that need words or lines."""
    words = text.split()
    n = len(words)
    lines = [x for x in text.split(b"\n") if x]
    if not n:
        return (0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)
    odd = sum(w[-1] in _ODD for w in words)
    upper = sum(map(bytes.isupper, words))
    short = sum(len(w) < 4 for w in words)
    repeated = 1 - len(set(lines)) / len(lines)
    size = sum(map(len, words))
    return (size / n, np.log1p(n), len(set(words)) / n, short / n, odd / n, upper / n, repeated, len(zlib.compress(text, 1)) / len(text))


def features(batch: pa.RecordBatch) -> np.ndarray:
    """(rows, FEATURES) of whole texts."""
    out = np.zeros((batch.num_rows, len(FEATURES)))
    for first, data, offsets in byte_slices(batch):
        kinds = _CLASS[data]
        length = np.diff(offsets)
        full = np.flatnonzero(length)
        counts = np.zeros((len(length), 10))
        if len(full):
            owner = np.repeat(np.arange(len(length), dtype=np.int32), length)
            counts = np.bincount(owner * 10 + kinds, minlength=len(length) * 10).reshape(-1, 10)
        at, size = slice(first, first + len(length)), np.maximum(length, 1)
        other, upper, lower, digit, space, newline, stop, pipe, exclaim, high = counts.T
        shares = (upper / np.maximum(upper + lower, 1), digit / size, other / size, pipe / size, exclaim / size, stop / size, space / size, newline / size, high / size)
        out[at, :10] = np.stack([np.log1p(length), *shares], 1)
    out[:, 10:] = [text_features(t or b"") for t in texts_of(batch)] or np.zeros((0, 8))
    return out


def _best_split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a run of bins."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - g.sum() ** 2 / (h.sum() + 1)
    k = int(np.argmax(gain)) if len(gain) else 0
    return (float(gain[k]), k + 1) if len(gain) and gain[k] > 1e-9 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Leaf values of a shallow tree on a run of bins, by bin."""
    gain, at = _best_split(g, h) if depth else (0.0, 0)
    if not gain:
        return np.full(len(g), g.sum() / (h.sum() + 1))
    return np.concatenate([_tree(g[:at], h[:at], depth - 1), _tree(g[at:], h[at:], depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of a tree that cuts one feature of a pair and then, on each side, the other."""
    best = (0.0, np.zeros(g.shape))
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        ca, cb = np.cumsum(a, 0), np.cumsum(b, 0)
        for at in range(1, len(a), 2):
            value, gain = np.empty(a.shape), -(a.sum() ** 2) / (b.sum() + 1)
            for rows, x, y in ((slice(None, at), ca[at - 1], cb[at - 1]), (slice(at, None), ca[-1] - ca[at - 1], cb[-1] - cb[at - 1])):
                leaf = _tree(x, y, 1)
                value[rows] = leaf
                gain += float((leaf * x).sum())
            if gain > best[0]:
                best = (gain, (value.T if flip else value).copy())
    return best


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """Edges of the bins, intercept, a table for each feature and for each chosen pair."""
    n, width = len(y), len(FEATURES)
    share = (y.sum() + 0.5) / (n + 1)
    model = {"edges": [np.empty(0)] * width, "base": float(np.log(share / (1 - share))), "tables": [np.zeros(1)] * width, "pairs": []}
    if not 0 < y.sum() < n:
        return model
    model["edges"] = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    bins = binned(x, model)
    sizes = [len(e) + 1 for e in model["edges"]]
    model["tables"] = [np.zeros(s) for s in sizes]
    f = np.full(n, model["base"])

    def gradient():
        p = 1 / (1 + np.exp(-f))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for j in range(width):
            g, h = gradient()
            step = RATE * _tree(np.bincount(bins[:, j], g, sizes[j]), np.bincount(bins[:, j], h, sizes[j]), 2)
            model["tables"][j] += step
            f += step[bins[:, j]]

    def grid(a, b, g, h):
        cell = bins[:, a] * sizes[b] + bins[:, b]
        shape = (sizes[a], sizes[b])
        return cell, np.bincount(cell, g, sizes[a] * sizes[b]).reshape(shape), np.bincount(cell, h, sizes[a] * sizes[b]).reshape(shape)

    g, h = gradient()
    gains = sorted(((_pair_tree(*grid(a, b, g, h)[1:])[0], a, b) for a in range(width) for b in range(a) if sizes[a] > 1 and sizes[b] > 1), reverse=True)
    model["pairs"] = [(a, b, np.zeros((sizes[a], sizes[b]))) for gain, a, b in gains[:PAIRS] if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for a, b, table in model["pairs"]:
            cell, gg, hh = grid(a, b, *gradient())
            step = RATE * _pair_tree(gg, hh)[1]
            table += step
            f += step.ravel()[cell]
    return model


def binned(x: np.ndarray, model: dict) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model["edges"])], 1)


def probability(x: np.ndarray, model: dict) -> np.ndarray:
    bins = binned(x, model)
    f = np.full(len(x), model["base"])
    for j, table in enumerate(model["tables"]):
        f += table[bins[:, j]]
    for a, b, table in model["pairs"]:
        f += table[bins[:, a], bins[:, b]]
    return 1 / (1 + np.exp(-f))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Fits on documents (doc_id, text) that have a label (doc_id, quality)."""
    labels = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long"), "quality")
    share = int(min(1.0, sample / max(1, labels.count())) * 1_000_000)
    labels = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1_000_000)) < share)
    labels = labels.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    names = ", ".join(f"{x} double" for x in ("y", *FEATURES))

    def run(batches):
        for batch in batches:
            x = features(batch)
            yield pa.RecordBatch.from_arrays([column(batch, "y"), *(pa.array(c) for c in x.T.copy())], ["y", *FEATURES])

    # At most `sample` labels are expected here, whatever the size of the corpus.
    rows = text_rows(docs).join(F.broadcast(labels), "doc_id").select("y", "text")
    table = rows.mapInArrow(run, names).toArrow()
    x = np.stack([table[c].to_numpy() for c in FEATURES], 1)
    y = table["y"].to_numpy()
    order = np.lexsort([*x.T, y])  # the fit doesn't depend on the order in which the rows come
    return fit(x[order], y[order])


def scored(docs: DataFrame, model: dict, *keep: str) -> DataFrame:
    """The columns `keep` (other than `text` and `score`) and the score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = (text_rows(docs) if keep == ("doc_id",) else docs).select(*keep, "text")
    schema = T.StructType([*own.schema[: len(keep)], T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            score = probability(features(batch), shared.value)
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in keep), pa.array(score)], [*keep, "score"])

    return own.mapInArrow(run, schema)


def accepted(docs: DataFrame, model: dict, least: float = 0.5) -> DataFrame:
    """The rows with a score of at least `least`."""
    return scored(packed(docs), model, "row").where(F.col("score") >= least).select("row.*")
