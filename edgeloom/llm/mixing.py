"""Soft-membership mixing of sources to target weights.

A classifier learnt from labelled rows (naive Bayes over pairs of bytes, its confidence scaled to fit) gives each
document a posterior over domains. Nonnegative rates r are fitted by projected gradient steps so that the expected tokens
of each domain, sum of r * tokens * posterior, meet the targets: least squares of the relative gaps, from r = 1. A step
scales the gradient by the domains' Gram matrix over the documents that can still move (two-metric projection: Bertsekas,
1982), so that the sizes of the domains don't matter, and r is cut at 0. It ends where no step helps
(Karush-Kuhn-Tucker); targets that no rates meet are missed by the least squared relative gaps, with a warning, and a
search that doesn't end in STEPS steps says so. A step is a pair of vectors over domains, so it applies to every document
on its own; each one takes two distributed sums over the documents. A document is repeated floor(rate + u) times, u a uniform hash of the row.

The classifier is fitted on a bounded sample of labelled rows (PER_DOMAIN expected for each domain), counted on the
executors. Without labelled rows there are no domains, and every rate is 1.

Nulls: a null text has no tokens and the posterior of the prior; a null label isn't learnt from. Repeated rows with
different ids are drawn on their own; equal rows (id and text) are drawn alike. An empty table gives no rows.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_slices, column, packed, stored, sums, text_rows, texts_of

PER_DOMAIN = 400
#: The search ends by itself after a few steps if targets can be met; STEPS guards against one that doesn't.
STEPS, TOLERANCE = 60, 1e-4
#: What keeps the scaling of a step finite, as a share of its own.
SOFT = 1e-11
#: What is tried in each step: rates near 0 that only take an unscaled step, parts of the scaled step, and multiples of an
#: unscaled one.
NEAR, PARTS, MULTIPLES = (0.0, 1e-3, 0.03, 0.3), (1.0, 0.5, 0.1, 0.01), (1.0, 10.0, 100.0, 1000.0)


def _pairs(data: np.ndarray) -> np.ndarray:
    return data[:-1].astype(np.int32) << 8 | data[1:]


def learn(labelled: DataFrame, domain: str, per_domain: int = PER_DOMAIN) -> dict:
    """Log probabilities of byte pairs by domain, the prior and the scale of the logits."""
    labelled = text_rows(labelled.where(F.col(domain).isNotNull()), F.col(domain).cast("string").alias("domain"))
    sizes = {r["domain"]: r["count"] for r in labelled.groupBy("domain").count().collect()}
    names = sorted(sizes)
    share = F.lit(0)
    for x in names:
        share = F.when(F.col("domain") == x, int(min(1.0, per_domain / sizes[x]) * 1_000_000)).otherwise(share)
    sample = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(41)), F.lit(1_000_000)) < share)
    number = {x: i for i, x in enumerate(names)}

    def count(batches):
        total = np.zeros((len(names), 65536), np.int64)
        for batch in batches:
            who = [number[x] for x in column(batch, "domain").to_pylist()]
            for w, t in zip(who, texts_of(batch), strict=True):
                if t and len(t) > 1:
                    total[w] += np.bincount(_pairs(np.frombuffer(t, np.uint8)), minlength=65536)
        if total.any():
            d, p = np.nonzero(total)
            yield pa.RecordBatch.from_pydict({"d": pa.array(d, pa.int64()), "p": pa.array(p, pa.int64()), "n": pa.array(total[d, p])})

    rows = sample.mapInArrow(count, "d long, p long, n long").groupBy("d", "p").agg(F.sum("n").alias("n")).toArrow()  # 65,536 a domain at most
    counts = np.full((len(names), 65536), 0.1)
    counts[rows["d"].to_numpy(), rows["p"].to_numpy()] += rows["n"].to_numpy()
    logs = np.log(counts / counts.sum(1, keepdims=True)) if names else counts
    prior = np.array([sizes[x] for x in names], float)
    model = {"names": names, "logs": logs.astype(np.float32), "prior": np.log(prior / prior.sum()) if names else prior, "scale": 1.0}
    if len(names) > 1:
        model["scale"] = _scale(sample, model, number)
    return model


SCALES = (0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0)


def _scale(sample: DataFrame, model: dict, number: dict[str, int]) -> float:
    """The scale with the best log likelihood on the sample."""

    def run(batches):
        for batch in batches:
            who = np.array([number[x] for x in column(batch, "domain").to_pylist()], int)
            logit, _ = logits(batch, model)
            loss = []
            for s in SCALES:
                z = model["prior"] + s * logit
                z -= z.max(1, keepdims=True)
                loss.append(float((np.log(np.exp(z).sum(1)) - z[np.arange(len(who)), who]).sum()))
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in loss], [f"s{i}" for i in range(len(SCALES))])

    cols = [f"s{i}" for i in range(len(SCALES))]
    loss = sample.mapInArrow(run, ", ".join(f"{c} double" for c in cols)).agg(*(F.sum(c) for c in cols)).first()
    best = min(range(len(SCALES)), key=lambda i: (round(loss[i] or 0.0, 6), i))
    return SCALES[best]


def logits(batch: pa.RecordBatch, model: dict, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Sums of log probabilities by domain, and tokens (runs of bytes other than white space), of each text."""
    out, tokens = np.zeros((batch.num_rows, len(model["names"]))), np.zeros(batch.num_rows, np.int64)
    white = np.zeros(256, bool)
    white[[32, *range(9, 14)]] = True
    for first, data, offsets in byte_slices(batch, name):
        if not len(data):
            continue
        inside = ~white[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        starts = offsets[:-1][np.diff(offsets) > 0]
        begins[starts] = inside[starts]
        at = slice(first, first + len(offsets) - 1)
        tokens[at] = sums(begins.astype(np.float64), offsets).astype(np.int64)
        if len(data) > 1 and model["names"]:
            pairs = _pairs(data)
            ends = np.minimum(np.maximum(offsets[1:] - 1, offsets[:-1]), len(pairs))
            begin = np.minimum(offsets[:-1], len(pairs))
            for d in range(out.shape[1]):
                run = np.concatenate([[0], np.cumsum(model["logs"][d][pairs], dtype=np.float64)])
                out[at, d] = run[ends] - run[begin]
    return out, tokens


def posteriors(docs: DataFrame, model: dict, *keep: str) -> DataFrame:
    """The columns `keep`, tokens and the posterior (array<double>, in the order of the domains)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(*keep, "text")
    schema = T.StructType([*own.schema[: len(keep)], T.StructField("tokens", T.LongType()), T.StructField("posterior", T.ArrayType(T.DoubleType()))])

    def run(batches):
        model = shared.value
        for batch in batches:
            logit, tokens = logits(batch, model)
            p = logit
            if logit.size:
                z = model["prior"] + model["scale"] * logit
                p = np.exp(z - z.max(1, keepdims=True))
                p = p / p.sum(1, keepdims=True)
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in keep), pa.array(tokens), pa.array(p.tolist(), pa.list_(pa.float64()))], [*keep, "tokens", "posterior"])

    return own.mapInArrow(run, schema)


#: How a step changes a rate: by a scaled vector, or an unscaled one where the rate is near 0 and to be lowered; and how near.
Step = tuple[list[float], list[float], float]


def fit(soft: DataFrame, targets: list[float]) -> tuple[list[Step], list[float], bool]:
    """Steps to the rates, the domain totals that they lead to, and whether no step helps any more.

    soft: (tokens, posterior) of each document. With gaps g = (total - target) / target, the gradient of |g|^2 / 2 by the
    rate of a document is tokens * (q . g), q its posterior / targets. An unscaled step lowers the rate by a multiple of
    q . g, a scaled one by q . v, where v = M^-1 g and M = sum of tokens * q q' over the documents that it moves.
    """
    n, size = len(targets), np.maximum(targets, 1.0)
    share = [F.col("posterior")[d] for d in range(n)]

    def sums_of(steps: list[Step], columns: list[Column]) -> np.ndarray:
        found = soft.withColumn("rate", rates(steps)).agg(*columns).first()
        return np.array([x or 0.0 for x in found])

    steps: list[Step] = []
    totals = sums_of(steps, [F.sum(F.col("tokens") * p) for p in share])
    gram = sums_of(steps, [F.sum(F.col("tokens") * p * q) for p in share for q in share]).reshape(n, n) / np.outer(size, size)
    pace = 1 / max(float(np.linalg.eigvalsh(gram)[-1]), 1e-300)
    for _ in range(STEPS):
        gap = (totals - targets) / size
        if np.abs(gap).max() < 1e-9:
            return steps, totals.tolist(), True
        plain = pace * gap / size
        moving = [F.when((F.col("rate") > x) | (_dot(plain.tolist()) < 0), F.col("tokens")).otherwise(0.0) for x in NEAR]

        def scaled(some: list[Column]) -> list[np.ndarray]:
            grams = sums_of(steps, [F.sum(m * p * q) for m in some for p in share for q in share]).reshape(len(some), n, n) / np.outer(size, size)
            roots = [np.sqrt(np.where(np.diag(m) > 0, np.diag(m), 1.0)) for m in grams]
            return [np.linalg.solve(m / np.outer(r, r) + SOFT * np.eye(n), gap / r) / r / size for m, r in zip(grams, roots, strict=True)]

        def outcome(tried: list[Step]) -> tuple[np.ndarray, np.ndarray]:
            found = sums_of(steps, [F.sum(_moved(F.col("rate"), x) * F.col("tokens") * p) for x in tried for p in share]).reshape(len(tried), n)
            return found, (((found - targets) / size) ** 2).sum(1)

        tried: list[Step] = [(scaled(moving[:1])[0].tolist(), plain.tolist(), NEAR[0])]
        found, loss = outcome(tried)
        if not loss[0] < (gap**2).sum() / 4:  # the whole scaled step isn't good enough: try others beside it
            tried = [((x * plain).tolist(), (x * plain).tolist(), 0.0) for x in MULTIPLES]
            tried += [((x * v).tolist(), plain.tolist(), near) for near, v in zip(NEAR, scaled(moving), strict=True) for x in PARTS]
            found, loss = outcome(tried)
        best = int(np.argmin(loss))
        if not loss[best] < (gap**2).sum() * (1 - 1e-9):
            return steps, totals.tolist(), True
        steps, totals = [*steps, tried[best]], found[best]
    return steps, totals.tolist(), False


def _dot(vector: list[float]) -> Column:
    return sum((F.col("posterior")[d] * x for d, x in enumerate(vector)), F.lit(0.0))


def _moved(rate: Column, step: Step) -> Column:
    scaled, plain, near = step
    return F.greatest(F.lit(0.0), rate - F.when((rate > near) | (_dot(plain) < 0), _dot(scaled)).otherwise(_dot(plain)))


def rates(steps: list[Step]) -> Column:
    """The rate of a document, from its posterior, after the steps."""
    if not steps:
        return F.lit(1.0)
    dot = lambda vector: F.aggregate(F.zip_with("posterior", vector, lambda p, v: p * v), F.lit(0.0), lambda a, x: a + x)
    path = F.array(*(F.struct(F.array(*map(F.lit, v)).alias("v"), F.array(*map(F.lit, u)).alias("u"), F.lit(near).alias("near")) for v, u, near in steps))
    moved = lambda r, s: F.greatest(F.lit(0.0), r - F.when((r > s["near"]) | (dot(s["u"]) < 0), dot(s["v"])).otherwise(dot(s["u"])))
    return F.aggregate(path, F.lit(1.0), moved)


def default_weights(totals: list[float], power: float = 0.7) -> list[float]:
    """Weights proportional to a power of the domains' sizes: smaller domains gain."""
    raw = [max(t, 0.0) ** power for t in totals]
    return [x / (sum(raw) or 1.0) for x in raw]


def rated(docs: DataFrame, labelled: DataFrame, domain: str, weights: dict[str, float] | None, total: float | None, keep_all: bool, *keep: str) -> tuple[list[str], DataFrame]:
    """The domains, and the columns `keep` with tokens, posterior, rate and copies. weights: target shares by domain (default:
    sizes to the power 0.7); total: expected tokens (default: those of docs; with keep_all so many that the domain that
    is to shrink most keeps its size, and no document is dropped)."""
    model = learn(labelled, domain)
    names = model["names"]
    docs = docs.withColumn("draw", F.pmod(F.xxhash64("doc_id", "text", F.lit(53)), F.lit(1 << 30)) / float(1 << 30))
    found = posteriors(docs, model, *keep, "draw")  # computed twice rather than stored: it may hold whole rows
    if not names:
        return names, found.withColumns({"rate": F.lit(1.0), "copies": F.lit(1)}).drop("draw")
    soft = stored(posteriors(docs, model), "soft")
    now = [x or 0.0 for x in soft.agg(*(F.sum(F.col("tokens") * F.col("posterior")[d]) for d in range(len(names)))).first()]
    shares = [weights.get(x, 0.0) for x in names] if weights else default_weights(now)
    scale = (sum(now) if total is None else total) / (sum(shares) or 1.0)
    if keep_all:
        scale = max([scale, *(n / s for n, s in zip(now, shares, strict=True) if s > 0)])
    targets = [s * scale for s in shares]
    steps, totals, ended = fit(soft, targets)
    unmet = [f"{x}: {a:.6g} of {t:.6g}" for x, a, t in zip(names, totals, targets, strict=True) if abs(a - t) >= TOLERANCE * max(t, 1.0)]
    if unmet:
        why = "no rates give these domains their target tokens" if ended else f"after {STEPS} steps these domains don't have their target tokens"
        warnings.warn(f"{why}: {', '.join(unmet)}", stacklevel=3)
    out = found.withColumn("rate", F.greatest(rates(steps), F.lit(1.0)) if keep_all else rates(steps))
    return names, out.withColumn("copies", F.floor(F.col("rate") + F.col("draw")).cast("int")).drop("draw")


def mix(docs: DataFrame, domain: str = "lang", weights: dict[str, float] | None = None, total: float | None = None) -> DataFrame:
    """doc_id, tokens, p_<domain> for each domain, rate and copies of each row."""
    names, out = rated(packed(docs), docs, domain, weights, total, False, "doc_id")
    shares = [F.col("posterior")[d].alias(f"p_{x}") for d, x in enumerate(names)]
    return out.select("doc_id", "tokens", *shares, "rate", "copies")


def mixture(docs: DataFrame, domain: str = "lang", weights: dict[str, float] | None = None, total: float | None = None, keep_all: bool = False) -> DataFrame:
    """The rows of docs, each as often as `copies` says."""
    _, out = rated(packed(docs), docs, domain, weights, total, keep_all, "row")
    return out.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
