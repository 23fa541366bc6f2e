import math
import zlib
from collections import Counter

import numpy as np
import pytest
from edgeloom.llm import lm
from edgeloom.llm.queries import QUERIES
from edgeloom.llm.lm import score
from pyspark.sql import functions as F


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def brute(rows, held, longest=lm.ORDER):
    """Base and score of each row, from the definitions."""
    counts, follow = Counter(), Counter()
    for i, t in rows:
        if not held(i):
            w = [None] * (longest - 1) + tokens(t)
            for k in range(longest - 1, len(w)):
                for n in range(longest):
                    counts[tuple(w[k - n : k + 1])] += 1
                    follow[tuple(w[k - n : k])] += 1
    uni = {g[0]: c for g, c in counts.items() if len(g) == 1}
    n, v = sum(uni.values()), len(uni)
    unit = n + 0.5 * (v + 1)

    def p(history, w):
        if not history:
            return (uni.get(w, 0) + 0.5) / unit
        strength = lm.STRENGTH[len(history) - 1]
        return (counts[(*history, w)] + strength * p(history[1:], w)) / (follow[history] + strength)

    for history in list(follow)[:20]:  # a state's weights sum to 1
        if history:
            assert math.isclose(sum(p(history, w) for w in uni) + p(history, object()), 1, rel_tol=1e-9)
    out = []
    for i, t in rows:
        own = tokens(t)
        padded = [None] * (longest - 1) + own
        total = sum(math.log10(p(tuple(padded[k : k + longest - 1]), w)) for k, w in enumerate(own))
        out.append((i, held(i), len(own), sum(w in uni for w in own), n, sum(math.log10(p((), w)) for w in own), total))
    return out


def compare(out, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got = sorted(map(tuple, out.collect()), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_scores_against_the_definitions(docs):
    rows = [(i, " ".join(f"W{(i * j * j + j) % (3 + i % 17)}" for j in range(i % 40)) + (" The end" if i % 3 else "")) for i in range(120)]
    held = lambda i: i % 5 == 1
    for longest, unit, piece, bucket in ((3, 12 << 20, 2 << 20, 4 << 20), (3, 900, 200, 300), (2, 900, 2000, 90)):
        compare(score(docs(rows), F.col("doc_id") % 5 == 1, longest, unit, piece, bucket), brute(rows, held, longest))


def test_blobs_keep_names_and_counts():
    rng = np.random.default_rng(3)
    names = np.unique(rng.integers(0, 1 << 64, 1000, dtype=np.uint64, endpoint=False))
    assert (lm.unpacked_names(lm.packed_names(names)) == names).all()
    cuts = lm.ranges(names, 7)
    assert [b for b, _, _ in cuts] == list(range(7)) and [a for _, a, _ in cuts[1:]] == [z for _, _, z in cuts[:-1]] and cuts[-1][2] == len(names)
    for top in (1, 300, 70_000, 1 << 40):
        counts = rng.integers(0, top + 1, 50)
        assert (lm.unpacked_counts(lm.packed_counts(counts), 50) == counts).all()


def test_a_table_that_changes_between_reads_is_an_error(spark, docs, tmp_path):
    path = f"{tmp_path}/changing"
    docs([(i, f"some words {i}") for i in range(9)]).write.parquet(path)
    out = score(spark.read.parquet(path), F.lit(False))
    spark.range(9).selectExpr("id as doc_id", "concat('other texts here ', id, ' ', id) as text").coalesce(1).write.mode("overwrite").parquet(path)
    with pytest.raises(Exception):  # noqa: B017
        out.collect()


def test_awkward_rows(docs, awkward):
    compare(score(docs(awkward), F.col("doc_id") == 7), brute(awkward, lambda i: i == 7))
    assert score(docs([]), F.lit(False)).collect() == []
    only = score(docs([(1, "a b"), (2, None)]), F.lit(True)).collect()
    assert [(r.n_known, r.train_tokens, r.base_score) for r in sorted(only)] == [(0, 0, 0.0), (0, 0, 0.0)]


def test_the_query_on_its_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    out = QUERIES["op10_lm_scoring"](spark, sf_dir)
    compare(out, brute(rows, held))
    mean = out.where("held_out").agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
    assert mean[0] > mean[1] + 0.2


def test_every_ngram_of_the_order_is_in_the_model(docs):
    """Many tokens of one word, beside a rare text that occurs once: its copy is held out and told from a stranger."""
    rows = [(i, "x " * 3000) for i in range(20)] + [(100, "a rare couple of words"), (101, "a rare couple of words"), (102, "words of rare couple a")]
    compare(score(docs(rows), F.col("doc_id") > 100), brute(rows, lambda i: i > 100))
    got = {r.doc_id: r for r in score(docs(rows), F.col("doc_id") > 100).collect()}
    assert got[101].base_score == pytest.approx(got[102].base_score) and got[101].score > got[102].score + 3


def test_null_ids_are_not_held_out(docs):
    got = score(docs([(None, "a b"), (None, "a b"), (1, "a c")]), F.col("doc_id") == 1).collect()
    assert sorted((r.doc_id or 0, r.held_out, r.train_tokens) for r in got) == [(0, False, 6), (0, False, 6), (1, True, 6)]
