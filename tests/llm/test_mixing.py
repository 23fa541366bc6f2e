import warnings

import numpy as np
import pytest
from edgeloom.llm.mixing import fit, learn, mix, mixture, rates
from pyspark.sql import functions as F


def fitted(spark, rows, targets):
    """Rates and totals of (posterior, tokens), found by the steps of `fit`."""
    table = spark.createDataFrame([(k, [float(x) for x in p], t) for k, (p, t) in enumerate(rows)], "k int, posterior array<double>, tokens double").coalesce(1)
    steps, totals, ended = fit(table, targets)
    assert ended
    return np.array([r.rate for r in table.withColumn("rate", rates(steps)).orderBy("k").collect()]), totals


def test_rates_meet_reachable_targets(spark):
    rows = [([1.0, 0, 0], 1000.0), ([0, 1.0, 0], 500.0), ([0, 0.25, 0.75], 300.0), ([0.5, 0.5, 0], 400.0), ([1 / 3, 1 / 3, 1 / 3], 70.0)]
    targets = [900.0, 900.0, 400.0]
    found, totals = fitted(spark, rows, targets)
    assert totals == pytest.approx(targets, rel=1e-6)
    assert np.sum([np.array(p) * t * r for (p, t), r in zip(rows, found, strict=True)], 0) == pytest.approx(targets, rel=1e-6) and found.min() >= 0


def test_rates_are_cut_at_zero(spark):
    found, totals = fitted(spark, [([1.0, 0], 100.0), ([0.5, 0.5], 100.0)], [300.0, 1.0])
    assert found == pytest.approx([2.99, 0.02], rel=1e-4) and totals == pytest.approx([300, 1], rel=1e-5)
    rng = np.random.default_rng(5)
    p, tokens = rng.dirichlet([0.3] * 3, 12), rng.integers(1, 500, 12)
    goal = rng.random(12) * (rng.random(12) > 0.6) * 9  # most rates are 0, so the targets can be met
    targets = ((goal * tokens) @ p).tolist()
    found, totals = fitted(spark, [(x.tolist(), float(t)) for x, t in zip(p, tokens, strict=True)], targets)
    assert totals == pytest.approx(targets, rel=1e-4) and found.min() >= 0


def test_targets_out_of_reach_are_missed_by_least_squares(spark):
    _, totals = fitted(spark, [([0.5, 0.5], 100.0), ([0.5, 0.5], 300.0)], [300.0, 100.0])
    x = (1 / 300 + 1 / 100) / (1 / 300**2 + 1 / 100**2)  # of (x / 300 - 1)^2 + (x / 100 - 1)^2
    assert totals == pytest.approx([x, x], rel=1e-4)


def corpus(spark):
    words = {"aa": "lorem ipsum dolor ", "bb": "schtz keit ung ", "cc": "que nada cion "}
    rows = [(i, words[lang] * (3 + i % 5), lang if i % 4 else None, "s", 0) for i, lang in enumerate(["aa"] * 60 + ["bb"] * 30 + ["cc"] * 12)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tokens long")


def test_the_mixture_has_the_target_weights(spark):
    out = mix(corpus(spark), "lang", {"aa": 1, "bb": 1, "cc": 2}, total=4000)
    assert out.columns == ["doc_id", "tokens", "p_aa", "p_bb", "p_cc", "rate", "copies"]
    got = out.agg(*(F.sum(F.col("rate") * F.col("tokens") * F.col(f"p_{x}")) for x in ("aa", "bb", "cc"))).first()
    assert list(got) == pytest.approx([1000, 1000, 2000], rel=5e-3)
    assert out.where("abs(copies - rate) >= 1").count() == 0


def test_rows_are_repeated_and_kept(spark):
    table = corpus(spark)
    out = mixture(table, "lang", {"aa": 1, "bb": 1, "cc": 1}, keep_all=True)
    assert out.columns == table.columns
    copies = dict(out.groupBy("doc_id").count().collect())
    assert set(copies) == set(range(102)) and max(copies.values()) > 2


def test_awkward_rows_and_nothing_to_learn_from(spark, docs, awkward):
    plain = docs(awkward)
    assert learn(plain, "lang")["names"] == []
    assert [(r.rate, r.copies) for r in mix(plain).select("rate", "copies").distinct().collect()] == [(1.0, 1)]
    some = plain.withColumn("lang", F.when(F.col("doc_id") < 6, "aa").when(F.col("doc_id") < 10, "bb"))
    out = mix(some, "lang").collect()
    assert len(out) == len(awkward) and all(r.rate >= 0 for r in out)
    assert mixture(some.where("false")).collect() == []


def test_small_domains_meet_their_targets(spark):
    for small in (1e-2, 1e-3, 1e-6):
        _, totals = fitted(spark, [([1.0, 0], 1e9 * (1 - small)), ([0, 1.0], 1e9 * small)], [5e8, 5e8])
        assert totals == pytest.approx([5e8, 5e8], rel=1e-4)


def test_the_query_against_the_definitions(spark, sf_dir):
    """Posteriors from counts of byte pairs, and the totals that the rates lead to."""
    from edgeloom.llm.queries import QUERIES

    with warnings.catch_warnings():
        warnings.simplefilter("error")  # targets are met
        out = QUERIES["op2_mixing"](spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert len(out) == docs.count()
    model = learn(docs, "lang")
    names, t = model["names"], np.array([r.tokens for r in out], float)
    assert all(r.tokens == len(texts[r.doc_id].split()) for r in out)
    p = np.array([[r[f"p_{x}"] for x in names] for r in out])
    for r, own in zip(out[:40], p):
        logs = [model["prior"][d] + model["scale"] * sum(float(model["logs"][d][a << 8 | b]) for a, b in zip(texts[r.doc_id], texts[r.doc_id][1:])) for d in range(len(names))]
        want = np.exp(np.array(logs) - max(logs))
        assert own == pytest.approx(want / want.sum(), abs=1e-4)
    now, rate = t @ p, np.array([r.rate for r in out])
    weights = now**0.7 / (now**0.7).sum()
    assert (rate * t) @ p == pytest.approx(weights * now.sum(), rel=1e-3) and rate.min() >= 0
    assert all(r.copies in (int(r.rate), int(r.rate) + 1) for r in out)


def test_targets_that_cannot_be_met_are_reported(spark):
    rows = [(i, "lorem ipsum " * 5, "aa" if i % 2 else "bb", "s", 0) for i in range(40)]  # the same text in both domains
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tokens long")
    with pytest.warns(UserWarning, match="aa: .* of .*bb: "):
        mix(table, "lang", {"aa": 1, "bb": 9}).count()
