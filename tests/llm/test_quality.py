import math

import numpy as np
import pyarrow as pa
from edgeloom.llm.quality import FEATURES, accepted, binned, features, fit, learn, probability, scored


def make(spark):
    good = [(i, f"Plain words number {i} are here. And more of them follow.", 1) for i in range(60)]
    bad = [(100 + i, f"WORDS!! ARE!! LOUD!! {i}!! " * 4, 0) for i in range(30)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in good + bad] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_scores_are_sums_of_table_entries(spark):
    docs, labels = make(spark)
    model = learn(docs, labels)
    x = features(pa.RecordBatch.from_pydict({"text": ["Plain words. Here", "LOUD!! LOUD!!", "", None]}))
    assert x.shape == (4, len(FEATURES))
    bins = binned(x, model)
    for row, p in zip(bins, probability(x, model), strict=True):
        f = model["base"] + sum(t[b] for t, b in zip(model["tables"], row, strict=True)) + sum(t[row[a], row[b]] for a, b, t in model["pairs"])
        assert np.isclose(p, 1 / (1 + np.exp(-f)))
    p = probability(x, model)
    assert p[0] > 0.5 > p[1] and 0 <= p[2] == p[3] <= 1


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(0)
    x = np.zeros((4000, len(FEATURES)))
    x[:, 0], x[:, 3] = rng.random(4000), rng.random(4000)
    y = ((x[:, 0] > 0.5) != (x[:, 3] > 0.5)).astype(float)
    model = fit(x, y)
    assert ((probability(x, model) >= 0.5) == (y == 1)).mean() > 0.95


def test_the_filter_keeps_clean_rows_and_all_columns(spark):
    docs, labels = make(spark)
    docs = docs.selectExpr("doc_id", "text", "doc_id as score", "text as row", "doc_id as _text")
    kept = accepted(docs, learn(docs, labels))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(60))


def test_one_class_no_labels_and_awkward_rows(spark, docs, awkward):
    docs_, labels = make(spark)
    for some in (labels.where("quality = 1"), labels.where("false")):
        model = learn(docs_, some)
        assert 0 < scored(docs_, model, "doc_id").first().score < 1
    model = learn(docs_, labels)
    out = scored(docs(awkward), model, "doc_id").collect()
    assert len(out) == len(awkward) and all(0 <= r.score <= 1 for r in out)
    assert scored(docs([]), model, "doc_id").collect() == []


def by_hand(x, y, edges, rounds, rate):
    """The tables of single features, cut by cut and bin by bin."""
    bins = [[int(sum(v >= e for e in edges[j])) for v in x[:, j]] for j in range(x.shape[1])]
    share = (sum(y) + 0.5) / (len(y) + 1)
    f, tables = [math.log(share / (1 - share))] * len(y), [[0.0] * (len(e) + 1) for e in edges]

    def leaves(g, h, depth):
        gains = []
        for at in range(1, len(g)) if depth else ():
            gains.append((sum(g[:at]) ** 2 / (sum(h[:at]) + 1) + sum(g[at:]) ** 2 / (sum(h[at:]) + 1) - sum(g) ** 2 / (sum(h) + 1), -at))
        if not gains or max(gains)[0] <= 1e-9:
            return [sum(g) / (sum(h) + 1)] * len(g)
        at = -max(gains)[1]
        return leaves(g[:at], h[:at], depth - 1) + leaves(g[at:], h[at:], depth - 1)

    for _ in range(rounds):
        for j, own in enumerate(bins):
            g, h = [0.0] * len(tables[j]), [0.0] * len(tables[j])
            for b, target, z in zip(own, y, f, strict=True):
                p = 1 / (1 + math.exp(-z))
                g[b] += target - p
                h[b] += max(p * (1 - p), 1e-6)
            for b, step in enumerate(leaves(g, h, 2)):
                tables[j][b] += rate * step
            f = [z + rate * s for z, s in zip(f, [leaves(g, h, 2)[b] for b in own], strict=True)]
    return tables


def test_tables_against_a_fit_by_hand():
    from edgeloom.llm.quality import RATE, ROUNDS

    rng = np.random.default_rng(2)
    x = np.zeros((40, len(FEATURES)))
    x[:, 1], x[:, 4], x[:, 7] = rng.random(40).round(1), rng.normal(size=40).round(1), rng.integers(0, 3, 40)
    y = ((x[:, 1] + 0.3 * x[:, 4] + 0.2 * rng.normal(size=40)) > 0.5).astype(float)
    model = fit(x, y)
    for j, (table, want) in enumerate(zip(model["tables"], by_hand(x, y, model["edges"], ROUNDS, RATE), strict=True)):
        assert np.allclose(table, want, atol=1e-6), FEATURES[j]


def test_held_out_rows_are_told_apart_and_not_learnt_from(spark, tmp_path):
    from edgeloom.llm.common import id_bucket
    from edgeloom.llm.queries import QUERIES
    from pyspark.sql import functions as F

    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = QUERIES["op5_quality"](spark, sf_dir)
    held = out.where("held_out").join(labels.where("quality is not null"), "doc_id").select("quality", "score", "predicted").collect()
    good, bad = [r.score for r in held if r.quality == 1], [r.score for r in held if r.quality == 0]
    assert len(good) > 50 and len(bad) > 5
    assert sum(a > b for a in good for b in bad) >= 0.98 * len(good) * len(bad)
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)
    # Other labels of held-out rows, and a row without an id, change no score.
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))).write.parquet(f"{tmp_path}/documents.parquet")
    turned = labels.withColumn("quality", F.when(id_bucket(3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    turned.write.parquet(f"{tmp_path}/labels.parquet")
    again = {r.doc_id: (r.score, r.held_out) for r in QUERIES["op5_quality"](spark, str(tmp_path)).collect()}
    assert again.pop(None)[1] is False
    assert {i: s for i, (s, _) in again.items()} == {r.doc_id: r.score for r in out.collect()}
