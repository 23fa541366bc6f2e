import corpus_pipeline
import __spark_entry__


def test_stages_take_effect_and_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    from edgeloom.llm.common import stored

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        assert docs.schema == before.schema
        counts.append(docs.count())
        if name == "quality":
            kept = {r.doc_id for r in docs.select("doc_id").collect()}
            good = [i for i, q in labels.items() if q == 1]
            assert sum(i in kept for i in good) >= 0.97 * len(good)
            assert sum(q == 0 and i in kept for i, q in labels.items()) <= 0.05 * len(labels)
    assert counts[0] > counts[1] > counts[2] >= counts[3] and counts[4] >= counts[3]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    rows = sorted(last.collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))


def test_all_queries_are_registered():
    names = set(__spark_entry__.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= names


def written(spark, folder, docs, labels, benchmark):
    clashing = ("row", "score", "posterior", "copies", "found", "tokens", "draw", "id", "bucket", "least")
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    table.selectExpr("*", *(f"doc_id as {c}" for c in clashing)).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_awkward_tables_go_through_all_stages(spark, awkward, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing columns; the result against what each stage must do."""
    from tokenizers import Tokenizer

    from edgeloom.llm.queries import default_tokenizer

    good = [(1000 + i, f"Plain words number {i} are here, with some {i * 7} more. And still others of them follow {i * i}.") for i in range(60)]
    bad = [(2000 + i, f"WORDS!! ARE!! LOUD!! {i}!! " * 4) for i in range(30)]
    item = "what is the name of the river that runs through this old town"
    extra = [(3000, good[3][1]), (3001, good[3][1].upper().lower()), (3002, f"Plain words first. {item}. And a few more of them follow."), (1007, good[7][1])]
    docs = [(i, t, ("aa", "bb", None)[(i or 0) % 3], "s", None) for i, t in [*good, *bad, *extra, *awkward]]
    labels = [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(5000, None, 0), (None, 1, 0)]
    sf_dir = written(spark, tmp_path / "full", docs, labels, [(1, item), (2, None), (None, "")])
    rows = sorted(corpus_pipeline.run(spark, sf_dir).collect(), key=lambda r: r.start)
    found = {r.doc_id for r in rows}
    assert {i for i, _ in good} <= found
    assert not found & ({i for i, _ in bad} | {3000, 3001, 3002})
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False)) and rows[0].start == 0
    tokenizer = Tokenizer.from_file(default_tokenizer())
    counts = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in good}
    assert all(r.n_tokens == counts[r.doc_id] for r in rows if r.doc_id in counts)


def test_empty_tables_go_through_all_stages(spark, tmp_path):
    assert corpus_pipeline.run(spark, written(spark, tmp_path / "none", [], [], [])).collect() == []
