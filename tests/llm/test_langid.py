import numpy as np
from edgeloom.llm.langid import Trees, contexts, identify, learn


def labelled(spark):
    words = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["schtz", "ung", "keit"], "cc": ["ción", "ñado", "que"]}
    rows = [(i, " ".join(words[lang][(i * 7 + j) % 3] for j in range(30)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 20)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def ppm(texts, order=3):
    """A function (history, byte) -> probability by method C with exclusion, from the texts alone."""
    counts = {}
    for t in texts:
        t = b" " * order + t.lower()
        for i in range(order, len(t)):
            for k in range(order + 1):
                seen = counts.setdefault(t[i - k : i], {})
                seen[t[i]] = seen.get(t[i], 0) + 1

    def distribution(history):
        lower = distribution(history[1:]) if history else [1 / 256] * 256
        seen = counts.get(history)
        if not seen:
            return lower
        rest = sum(p for b, p in enumerate(lower) if b not in seen)
        total, escape = sum(seen.values()), len(seen) if len(seen) < 256 else 0
        return [seen[b] / (total + escape) if b in seen else p / rest * escape / (total + escape) for b, p in enumerate(lower)]

    return distribution


def test_code_lengths_against_the_definitions(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in labelled(spark).collect()]
    trees = Trees(learn(labelled(spark)))
    assert trees.langs == ["aa", "bb", "cc"]
    texts = ["ción lorem XYZ".encode(), b"", b"\xff", b"Schtz keit\x00 \n lorem ipsum dolor zzz", b"q"]
    got = trees.code_lengths(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    for k, lang in enumerate(trees.langs):
        distribution = ppm([t.encode() for _, t, x in rows if x == lang])
        for j, text in enumerate(texts):
            low = b"   " + text.lower()
            want = 0.0
            for i in range(3, len(low)):
                p = distribution(low[i - 3 : i])
                assert abs(sum(p) - 1) < 1e-9
                want -= np.log2(p[low[i]])
            assert np.isclose(got[j, k], want, rtol=1e-5), (lang, text)


def test_marks_are_no_letters(spark, docs):
    found = {r.doc_id: r.lang_pred for r in identify(docs([(1, "² ① ½ 12"), (2, "² é"), (3, "\u4e2d"), (None, "_-")]), learn(labelled(spark))).collect()}
    assert found[1] == found[None] == "und" and "und" not in (found[2], found[3])


def test_a_null_id_is_not_held_out(spark, tmp_path):
    from edgeloom.llm.queries import QUERIES

    rows = labelled(spark).unionByName(spark.createDataFrame([(None, "nur hier steht das", "dd")] * 3, "doc_id long, text string, lang string"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op3_language_id"](spark, str(tmp_path)).where("doc_id is null").collect()
    assert [(r.held_out, r.lang_pred) for r in out] == [(False, "dd")] * 3


def test_contexts_start_anew_with_each_text():
    data, ctx = contexts(np.frombuffer(b"ABCDxy", np.uint8), np.array([0, 4, 6]))
    assert data.tobytes() == b"abcdxy"
    assert ctx[4] == 32 << 16 | 32 << 8 | 32 and ctx[5] == 32 << 16 | 32 << 8 | ord("x") and ctx[3] == ord("a") << 16 | ord("b") << 8 | ord("c")


def test_predictions_and_awkward_rows(spark, docs, awkward):
    model = learn(labelled(spark))
    found = {r.doc_id: r for r in identify(docs([(1, "ipsum lorem dolor"), (2, "keit ung"), (3, "ñado ción"), (4, "123 !"), (5, None), (6, "")]), model).collect()}
    assert [found[i].lang_pred for i in range(1, 7)] == ["aa", "bb", "cc", "und", "und", "und"]
    assert all(0 <= r.score <= 1 for r in found.values()) and found[4].score == 0
    assert identify(docs(awkward), model).count() == len(awkward)


def test_nothing_to_learn_from(spark, docs):
    model = learn(labelled(spark).where("false"))
    assert [(r.lang_pred, r.score) for r in identify(docs([(1, "lorem")]), model).collect()] == [("und", 0.0)]
    assert identify(docs([]), model).collect() == []


def test_held_out_accuracy(spark, sf_dir):
    from edgeloom.llm.queries import QUERIES

    out = QUERIES["op3_language_id"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = out.where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held) > 0
