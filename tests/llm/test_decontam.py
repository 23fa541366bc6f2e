from edgeloom.llm import decontam
from edgeloom.llm.common import words_of
from edgeloom.llm.decontam import clean, matches

ITEM = "the quick brown fox jumps over the lazy dog while nine more words follow here in order to be long"


def brute(docs, items, k, num, den):
    out = set()
    for item_id, text in items:
        w = words_of((text or "").encode())
        n = min(k, len(w))
        item = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if w else set()
        for doc_id, body in docs:
            v = words_of((body or "").encode())
            own = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)}
            if item and den * len(item & own) >= num * len(item):
                out.add((doc_id, item_id, len(item), len(item & own)))
    return out


def tables(spark, docs):
    items = [(1, ITEM), (2, "Short one"), (3, ""), (4, None), (5, ITEM.replace("fox", "cat")), (6, " ".join(f"w{i}" for i in range(300))), (1, ITEM)]
    filler = " ".join(f"filler{i}" for i in range(3000))
    rows = [
        (10, filler + " " + ITEM.upper() + " " + filler), (11, ITEM.replace("lazy", "busy")), (12, filler), (13, "a short ONE b"), (14, None), (15, ""),
        (16, " ".join(f"w{i}" for i in range(20, 290))), (17, " ".join(f"w{i}" for i in range(100))), (18, "the quick brown fox jumps " + filler + " over the lazy dog while nine more words follow here in order to be long"),
    ]
    return docs(rows), spark.createDataFrame(items, "item_id long, text string"), rows, items


def test_matches_against_all_pairs(spark, docs):
    table, benchmark, rows, items = tables(spark, docs)
    for share in (80, 50, 100):
        assert {tuple(r) for r in matches(table, benchmark, 5, share, 100).collect()} == brute(rows, items, 5, share, 100)


def test_items_in_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 40)
    table, benchmark, rows, items = tables(spark, docs)
    assert {tuple(r) for r in matches(table, benchmark).collect()} == brute(rows, items, 5, 80, 100)


def test_the_filter_keeps_other_rows_and_all_columns(spark, docs, awkward):
    table, benchmark, rows, items = tables(spark, docs)
    table = table.selectExpr("*", "doc_id as found", "text as row")
    leaked = {d for d, *_ in brute(rows, items, 5, 80, 100)}
    out = clean(table, benchmark)
    assert out.columns == table.columns and {r.doc_id for r in out.collect()} == {i for i, _ in rows} - leaked
    assert clean(docs(awkward), benchmark).count() == len(awkward)
    assert clean(docs([]), benchmark).collect() == [] and clean(table, benchmark.where("false")).count() == len(rows)
