import hashlib

import pytest
from edgeloom.llm.exact import exact_groups, identities


def brute(rows):
    norm = [(i, (t or "").encode().lower()) for i, t in rows]
    out = []
    for i, t in norm:
        same = [j for j, u in norm if u == t]
        keep = max((j for j in same if j is not None), default=None)
        out.append((i, keep, len(same), i == keep, hashlib.sha256(t).hexdigest()))
    return out


@pytest.mark.parametrize("block", [1, 3, 8192])
def test_groups_against_brute_force(docs, block):
    texts = ["", "a", "A", "ab", "aB", "aba", "abab", "abab", "ababab", "ÄB", "Äb", "äb", None, "abcabcabcx", "abcabcabcX", "abcabcabcy"]
    rows = list(enumerate(texts * 2))
    out = exact_groups(docs(rows), block).collect()
    assert sorted(map(tuple, out)) == sorted(brute(rows))


def test_awkward_rows(docs, awkward):
    out = exact_groups(docs(awkward), 64).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[4])
    assert sorted(map(tuple, out), key=key) == sorted(brute(awkward), key=key)


def test_names_agree_over_the_borders_of_partitions(spark, docs):
    rows = [(i, "the same text again" if i % 3 else f"text {i}") for i in range(6000)]
    out = identities(docs(rows), 4096)
    assert out.select("levels", "name").distinct().count() == 2001
    assert out.where("doc_id % 3 > 0").select("levels", "name").distinct().count() == 1


def test_empty_table(docs):
    assert exact_groups(docs([])).collect() == []


def rows_of_joins(spark, work):
    """Rows that come out of all joins while `work` runs."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def ids():
        bus.waitUntilEmpty(60_000)
        runs = store.executionsList()
        return {runs.apply(i).executionId() for i in range(runs.size())}

    before, total = ids(), 0
    work()
    for run in ids() - before:
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in map(nodes.apply, range(nodes.size())):
            metrics = node.metrics()
            for metric in map(metrics.apply, range(metrics.size() if "Join" in node.name() else 0)):
                if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    total += int(values.apply(metric.accumulatorId()).replace(",", ""))
    return total


def test_more_levels_do_not_join_all_rows_again(spark, docs):
    rows = [(i, "the same text again" if i % 3 else f"text {i}") for i in range(3000)] + [(i, f"{i % 2}" * 2000) for i in range(3000, 3004)]
    flat = rows_of_joins(spark, lambda: exact_groups(docs(rows), 4096).collect())  # one block each
    deep = rows_of_joins(spark, lambda: exact_groups(docs(rows), 32).collect())  # four texts of 63 blocks: six levels
    assert flat >= len(rows)  # the join with the groups
    assert deep <= flat + 1500
    out = exact_groups(docs(rows), 32).collect()
    assert sorted(map(tuple, out)) == sorted(brute(rows))
