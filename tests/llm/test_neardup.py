import random

import numpy as np
from edgeloom.llm.common import shingle_set, words_of
from edgeloom.llm.graph import components
from edgeloom.llm.neardup import deduplicated, minima, near_duplicates


def brute(rows, k, num, den):
    """(n_shingles, smallest reachable id) by id, over all pairs."""
    sets = []
    for i, t in rows:
        w = words_of((t or "").encode())
        n = min(k, len(w))
        sets.append((i, {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if w else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and sets[a][0] is not None and sets[b][0] is not None and den * len(x & y) >= num * len(x | y):
                root[find(a)] = find(b)
    low = {}
    for a, (i, _) in enumerate(sets):
        low[find(a)] = min(low.get(find(a), i), i) if i is not None else None
    return sorted((i is None, i or 0, len(s), low[find(a)] or 0) for a, (i, s) in enumerate(sets))


def result(out):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in out.collect())


def chain(seed, n, words):
    """Texts of which each is the one before with a few words changed: neighbours are alike, ends aren't."""
    rnd = random.Random(seed)
    text = [f"v{rnd.randrange(500)}" for _ in range(words)]
    out = []
    for _ in range(n):
        text = text.copy()
        for _ in range(1 + words // 60):
            text[rnd.randrange(words)] = f"v{rnd.randrange(500)}"
        out.append(" ".join(text))
    return out


def test_components_against_all_pairs(docs):
    texts = [t for s in range(6) for t in chain(s, 25, 80 + 40 * s)] + ["a b c", "A b c", "a b", "a b c d", "x"] * 3
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    assert result(near_duplicates(docs(rows), 4, 80, 100)) == brute(rows, 4, 80, 100)


def test_a_large_group_in_blocks(docs, monkeypatch):
    from edgeloom.llm import neardup

    monkeypatch.setattr(neardup, "BLOCK", 16)
    rows = list(enumerate(chain(9, 120, 90) + ["same words here again and again"] * 200))
    assert result(near_duplicates(docs(rows), 5, 80, 100)) == brute(rows, 5, 80, 100)


def test_awkward_rows(docs, awkward):
    assert result(near_duplicates(docs(awkward), 4)) == brute(awkward, 4, 80, 100)
    assert near_duplicates(docs([])).collect() == []


def test_the_filter_keeps_one_of_each_group_and_all_columns(docs):
    rows = list(enumerate(chain(3, 20, 100))) + [(50, "other words"), (50, "other words"), (None, "no id"), (60, None)]
    table = docs(rows).selectExpr("*", "doc_id as row", "text as least")
    out = deduplicated(table)
    assert out.columns == table.columns
    want = {b[3] for b in brute(rows, 5, 80, 100) if not b[0]}
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == sorted(want)
    assert out.where("doc_id is null").count() == 1


def test_minima_estimate_similarity():
    rng = np.random.default_rng(1)
    both = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    a, b = np.concatenate([both, rng.integers(0, 1 << 63, 250, dtype=np.uint64)]), both
    assert abs((minima(a) == minima(b)).mean() - 0.8) < 0.15
    assert len(shingle_set(b"a b c d e", 4)) == 2


def test_star_components_on_random_graphs(spark):
    rnd = random.Random(4)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000, 1000 + i) for i in range(1, 400)] + [(5000 + i, 5001 + i) for i in range(60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {(v, find(v)) for e in links for v in e if e[0] != e[1]}
    assert {tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect()} == want


def test_a_pair_at_the_threshold_is_hardly_ever_missed():
    from math import ceil, comb

    from edgeloom.llm.neardup import HASHES, ROWS, SLACK

    s = 0.8
    need = ceil((s - SLACK * (s * (1 - s) / HASHES) ** 0.5) * HASHES)
    pruned = sum(comb(HASHES, k) * s**k * (1 - s) ** (HASHES - k) for k in range(need))
    assert pruned + (1 - s**ROWS) ** (HASHES // ROWS) < 1e-7
