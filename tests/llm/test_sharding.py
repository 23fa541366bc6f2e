import random
import zlib
from itertools import groupby

import pytest
from edgeloom.llm import sharding
from edgeloom.llm.sharding import shard


def best(sizes, k):
    """The least largest run of a cut into k runs, by dynamic programming."""
    n = len(sizes)
    sums = [0]
    for s in sizes:
        sums.append(sums[-1] + s)
    cost = [0] + [float("inf")] * n
    for _ in range(k):
        cost = [0] + [min(max(cost[j], sums[i] - sums[j]) for j in range(i)) for i in range(1, n + 1)]
    return cost[n]


def groups_of(rows):
    found = {}
    for i, t in rows:
        g = found.setdefault(t or "", [i, 0])
        g[0] = i if g[0] is None or i is None else min(g[0], i)
        g[1] += len((t or "").encode()) + 1
    return [size for _, size in sorted(found.values(), key=lambda g: (g[0] is not None, g[0] or 0))]


@pytest.mark.parametrize("k,small_bins", [(1, False), (3, False), (8, True)])
def test_minimax_against_dynamic_programming(docs, k, small_bins, monkeypatch):
    if small_bins:
        monkeypatch.setattr(sharding, "BIN", 16)
    rows = [(i, "t" * ((i * 37) % 91 + 1)) for i in range(200)] + [(1000 + i, "hot text " * 9) for i in range(60)]
    out = shard(docs(rows), k).collect()
    assert len(out) == len(rows)
    loads = {}
    for r in out:
        loads[r.shard] = loads.get(r.shard, 0) + r.size
    assert set(loads) <= set(range(k))
    assert max(loads.values()) == best(groups_of(rows), k)
    for s, own in groupby(sorted(out, key=lambda r: (r.shard, r.slot)), key=lambda r: r.shard):
        assert [r.slot for r in own] == list(range(sum(r.shard == s for r in out)))


def test_cuts_of_many_tables():
    """Cuts against dynamic programming, with tiny bins and any number of shards; no table behind them."""
    rnd = random.Random(7)

    class Listed(sharding.Prefixes):
        def __init__(self, bins):
            self.bins = bins
            self.start([(p, sum(b)) for p, b in enumerate(bins)])

        def sizes(self, part):
            return self.bins[part]

    for _ in range(3000):
        sizes = [rnd.choice((1, 1, 2, rnd.randint(1, 40))) for _ in range(rnd.randint(1, 25))]
        bins, at = [], 0
        while at < len(sizes):
            n = rnd.randint(1, 4)
            bins.append(sizes[at : at + n])
            at += n
        k = rnd.randint(1, 12)
        places = [(p, r) for p, b in enumerate(bins) for r in range(len(b))]
        cuts = [places.index((p, r)) for _, p, r in sharding.minimax_cuts(Listed(bins), max(sizes), k)]
        loads = [sum(sizes[a:b]) for a, b in zip([0, *cuts], [*cuts, len(sizes)])]
        assert len(loads) <= k and max(loads) == best(sizes, k) and min(loads) > 0, (bins, k)


def test_equal_texts_share_a_shard_and_awkward_rows_are_kept(docs, awkward):
    out = shard(docs(awkward), 8).collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in out) == sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in awkward)
    where = {}
    for r in out:
        where.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_empty_table(docs):
    assert shard(docs([]), 8).collect() == []
