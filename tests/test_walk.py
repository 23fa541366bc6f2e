"""Walks against a plain model of their definition, on random graphs."""

import random

import pytest
from edgeloom.functions.names import caller_of
from edgeloom.model import EDGE_SCHEMA
from edgeloom.operators import walk


def graph(seed, n_files, n_calls, shapes=("{}", "{}", "x/{}", "O.{}")):
    rnd = random.Random(seed)
    edges = [("definition", f"src/s{i}.ts", f"s{i}", "exact", f"src/s{i}.ts", 1, 1) for i in range(n_files)]
    for _ in range(n_calls):
        file = f"src/s{rnd.randrange(n_files)}.ts"
        edges.append(("call", file, rnd.choice(shapes).format(f"S{rnd.randrange(n_files)}"), "inferred", file, rnd.randrange(3), 1))
    return [(*e, i) for i, e in enumerate(edges)]


def dotted(t, s):
    t = t.lower()
    return t == s or t.endswith("/" + s) or t.endswith("." + s)


def slashed(t, s):
    t = t.lower()
    return t == s or t.endswith("/" + s)


def key(e):
    return e[1], e[2], e[5]


def model_upstream(edges, symbol, depth):
    calls = [e for e in edges if e[0] == "call"]
    level = [e for e in calls if dotted(e[2], symbol)]
    seen, out = {key(e) for e in level}, [(e[7], 1) for e in level]
    for hop in range(2, depth + 1):
        new = []
        for step in level:
            found = [e for e in calls if dotted(e[2], caller_of(step[1])) and key(e) not in seen]
            seen |= {key(e) for e in found}
            new += found
        out += [(e[7], hop) for e in new]
        level = new
    return out


def model_callers(edges, target, limit):
    calls = [e for e in edges if e[0] == "call"]
    out = [e for e in edges if e[0] == "definition" and dotted(e[2], target)]
    queue = [e for e in calls if dotted(e[2], target)]
    out += queue
    seen, guard = {key(e) for e in queue}, 0
    while queue and len(out) < limit and guard < 64:
        guard += 1
        symbol = caller_of(queue.pop(0)[1])
        for e in calls:
            if slashed(e[2], symbol) and key(e) not in seen:
                seen.add(key(e))
                out.append(e)
                queue.append(e)
    return [e[7] for e in out[:limit]], len(out)


def model_reach(edges, start, goal, depth):
    calls = [e for e in edges if e[0] == "call"]
    level, seen = [[e] for e in calls if dotted(e[2], goal)], set()
    for _ in range(depth):
        for chain in level:
            if caller_of(chain[0][1]) == start:
                return [e[7] for e in chain]
        new = []
        for chain in level:
            found = [e for e in calls if slashed(e[2], caller_of(chain[0][1])) and key(e) not in seen]
            seen |= {key(e) for e in found}
            new += [[e, *chain] for e in found]
        level = new
    return None


@pytest.mark.parametrize("seed", range(6))
def test_walks_follow_the_model(spark, seed):
    rnd = random.Random(100 + seed)
    n = rnd.choice([4, 8, 15])
    edges = graph(seed, n, rnd.choice([6, 20, 60]))
    table = spark.createDataFrame(edges, EDGE_SCHEMA)
    goal, start = f"s{rnd.randrange(n)}", f"s{rnd.randrange(n)}"
    depth = rnd.choice([1, 2, 5])
    walked = [(r.ord, r.hop) for r in walk.upstream(table, goal, depth).orderBy("hop", "rank").collect()]
    assert walked == model_upstream(edges, goal, depth)
    limit = rnd.choice([3, 10, 200])
    matching = table.where(f"lower(target) = '{goal}' or lower(target) like '%/{goal}' or lower(target) like '%.{goal}'")
    found = walk.callers(table, matching, limit)
    assert ([r.ord for r in found.rows], found.total) == model_callers(edges, goal, limit)
    chain = walk.reach(table, start, goal, depth)
    assert (None if chain is None else [r.ord for r in chain.orderBy("step").collect()]) == model_reach(edges, start, goal, depth)


def test_the_guard_of_dequeues(spark):
    edges = [("call", f"src/f{i}.ts", f"f{i + 1}" if i < 90 else "goal", "exact", f"src/f{i}.ts", 1, 1, i) for i in range(91)]
    table = spark.createDataFrame(edges, EDGE_SCHEMA)
    found = walk.callers(table, table.where("target = 'goal'"), 200)
    assert ([r.ord for r in found.rows], found.total) == model_callers(edges, "goal", 200) and found.total == 65


def test_depth_and_layers(spark):
    assert [walk.clamp_depth(d) for d in (-1, 0, 1, 20, 21)] == [1, 1, 1, 20, 20]
    edges = [("call", "src/b.spec.ts", "a", "exact", "src/b.spec.ts", 1, 1, 0), ("call", "src/c.ts", "b.spec", "exact", "src/c.ts", 1, 1, 1), ("call", "src/b.ts", "c", "exact", "src/b.ts", 1, 1, 2)]
    walked = walk.upstream(spark.createDataFrame(edges, EDGE_SCHEMA), "a", 5)
    assert walk.impact_layers(walked) == (["b"], ["c"])


def test_hot_names_resolve_alike(spark, monkeypatch):
    from edgeloom.operators import resolve

    defined = [("a.ts", "Box.hot"), ("b.ts", "Box.two"), ("c.ts", "Jar.two"), ("a.ts", "plain"), ("d.ts", "Jar.cold")]
    called = [(f"{x}.ts", name) for x in "abcd" for name in ("hot", "two", "plain", "cold", "none")] + [("a.ts", "HOT")] * 30 + [("e.ts", "none")] * 25 + [("c.ts", "two")] * 20
    rows = [("definition", f, t, "exact", f, 1, 1, i) for i, (f, t) in enumerate(defined)]
    rows += [("call", f, t, "inferred", f, 2, 1, i + 100) for i, (f, t) in enumerate(called)]
    edges = spark.createDataFrame(rows, EDGE_SCHEMA)
    plain = sorted(map(str, resolve.resolve_calls(edges).collect()))
    monkeypatch.setattr(resolve, "HOT_SHARE", 5)
    monkeypatch.setattr(resolve, "HOT_LEAST", 10)
    split = sorted(map(str, resolve.resolve_calls(edges).collect()))
    assert len(plain) == len(rows) and split == plain
    branches = {(r.file, r.ord): (r.target, r.confidence, r.branch) for r in resolve.resolve_calls(edges).where("kind = 'call'").collect()}
    assert branches["a.ts", 100] == ("Box.hot", "exact", "samefile") and branches["b.ts", 105] == ("Box.hot", "inferred", "unique")
    assert branches["b.ts", 106][2] == "samefile" and branches["a.ts", 101] == ("two", "heuristic", "multiple")
    nothing = edges.where("kind = 'definition'")
    assert resolve.resolve_calls(nothing).count() == len(defined)
