import random

from edgeloom.llm import lines
from edgeloom.llm.lines import deduplicated, edits_for, keys_plan, line_classes, within


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rnd, text, edits, letters):
    out = list(text)
    for _ in range(edits):
        kind, at = rnd.randrange(3), rnd.randrange(len(out) + 1)
        if kind == 0 and at < len(out):
            del out[at]
        elif kind == 1 and at < len(out):
            out[at] = rnd.choice(letters)
        else:
            out.insert(at, rnd.choice(letters))
    return "".join(out)


def test_banded_distance():
    rnd = random.Random(1)
    for _ in range(5000):
        a = "".join(rnd.choices("abc", k=rnd.randrange(14)))
        b = edited(rnd, a, rnd.randrange(5), "abcé")
        for t in range(4):
            assert within(a, b, t) == (distance(a, b) <= t), (a, b, t)


def test_probes_meet_a_segment():
    rnd = random.Random(2)
    for _ in range(5000):
        a = "".join(rnd.choices("ab", k=rnd.randint(8, 40)))
        b = edited(rnd, a, rnd.randrange(3), "ab")
        a, b = sorted((a, b), key=len)
        if a != b and distance(a, b) <= edits_for(len(a)):
            assert {(s, a[p : p + n]) for s, p, n, i in keys_plan(len(a)) if i} & {(s, b[p : p + n]) for s, p, n, i in keys_plan(len(b)) if not i}, (a, b)


def brute(rows):
    """(place of the line that stays) by place of each different line's first occurrence."""
    first, copies = {}, {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for n, x in enumerate((t or "").split("\n")):
            if x := x.strip(" \t\n\r\x0b\f"):
                first.setdefault(x, (i is not None, i or 0, n))
                copies[x] = copies.get(x, 0) + 1
    names = list(first)
    root = {x: x for x in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(names)):
        for b in range(a):
            x, y = names[a], names[b]
            if abs(len(x) - len(y)) <= 2 and distance(x, y) <= edits_for(min(len(x), len(y))):
                root[find(x)] = find(y)
    low = {}
    for x in names:
        low[find(x)] = min(low.get(find(x), first[x]), first[x])
    return sorted((*first[x], copies[x], *low[find(x)]) for x in names)


def result(out):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.line, r.copies, r.class_doc_id is not None, r.class_doc_id or 0, r.class_line) for r in out.collect())


def corpus():
    rnd = random.Random(3)
    base = ["".join(rnd.choices("abcdefg hij", k=n)) for n in (9, 11, 19, 20, 35, 60, 200)]
    lines_ = [edited(rnd, rnd.choice(base), rnd.randrange(4), "xyzé") for _ in range(150)] + ["common line of all"] * 60
    rnd.shuffle(lines_)
    return [(i, "\n".join(["", *lines_[i * 7 : i * 7 + 7], "  "])) for i in range(30)]


def test_classes_against_all_pairs(docs, awkward, monkeypatch):
    rows = corpus()
    assert result(line_classes(docs(rows))) == brute(rows)
    monkeypatch.setattr(lines, "BLOCK", 8)
    assert result(line_classes(docs(rows))) == brute(rows)
    short = [(i, t if t is None or len(t) < 1000 else t[:500]) for i, t in awkward]
    assert result(line_classes(docs(short))) == brute(short)
    assert line_classes(docs([])).collect() == []


def test_very_long_lines(docs, awkward):
    """A line of 200,000 characters, one edit of it, three edits of it, and the long rows as they are."""
    long = "".join(random.Random(8).choices("abcdefgh ", k=200_000)).strip()
    assert within(long, long[:70_000] + "Z" + long[70_001:150_000] + long[150_001:], 2)
    assert not within(long, long[:7] + "Z" + long[8:100_000] + "Z" + long[100_001:199_000] + "Z" + long[199_001:], 2)
    rows = [*awkward, (20, long), (21, long[:90_000] + "!" + long[90_000:]), (22, long[:5] + "?" + long[6:9] + "?" + long[10:199_990] + "?" + long[199_991:])]
    got = {(r.doc_id, r.line): (r.class_doc_id, r.copies) for r in line_classes(docs(rows)).collect()}
    assert got[20, 0] == (20, 1) and got[21, 0] == (20, 1) and got[22, 0] == (22, 1) and got[4, 0] == (4, 2)


def test_columns_may_have_any_name(docs):
    rows = [(1, "a first line\nsecond"), (2, "a first line\nthird"), (None, "a first line")]
    table = docs(rows).selectExpr("*", "doc_id as _gone", "doc_id as _id", "text as gone", "text as id", "text as row", "text as a")
    out = deduplicated(table)
    assert out.columns == table.columns
    assert sorted((r.doc_id or 0, r.text, r.gone) for r in out.collect()) == [(0, "a first line", "a first line"), (1, "second", rows[0][1]), (2, "third", rows[1][1])]


def test_texts_lose_repeated_lines(docs):
    rows = [(1, "a first line\nthe second line of it\n\nc"), (2, "the second line of it!\nnew one"), (3, None), (4, "new one")]
    out = {r.doc_id: r.text for r in deduplicated(docs(rows)).collect()}
    assert out == {1: "a first line\nthe second line of it\n\nc", 2: "new one", 3: None, 4: ""}


def test_the_query_names_every_place_of_a_line(spark, docs, tmp_path):
    from edgeloom.llm.queries import QUERIES

    rows = [(1, "a first line\n\nthe second line of it"), (2, "the second line of it!"), (3, "a first line\na first line"), (None, "alone"), (5, None)]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op9_line_dedup"](spark, str(tmp_path)).collect()
    got = {(r.doc_id, r.line): (r.copies, r.class_doc_id, r.class_line, r.kept) for r in out}
    assert len(out) == 6 and got == {
        (1, 0): (3, 1, 0, True), (3, 0): (3, 1, 0, False), (3, 1): (3, 1, 0, False),
        (1, 2): (1, 1, 2, True), (2, 0): (1, 1, 2, False), (None, 0): (1, None, 0, True),
    }
