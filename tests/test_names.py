import posixpath

import pytest
from edgeloom.functions import names, paths
from pyspark.sql import functions as F

NAMES = ["", "a", "Foo", "A.b", "A.B.c", ".hidden", "x.", "src/a.ts", "src/A.b.ts", "/a", "a/", "./b", "n/m.k", "a.b/c", "É.ü"]


def column(spark, values, make, name="v"):
    table = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in table.orderBy("i").select(make(F.col("v"))).collect()]


def short(n):
    at = n.rfind(".")
    return n if "/" in n or at <= 0 else n[at + 1 :]


def test_short_names(spark):
    assert column(spark, NAMES, names.short_name) == [short(n) for n in NAMES] == [names.short_of(n) for n in NAMES]


@pytest.mark.parametrize("needle", ["a", "b", "B", "foo", "c", "b.c", "a.ts", "src/a.ts", "hidden", "ü"])
def test_predicates(spark, needle):
    n = needle.lower()

    def node(t):
        t = t.lower()
        return t == n or t.endswith("/" + n) or ("/" not in t and t.rfind(".") > 0 and t[t.rfind(".") + 1 :] == n)

    def symbol(t):
        t = t.lower()
        return t == n or t.endswith("/" + n) or t.endswith("." + n)

    assert column(spark, NAMES, lambda c: names.matches_node(c, needle)) == [node(t) for t in NAMES]
    assert column(spark, NAMES, lambda c: names.targets_symbol(c, needle)) == [symbol(t) for t in NAMES]
    keys = column(spark, NAMES, lambda c: names.symbol_keys(c, True))
    assert [n in k for k in keys] == [symbol(t) for t in NAMES]
    keys = column(spark, NAMES, lambda c: names.symbol_keys(c, False))
    assert [n in k for k in keys] == [t.lower() == n or t.lower().endswith("/" + n) for t in NAMES]


def test_aliases():
    assert names.aliases_for("Load", "Store.load") == ["load", "store.load"]
    assert names.aliases_for("Store.load", None) == ["store.load", "load"]
    assert names.aliases_for("a/b.ts", None) == ["a/b.ts"]


def test_callers_tests_and_languages(spark):
    files = ["src/Foo.ts", "a.b.spec.ts", "tests/x.py", "b/__tests__/y.js", "Tests/z.go", "m.TEST.tsx", "latest/n.rs", "noext", "a\\tests\\b.ts"]
    assert column(spark, files, names.caller_symbol) == ["foo", "a.b.spec", "x", "y", "z", "m.test", "n", "noext", "a\\tests\\b"]
    assert column(spark, files, names.caller_symbol) == [names.caller_of(f) for f in files]
    assert column(spark, files, names.is_test_path) == [False, True, True, True, False, True, False, False, True]
    assert column(spark, ["a.ts", "b.HPP", "c.mjs", "d"], paths.language) == ["typescript", "cpp", "mjs", "d"]
    assert column(spark, ["a.TS", "x/.gitignore", "b/c", "d.tar.gz", "x.y/z"], paths.extension) == [".ts", "", "", ".gz", ""]


def test_paths(spark):
    raw = ["a/b", "a/./b", "a//b/", "a/../b", "../a", "a/../../b", ".", "", "./a", "a/b/../../..", "../../x/../y"]
    assert column(spark, raw, paths.normalized) == [posixpath.normpath(r) if r else "." for r in raw] == [paths.normalize(r) for r in raw]
    assert column(spark, ["a", "a/b", "a/b/c.ts"], paths.directory) == [".", "a", "a/b"]


def test_wanted_kinds():
    assert names.wanted_kinds("callers", None) == ("call", "definition")
    assert names.wanted_kinds("impact", None) == ("definition", "import") and names.wanted_kinds("callers", "import") == ("import",)
