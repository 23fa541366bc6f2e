"""The tool on small source trees: what it answers, and how its index lives."""

import json
import os
import threading

import pytest
from edgeloom.model import CAPABILITIES, DIAGNOSTIC_CODES, Query, ScanLimits
from edgeloom.plans.engine import Engine, engine_for
from edgeloom.plans.index import SingleFlight
from edgeloom.sources.files import list_tree
from edgeloom.sources.packages import discover, discover_tree


def tree(root, files):
    for path, content in files.items():
        at = os.path.join(root, path)
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "wb") as f:
            f.write(content if isinstance(content, bytes) else content.encode())
    return str(root)


CHAIN = {
    "src/a.ts": "import { b } from './b'\nexport function a() { return b() }\n",
    "src/b.ts": "import { c } from './c'\nexport function b() { return c() }\n",
    "src/c.ts": "import { d } from './d'\nexport function c() { return d() }\n",
    "src/d.ts": "export function d() { return 1 }\nfunction inner() {}\nexport const e = () => inner()\n",
    "src/store.ts": "export class Store {\n  load() { return this.save() }\n  save() { return cb() }\n}\n",
    "src/use.ts": "import { Store } from './store'\nexport const use = (s: Store) => s.load()\n",
    "src/x1.ts": "export function helper() {}\n",
    "tests/x2.ts": "export function helper() {}\n",
    "py/base.py": "class Base:\n    pass\n",
    "py/child.py": "from .base import Base\nclass Child(Base):\n    def go(self):\n        return run()\n",
}


@pytest.fixture(scope="module")
def chain(spark, tmp_path_factory):
    return Engine(spark, tree(tmp_path_factory.mktemp("chain"), CHAIN))


def edges(answer):
    return [(e["kind"], e["source"], e["target"], e["confidence"]) for p in answer["paths"] for e in p["edges"]]


def codes(answer):
    return [d["code"] for d in answer["diagnostics"]]


def test_callers(chain):
    got = chain.explore("callers", "d")
    assert edges(got) == [
        ("definition", "src/d.ts", "d", "exact"), ("call", "src/c.ts", "d", "inferred"), ("call", "src/b.ts", "c", "inferred"), ("call", "src/a.ts", "b", "inferred"),
    ]
    assert got["total"] == 4 and not got["truncated"] and got["metadata"]["index"]["status"] in ("rebuilt", "reused")
    assert got["metadata"]["capabilities"] == CAPABILITIES and got["metadata"]["index"]["files"] == 10
    assert edges(chain.explore("callers", "d", relation="call")) == [("call", "src/c.ts", "d", "inferred")]
    assert edges(chain.explore("callers", "d", scope="py")) == []
    assert ("call", "src/d.ts", "inner", "exact") in edges(chain.explore("callers", "inner", confidence="exact"))


def test_impact_and_reachability(chain):
    got = chain.explore("impact", "d")
    assert got["metadata"]["impact"] == {"direct": ["c"], "transitive": ["b", "a"], "maxDepth": 5}
    assert chain.explore("impact", "d", max_depth=1)["metadata"]["impact"]["transitive"] == []
    far = chain.explore("impact", "d", max_depth=999)
    assert far["metadata"]["impact"]["maxDepth"] == 20 and any("clamped" in d["message"] for d in far["diagnostics"])
    path = chain.explore("reachability", "a", path_to="d")
    assert [e[2] for e in edges(path)] == ["b", "c", "d"] and path["total"] == 3
    assert codes(chain.explore("reachability", "d", path_to="a")) == ["no_path"]
    assert ("definition", "src/d.ts", "d", "exact") in edges(chain.explore("reachability", "d"))


def test_methods(chain):
    assert ("call", "src/use.ts", "Store.load", "inferred") in edges(chain.explore("callers", "load"))
    assert ("call", "src/store.ts", "Store.save", "exact") in edges(chain.explore("callers", "Store.save"))
    assert codes(chain.explore("callers", "cb")) == ["unknown_target"]


def test_targets(chain):
    got = chain.explore("callers", "helper")
    assert [(c["path"], c["language"], c["line"]) for c in got["candidates"]] == [("src/x1.ts", "typescript", 1), ("tests/x2.ts", "typescript", 1)]
    assert codes(got) == ["ambiguous_target"] and got["paths"] == []
    assert [c["name"] for c in chain.explore("callers", "src/store.ts")["candidates"]] == ["Store", "Store.load", "Store.save"]
    listed = chain.explore("callers", "src", limit=3)
    assert len(listed["candidates"]) == 3 and listed["truncated"] and listed["total"] > 3 and codes(listed) == ["ambiguous_target", "truncated"]
    assert edges(chain.explore("callers", "src/store.ts:2"))[0][2] == "Store.load"
    assert codes(chain.explore("callers", "src/store.ts:99")) == ["unknown_target"]
    assert edges(chain.explore("callers", "d.ts", relation="import")) == [("import", "src/c.ts", "src/d.ts", "exact")]
    assert codes(chain.explore("callers", "ts", relation="import")) == ["unknown_target"]


def test_python_and_limits(chain):
    assert edges(chain.explore("callers", "Base", relation="inherit")) == [("inherit", "py/child.py", "Base", "exact")]
    assert edges(chain.explore("callers", "base.py", relation="import")) == [("import", "py/child.py", "py/base.py", "exact")]
    many = chain.explore("callers", None, relation="definition", limit=2)
    assert many["truncated"] and len(many["paths"]) == 2 and codes(many) == ["truncated"]
    assert any("clamped to hard cap 200" in d["message"] for d in chain.explore("callers", "d", limit=500)["diagnostics"])


def test_snippets_and_json(chain):
    got = json.loads(chain.explore_json(mode="callers", target="d", include_snippets=True, query="who calls d"))
    first = got["paths"][0]["edges"][0]
    assert first["snippet"]["lines"][0].startswith("export function d") and len(first["snippet"]["lines"]) == 3
    assert "snippet" not in chain.explore("callers", "d")["paths"][0]["edges"][0]
    assert set(codes(got)) <= set(DIAGNOSTIC_CODES)


def test_invalid_input(chain, spark):
    got = chain.explore("search", "d")
    assert codes(got) == ["invalid_mode"] and got["metadata"]["index"]["status"] == "empty"
    with pytest.raises(ValueError):
        Query("callers", relation="calls")
    with pytest.raises(RuntimeError):
        Engine(spark, chain.root, enabled=False).explore("callers", "d")
    assert engine_for(spark, chain.root) is engine_for(spark, chain.root) is not engine_for(spark, chain.root, {"max_files": 3})
    assert set(chain.diff_impact(["d", "c"])) == {"d", "c"}


def test_scan_deviations_and_globs(spark, tmp_path):
    files = {
        "ok.ts": "export function ok() {}\n", "big.ts": "x" * 1000, "bin.ts": b"\x89PNG\0\0", "bad.ts": b"abc\xc3\x28", "p.razor": "@x",
        "gen/g.ts": "export function g() {}\n", "m.mjs": "export function m() {}\n", "node_modules/n.ts": "export function n() {}\n", ".gitignore": "# x\nskipped/\n",
        "skipped/s.ts": "export function s() {}\n", "__tests__/t.ts": "export function t() {}\n",
    }
    engine = Engine(spark, tree(tmp_path, files), {"max_file_bytes": 500, "exclude": ["gen/"], "include": ["**/*.mjs"]})
    got = engine.explore("callers", "ok")
    assert codes(got)[0] == "partial" and set(codes(got)) == {"partial", "file_oversize", "file_binary", "file_decode_failed", "unsupported_language"}
    known = {r.target for r in engine.index.edges.select("target").collect()}
    assert known == {"ok", "m", "t"}
    small = Engine(spark, str(tmp_path), {"max_files": 2})
    assert any(d["code"] == "file_count_stop" and " 2 " in d["message"] for d in small.explore("callers", "bad")["diagnostics"])


def test_index_life_cycle(spark, tmp_path):
    root = tree(tmp_path, {"a.ts": "export function a() {}\n", "b.ts": "import { a } from './a'\nexport const b = () => a()\n", "c.py": "def c():\n    return a()\n"})
    engine = Engine(spark, root)
    assert engine.explore("callers", "a", refresh_timeout_ms=0)["diagnostics"][0]["code"] == "indexing"
    assert engine.warmup() == "rebuilt" and engine.warmup() == "reused"
    again = Engine(spark, root)
    again.index.ensure_fresh()
    assert again.index.status == "reused" and again.index.edges.count() == engine.index.edges.count()
    tree(tmp_path, {"b.ts": "export const b = () => c()\n", "d.ts": "export const d = () => c()\n"})
    os.remove(os.path.join(root, "a.ts"))
    waiting = again.explore("callers", "c", refresh_timeout_ms=0)
    assert waiting["metadata"]["index"]["status"] == "indexing" and waiting["metadata"]["index"]["retryAfterMs"] > 0
    got = again.explore("callers", "c")
    assert got["metadata"]["index"]["status"] == "incremental" and got["metadata"]["index"]["refreshedFiles"] == 2
    assert [e[1] for e in edges(got) if e[0] == "call"] == ["b.ts", "d.ts"] and codes(again.explore("callers", "a")) == ["unknown_target"]
    fresh = Engine(spark, root)
    fresh.index.rebuild()
    want = sorted(map(tuple, fresh.index.edges.drop("child").collect()))
    assert sorted(map(tuple, again.index.edges.drop("child").collect())) == want
    with open(os.path.join(root, ".edgeloom/snapshot.json"), "r+") as f:
        meta = json.load(f)
        f.seek(0)
        json.dump({**meta, "version": 999}, f)
        f.truncate()
    stale = Engine(spark, root)
    assert stale.warmup() == "rebuilt"
    other = Engine(spark, root, {"exclude": ["d.ts"]})
    assert other.warmup() == "rebuilt" and other.index.limits == ScanLimits(exclude=("d.ts",))


def test_refresh_reads_changed_files_only(spark, tmp_path, monkeypatch):
    from edgeloom.plans import index

    real, reads = index.read_files, []

    def counted(files, *rest):
        reads.append(sorted(r.path for r in files.collect()))
        return real(files, *rest)

    monkeypatch.setattr(index, "read_files", counted)
    root = tree(tmp_path, {"a.ts": "export function a() {}\n", "b.ts": "export const b = () => a()\n", "bin.ts": b"\x89PNG\0\0"})
    engine = Engine(spark, root)
    assert engine.warmup() == "rebuilt" and reads.pop() == ["a.ts", "b.ts", "bin.ts"] and engine.index.files == 2
    assert engine.warmup() == "reused" and not engine.index.dirty() and reads == []
    assert Engine(spark, root).warmup() == "reused" and reads == []
    tree(tmp_path, {"bin.ts": b"\x89PNG\0\0\0"})  # left out before and after
    assert engine.warmup() == "reused" and reads.pop() == ["bin.ts"] and engine.warmup() == "reused" and reads == []
    tree(tmp_path, {"b.ts": "export const other = () => a()\n"})
    got = engine.explore("callers", "a")
    assert reads.pop() == ["b.ts"] and reads == [] and got["metadata"]["index"]["status"] == "incremental"
    assert "file_binary" in codes(got) and [e[1] for e in edges(got) if e[0] == "call"] == ["b.ts"]
    tree(tmp_path, {"bin.ts": "export const late = () => a()\n"})
    got = engine.explore("callers", "a")
    assert reads.pop() == ["bin.ts"] and codes(got) == [] and engine.index.files == 3
    os.remove(os.path.join(root, "bin.ts"))
    assert engine.warmup() == "incremental" and reads.pop() == [] and engine.index.files == 2


def test_failed_refresh_is_done_again(spark, tmp_path, monkeypatch):
    engine = Engine(spark, tree(tmp_path, {"a.ts": "export function a() {}\n"}))
    engine.warmup()
    tree(tmp_path, {"b.ts": "export function b() {}\n"})
    with monkeypatch.context() as patch:
        patch.setattr(engine.index, "_assemble", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            engine.warmup()
    assert engine.index.dirty() and engine.warmup() == "incremental"
    assert {r.target for r in engine.index.edges.select("target").collect()} == {"a", "b"}


def test_listing_stops_at_the_budget(spark, tmp_path, monkeypatch):
    from edgeloom.sources import files as source

    root = tree(tmp_path, {p: "x = 1\n" for p in ("a/z.py", "a.py", "a-b/c.py", "b.txt", "c/d/e.py", "c.py", "d.py", "e/f.py")})
    paths = [p for p, _, _ in source.walk_tree(root)]
    assert paths == sorted(paths) and len(paths) == 8
    walked, real = [], source.walk_tree
    monkeypatch.setattr(source, "CHUNK", 2)
    monkeypatch.setattr(source, "walk_tree", lambda *a: (walked.append(x) or x for x in real(*a)))
    for most, told in ((0, False), (1, True), (3, True), (4, True), (7, False), (9, False)):
        walked.clear()
        taken, notes = source.listed(spark, root, ScanLimits(max_files=most))
        assert [r.path for r in taken.orderBy("path").collect()] == [p for p in paths if p.endswith(".py")][:most]
        assert [n["code"] for n in notes] == ["file_count_stop"] * told
        assert len(walked) <= most + 3


def test_monorepo(spark, tmp_path):
    files = {
        "package.json": '{"name": "@repo/root"}', "packages/api/package.json": '{"name": "@repo/api"}', "packages/app/package.json": '{"name": "@repo/app"}', "libs/s/deep/package.json": "{bad",
        "packages/api/src/hub.ts": "export function hub() { return 1 }\n", "packages/app/src/main.ts": "import { hub } from '@repo/api/src/hub'\nexport function main() { return hub() }\n",
    }
    engine = Engine(spark, tree(tmp_path, files))
    got = engine.explore("callers", "hub.ts", relation="import")
    assert edges(got) == [("import", "packages/app/src/main.ts", "packages/api/src/hub.ts", "exact")]
    assert set(got["metadata"]["packages"]) == {"packages/api", "packages/app", "libs/s/deep"}
    assert edges(engine.explore("callers", "hub", relation="call", scope="app")) == [("call", "packages/app/src/main.ts", "hub", "inferred")]
    assert engine.explore("impact", "hub")["metadata"]["impact"]["direct"] == ["main"]
    manifests = spark.createDataFrame([(p, t) for p, t in files.items() if p.endswith("package.json")], "path string, text string")
    assert sorted((r.dir, r.name) for r in discover(manifests).collect()) == sorted((d, n) for d, n in discover_tree(str(tmp_path)))
    assert len(list_tree(str(tmp_path))) >= len(files)


def test_go_interfaces_across_types(spark, tmp_path):
    text = "package m\ntype I interface {\n  A()\n  B()\n}\ntype T struct{}\nfunc (t T) A() {}\nfunc (t T) B() {}\ntype U struct{}\nfunc (u U) A() {}\n"
    engine = Engine(spark, tree(tmp_path, {"m.go": text}))
    assert edges(engine.explore("callers", "I", relation="inherit")) == [("inherit", "m.go", "I", "inferred")]


def test_single_flight():
    flight, ran, inside, go = SingleFlight(), [], threading.Event(), threading.Event()

    def work():
        inside.set()
        go.wait(5)
        ran.append(1)
        return len(ran)

    results = []
    first = threading.Thread(target=lambda: results.append(flight.run(work)))
    first.start()
    inside.wait(5)
    others = [threading.Thread(target=lambda: results.append(flight.run(work))) for _ in range(3)]
    for t in others:
        t.start()
    threading.Timer(0.2, go.set).start()
    for t in [first, *others]:
        t.join()
    assert results == [1] * 4 and flight.run(lambda: 7) == 7
