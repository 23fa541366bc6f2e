import pytest
from edgeloom.extract.registry import extract_files, raw_rows

CASES = {
    "a.ts": (
        """import { callee } from './callee'
export * from "./x"
export async function caller(a: number): Promise<{x: number}> {
  const t = `v ${inner(1)} z`
  return callee(a).then((r) => foo.bar(r))
}
class Store<T> extends Base {
  private cache = new Map<string, number>()
  constructor(x) { super(x) }
  get size() { return 1 }
  static async load(p: string): Promise<void> { this.helper(p); return new Foo(bar()) }
  helper(x) { if (ok(x)) { return /a"b/.test(x) } }
}
export interface I { m(x: number): void }
export type X<T> = { a: T }
export const one = 1, two = () => three()
let un
const obj = { meth(a) { return deep(a) }, k: v(1) }
function outer() { const local = 1; function nested() {} }
// commented(1)
""",
        {
            "definition": ["caller", "Store", "Store.load", "Store.helper", "I", "X", "one", "two", "obj", "outer"],
            "import": ["./callee", "./x"],
            "call": ["inner", "then", "callee", "bar", "helper", "bar", "ok", "test", "three", "deep", "v"],
        },
    ),
    "b.py": (
        "from .base import Base\nimport os.path\nclass Child(Base, mod.Other):\n    def run(self, x: Base) -> List[Child]:\n        return greet(hi()).strip()\nasync def f(): pass\n",
        {"definition": ["Child", "run", "f"], "import": [".base", "os.path"], "call": ["strip", "greet", "hi"], "inherit": ["Base", "mod.Other"], "type-ref": ["Child"]},
    ),
    "c.go": (
        'package main\nimport (\n  "fmt"\n  s "./speak"\n)\ntype Speaker interface {\n  Speak() string\n  Other\n}\ntype Dog struct{ name string }\n'
        'func (d *Dog) Speak() string { return fmt.Sprintf("x", d.name) }\nfunc use(x Speaker, n int) { x.Speak(); helper(a.b.c(1)) }\n',
        {"definition": ["Speaker", "Dog", "Speak", "use"], "import": ["fmt", "./speak"], "call": ["Sprintf", "Speak", "helper", "b"], "inherit": ["Other"], "type-ref": ["Speaker"], "interface-method": ["Speak"], "type-method": ["Speak"]},
    ),
    "d.rs": (
        "mod speak;\npub trait Speaker { fn speak(&self) -> u8; }\nstruct Dog;\nimpl Speaker for Dog { fn speak(&self) -> u8 { self.go(); helper(1) } }\n"
        "fn take(x: &dyn Speaker, y: Vec<Dog>, c: char) { x.speak(); println!(\"a\"); Dog::new(); let z = 'a'; }\n",
        {"definition": ["Speaker", "Dog", "speak", "take"], "import": ["speak"], "call": ["go", "helper", "speak"], "inherit": ["Speaker"], "type-ref": ["Speaker", "Speaker", "Dog"]},
    ),
    "E.java": (
        "import a.b.Speak;\npublic class Main extends Base implements Speaker, Other {\n  private int n = compute(1);\n  public Main(int x) { super(x); }\n  @Override\n"
        "  public String speak(Speaker s, List<Main> l) throws E { return s.speak().trim() + helper(new Foo(1)); }\n}\ninterface Speaker { String speak(); }\n",
        {"definition": ["Main", "speak", "Speaker", "speak"], "import": ["a.b.Speak"], "call": ["compute", "trim", "speak", "helper"], "inherit": ["Base", "Speaker", "Other"], "type-ref": ["Speaker", "Main"]},
    ),
    "f.c": (
        '#include "speak.h"\n#include <stdio.h>\nstatic int add(int a, int b) { return a + b; }\nint later(int);\nint main(void) { int r = add(1, 2); p->run(r); if (r) greet(); return 0; }\n',
        {"definition": ["add", "main"], "import": ["speak.h", "stdio.h"], "call": ["add", "run", "greet"]},
    ),
    "g.cpp": (
        '#include "b.h"\nclass Base { public: virtual void run(); };\nstruct Child : public Base, ns::Other { void run() override { greet(); obj.call(1); } };\nint main() { Child c; c.run(); return add(1); }\n',
        {"definition": ["run", "main", "Base", "Child"], "import": ["b.h"], "call": ["greet", "call", "run", "add"], "inherit": ["Base", "ns::Other"]},
    ),
    "h.cs": (
        "using System;\nclass Main : Demo.Speaker, IFoo {\n  public void Run(Main s, int n) { Greet(s.Speak()); this.a.Go(); var x = new Foo(1); }\n  static int Greet(string x) => 1;\n}\n",
        {"definition": ["Main", "Run", "Greet"], "call": ["Greet", "Speak", "Go"], "inherit": ["Speaker", "IFoo"], "type-ref": ["Main"]},
    ),
    "i.php": (
        "<?php\nclass A extends B { public function run($x) { $this->go(); greet($x); $f(); $o->$m(); } }\nfunction greet($n) { return strlen($n); }\n",
        {"definition": ["A", "run", "greet"], "call": ["go", "greet", "f", "m", "strlen"], "inherit": ["B"]},
    ),
    "j.rb": (
        'class A < B\n  def run(x)\n    greet\n    obj.send(:foo)\n    puts "x"\n    helper(1)\n  end\n  def self.make; end\n  def greet; end\nend\n',
        {"definition": ["A", "run", "make", "greet"], "call": ["obj", "puts", "helper", "greet", "send"], "inherit": ["B"]},
    ),
    "k.sh": (
        '#!/bin/bash\nsource ./lib.sh\n. other.sh\ngreet() { echo "hi $1"; }\nfunction two { greet x | wc -l; }\nfor f in a b; do greet "$f"; done\nif [ -f x ]; then X=1 run y; fi\ncat <<EOF\nnot a command\nEOF\n',
        {"definition": ["greet", "two"], "import": ["./lib.sh", "other.sh"], "call": ["echo", "greet", "wc", "greet", "run", "cat"]},
    ),
    "l.hs": (
        'module Main where\nimport Data.List\ngreet :: String -> String\ngreet name = concat ["a", name]\nmain = putStrLn (greet "x")\n',
        {"definition": ["greet"], "call": ["concat", "putStrLn", "greet"]},
    ),
    "m.jl": ('function greet(x)\n  println(x)\n  Base.foo(x)\nend\ngreet("a")\n', {"definition": ["greet"], "call": ["println", "greet"]}),
    "n.scala": (
        'class Child(x: Int) extends Base(x) with T {\n  def run(a: Int): Int = greet(a)\n  def abs(a: Int): Int\n}\nobject Main { def main() { new Child(1).run(2); println("x") } }\n',
        {"definition": ["Child", "run", "Main", "main"], "call": ["greet", "run", "println"], "inherit": ["Base"]},
    ),
}


@pytest.mark.parametrize("path", CASES)
def test_relations_by_language(path):
    text, want = CASES[path]
    got = {}
    for row in raw_rows(path, text):
        got.setdefault(row[4], []).append(row[5])
    assert got == want


def test_places_and_confidence():
    rows = {(r[4], r[5]): r[7:] for r in raw_rows("src/a.ts", "export function a() {\n  return b(a())\n}\n")}
    assert rows == {("definition", "a"): ("exact", 1, 1), ("call", "b"): ("inferred", 2, 10), ("call", "a"): ("exact", 2, 12)}


def test_other_files_and_broken_sources():
    assert raw_rows("a.razor", "x") == [] and raw_rows("a.txt", "def f(): pass") == []
    assert raw_rows("a.py", "def (") == [("a.py", 1, 9, 0, "failed", "", None, None, 0, 0)]
    for path, (text, _) in CASES.items():
        for cut in range(0, len(text), 7):
            raw_rows(path, text[:cut])
    assert raw_rows("a.mjs", "export const a = () => b()\n")[0][5] == "a"


def test_extraction_of_a_table(spark):
    files = spark.createDataFrame([(p, t) for p, (t, _) in CASES.items()] + [("x.py", None)], "path string, text string")
    rows = extract_files(files).collect()
    assert len(rows) == sum(len(raw_rows(p, t)) for p, (t, _) in CASES.items())
