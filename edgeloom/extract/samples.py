"""Small sources in each language, one for each document, and the relations that they hold.

`@` stands for the document's number. Expected are (kind, name, line, confidence), written down from the languages' rules:
a call is exact if the file defines its name, a reference to a type counts if the file defines it, imports are as written.
"""

from __future__ import annotations

SAMPLES: dict[str, tuple[str, str, list[tuple[str, str, int, str]]]] = {
    "typescript": (
        ".ts",
        "import { g } from './g@';\nexport function f@(x: number) { return h@(x) + f@(x); }\nclass C@ { run() { this.go@(); } }\ninterface I@ { a: string }\nexport const v@ = 1;\nnew D@();\n",
        [("import", "./g@", 1, "exact"), ("definition", "f@", 2, "exact"), ("call", "h@", 2, "inferred"), ("call", "f@", 2, "exact"), ("definition", "C@", 3, "exact"),
         ("definition", "C@.run", 3, "exact"), ("call", "go@", 3, "inferred"), ("definition", "I@", 4, "exact"), ("definition", "v@", 5, "exact")],
    ),
    "javascript": (
        ".js",
        "// call@()\nexport { x } from './x@';\nexport const a@ = () => b@('c@()');\nfunction inner@() {\n  a@();\n}\n",
        [("import", "./x@", 2, "exact"), ("definition", "a@", 3, "exact"), ("call", "b@", 3, "inferred"), ("definition", "inner@", 4, "exact"), ("call", "a@", 5, "exact")],
    ),
    "python": (
        ".py",
        "import m@\nclass A@(B@):\n    def f@(self, x: A@):\n        return g@(x.h@())\nf@()  # k@()\n",
        [("import", "m@", 1, "exact"), ("definition", "A@", 2, "exact"), ("inherit", "B@", 2, "exact"), ("definition", "f@", 3, "exact"), ("type-ref", "A@", 3, "exact"),
         ("call", "g@", 4, "inferred"), ("call", "h@", 4, "inferred"), ("call", "f@", 5, "exact")],
    ),
    "go": (
        ".go",
        'package p\n\nimport "fmt@"\n\ntype S@ struct{}\n\nfunc F@(x S@) {\n\tfmt.Print@(x)\n\tF@(x)\n}\n',
        [("import", "fmt@", 3, "exact"), ("definition", "S@", 5, "exact"), ("definition", "F@", 7, "exact"), ("type-ref", "S@", 7, "exact"), ("call", "Print@", 8, "inferred"), ("call", "F@", 9, "exact")],
    ),
    "rust": (
        ".rs",
        "mod m@;\nstruct S@;\ntrait T@ { fn t@(&self); }\nimpl T@ for S@ {\n    fn r@(&self) { g@(); }\n}\nfn f@() { f@() }\n",
        [("import", "m@", 1, "exact"), ("definition", "S@", 2, "exact"), ("definition", "T@", 3, "exact"), ("inherit", "T@", 4, "exact"), ("definition", "r@", 5, "exact"),
         ("call", "g@", 5, "inferred"), ("definition", "f@", 7, "exact"), ("call", "f@", 7, "exact")],
    ),
    "java": (
        ".java",
        "import a.b.K@;\nclass A@ extends B@ implements I@ {\n  void m@(A@ x) { n@(x); m@(x); }\n}\n",
        [("import", "a.b.K@", 1, "exact"), ("definition", "A@", 2, "exact"), ("inherit", "B@", 2, "exact"), ("inherit", "I@", 2, "exact"), ("definition", "m@", 3, "exact"), ("type-ref", "A@", 3, "exact"),
         ("call", "n@", 3, "inferred"), ("call", "m@", 3, "exact")],
    ),
    "c": (
        ".c",
        '#include "h@.h"\nint f@(int x) {\n  return g@(x) + f@(x); /* k@() */\n}\n',
        [("import", "h@.h", 1, "exact"), ("definition", "f@", 2, "exact"), ("call", "g@", 3, "inferred"), ("call", "f@", 3, "exact")],
    ),
    "cpp": (
        ".cpp",
        '#include "h@.h"\nclass A@ : public B@ {};\nint f@() {\n  return o.m@() + f@();\n}\n',
        [("import", "h@.h", 1, "exact"), ("definition", "A@", 2, "exact"), ("inherit", "B@", 2, "exact"), ("definition", "f@", 3, "exact"), ("call", "m@", 4, "inferred"), ("call", "f@", 4, "exact")],
    ),
    "csharp": (
        ".cs",
        "interface I@ {}\nclass A@ : I@ {\n  void M@(A@ x) { N@(x); M@(x); }\n}\n",
        [("definition", "I@", 1, "exact"), ("definition", "A@", 2, "exact"), ("inherit", "I@", 2, "exact"), ("type-ref", "I@", 2, "exact"), ("definition", "M@", 3, "exact"), ("type-ref", "A@", 3, "exact"),
         ("call", "N@", 3, "inferred"), ("call", "M@", 3, "exact")],
    ),
    "php": (
        ".php",
        "<?php\nclass A@ extends B@ {\n  function m@() { $this->n@(); }\n}\nfunction f@() { g@(); f@(); }\n",
        [("definition", "A@", 2, "exact"), ("inherit", "B@", 2, "exact"), ("definition", "m@", 3, "exact"), ("call", "n@", 3, "inferred"), ("definition", "f@", 5, "exact"), ("call", "g@", 5, "inferred"), ("call", "f@", 5, "exact")],
    ),
    "ruby": (
        ".rb",
        "class A@ < B@\n  def m@(x)\n    g@(x)\n    m@(x)\n  end\nend\n",
        [("definition", "A@", 1, "exact"), ("inherit", "B@", 1, "exact"), ("definition", "m@", 2, "exact"), ("call", "g@", 3, "inferred"), ("call", "m@", 4, "exact")],
    ),
    "bash": (
        ".sh",
        "source lib@.sh\nf@() {\n  g@ x\n}\nf@\n",
        [("import", "lib@.sh", 1, "exact"), ("definition", "f@", 2, "exact"), ("call", "g@", 3, "inferred"), ("call", "f@", 5, "exact")],
    ),
    "haskell": (
        ".hs",
        "f@ x = g@ x\nh@ y = f@ y\n",
        [("definition", "f@", 1, "exact"), ("call", "g@", 1, "inferred"), ("definition", "h@", 2, "exact"), ("call", "f@", 2, "exact")],
    ),
    "julia": (
        ".jl",
        "function f@(x)\n  g@(x)\nend\n",
        [("definition", "f@", 1, "exact"), ("call", "g@", 2, "inferred")],
    ),
    "scala": (
        ".scala",
        "trait T@\nclass A@ extends T@ {\n  def m@(x: Int) = n@(x)\n  def k@(x: Int) = m@(x)\n}\n",
        [("definition", "T@", 1, "exact"), ("definition", "A@", 2, "exact"), ("inherit", "T@", 2, "exact"), ("definition", "m@", 3, "exact"), ("call", "n@", 3, "inferred"), ("definition", "k@", 4, "exact"), ("call", "m@", 4, "exact")],
    ),
}
