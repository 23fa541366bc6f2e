"""Extraction by file extension, and its use on tables of files.

To add a language, write a function from text to Relations and enter it here for its extensions.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

from ..model import EXTENSION_LANGUAGE, SCRIPT_EXTENSIONS
from . import languages, python, scripts
from .lexer import Relations

_BY_LANGUAGE: dict[str, Callable[[str], Relations]] = {
    "python": python.extract, "go": languages.go, "rust": languages.rust, "java": languages.java, "c": languages.c,
    "cpp": languages.cpp, "csharp": languages.csharp, "php": languages.php, "ruby": languages.ruby, "bash": languages.bash,
    "haskell": languages.haskell, "julia": languages.julia, "scala": languages.scala,
}
EXTRACTORS = {ext: _BY_LANGUAGE[name] for ext, name in EXTENSION_LANGUAGE.items() if name in _BY_LANGUAGE} | dict.fromkeys(SCRIPT_EXTENSIONS, scripts.extract)

RAW_SCHEMA = "file string, family int, section int, seq int, kind string, name string, child string, confidence string, line int, col int"
_COLUMNS = [x.split()[0] for x in RAW_SCHEMA.split(", ")]


def extension_of(path: str) -> str:
    base = path.rsplit("/", 1)[-1]
    return "." + base.rsplit(".", 1)[1].lower() if "." in base else ""


def raw_rows(path: str, text: str) -> list[tuple]:
    """Rows of RAW_SCHEMA in order of emission: definitions, imports, calls, inheritance, type references; and the methods
    of Go interfaces and types, from which implicit inheritance follows. One row of kind `failed` if a parser gives up."""
    ext = extension_of(path)
    extractor = EXTRACTORS.get(ext)
    if extractor is None:
        return []
    family = 0 if ext in SCRIPT_EXTENSIONS else 1
    try:
        found = extractor(text)
    except (SyntaxError, ValueError, IndexError, KeyError, RecursionError, StopIteration):
        return [(path, family, 9, 0, "failed", "", None, None, 0, 0)]
    own = {name for name, *_ in found.symbols}
    rows = [(0, "definition", name, None, "exact", line, col) for name, line, col in found.symbols]
    rows += [(1, "import", name, None, "exact", line, col) for name, line, col in found.imports]
    rows += [(2, "call", name, None, "exact" if name in own else "inferred", line, col) for name, line, col in found.calls]
    rows += [(3, "inherit", parent, child, confidence, line, col) for child, parent, line, col, confidence in found.inherits]
    if not family:
        rows = [r for r in rows if r[0] < 3]
    else:
        rows += [(5, "type-ref", name, None, "exact", line, col) for name, line, col in found.type_refs if name in own]
        rows += [(6, "interface-method", method, iface, None, 0, 0) for iface, method in found.interface_methods if method]
        rows += [(7, "type-method", method, kind, None, line, col) for kind, method, line, col in found.type_methods]
    return [(path, family, section, i, kind, name, child, confidence, line, col) for i, (section, kind, name, child, confidence, line, col) in enumerate(rows)]


def extract_files(files: DataFrame) -> DataFrame:
    """Raw relations of files (path, text), a table function of each file on its own."""

    def run(batches):
        for pdf in batches:
            rows = [row for path, text in zip(pdf["path"], pdf["text"], strict=True) for row in raw_rows(path, text or "")]
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return files.select("path", "text").mapInPandas(run, RAW_SCHEMA)
