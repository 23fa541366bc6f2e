"""Relations of Python, from its own parser."""

from __future__ import annotations

import ast
import warnings

from .lexer import Relations


def _annotation_names(node: ast.expr | None):
    """Plain names of an annotation, its arguments included."""
    if isinstance(node, ast.Name):
        yield node
    elif isinstance(node, ast.Subscript):
        inner = node.slice.elts if isinstance(node.slice, ast.Tuple) else [node.slice]
        for x in inner:
            yield from _annotation_names(x)


def extract(text: str) -> Relations:
    out = Relations()
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(text.lstrip("﻿"))
    lines = text.split("\n")

    def place(node) -> tuple[int, int]:
        raw = lines[node.lineno - 1].encode()[: node.col_offset] if node.lineno <= len(lines) else b""
        return node.lineno, len(raw.decode("utf-8", "replace")) + 1

    calls, symbols, imports, inherits, refs = [], [], [], [], []
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            symbols.append((place(node), node.name))
        if isinstance(node, ast.ClassDef):
            for k, base in enumerate(node.bases):
                if isinstance(base, ast.Name | ast.Attribute):
                    inherits.append((place(node), k, node.name, ast.unparse(base)))
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name | ast.Attribute):
            name = node.func.id if isinstance(node.func, ast.Name) else node.func.attr
            calls.append((place(node), (-node.end_lineno, -node.end_col_offset), name))
        elif isinstance(node, ast.Import):
            plain = [a.name for a in node.names if not a.asname]
            if plain:
                imports.append((place(node), plain[0]))
        elif isinstance(node, ast.ImportFrom):
            imports.append((place(node), "." * node.level + (node.module or "")))
        notes = []
        if isinstance(node, ast.arg | ast.AnnAssign):
            notes.append(node.annotation)
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            notes.append(node.returns)
        for note in notes:
            refs += [(place(n), n.id) for n in _annotation_names(note)]
    out.symbols = [(name, *at) for at, name in sorted(symbols)]
    out.imports = [(name, *at) for at, name in sorted(imports)]
    out.calls = [(name, *at) for at, _, name in sorted(calls)]
    out.inherits = [(child, parent, *at, "exact") for at, _, child, parent in sorted(inherits)]
    out.type_refs = [(name, *at) for at, name in sorted(refs)]
    return out
