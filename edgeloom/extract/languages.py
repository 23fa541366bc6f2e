"""Relations of the other languages, by rules on tokens.

Definitions are taken at any depth and by bare name. A call's place is the start of its expression; `first` languages
name a call of a member chain by the chain's first member (a.b.c() is b), the others by the last.
"""

from __future__ import annotations

import re

from .lexer import Relations, Source, Syntax, in_order

_CONTROL = {"if", "for", "while", "switch", "catch", "return", "sizeof", "else", "do", "case", "match", "when", "foreach", "using", "lock", "synchronized", "try", "throw", "new", "elseif", "fixed"}


def _calls(s: Source, links=(".",), skip=frozenset(), first=False, generics=False) -> list[tuple[int, int, str, int, int]]:
    """(start, end, name, line, col) of names before brackets. skip: tokens (indices) that are declarations."""
    out = []
    for i, t in enumerate(s.tokens):
        j = s.after_angles(i + 1) if generics else i + 1
        if t.kind != "id" or i in skip or not s.is_op(j, "(") or j not in s.match:
            continue
        member = s.is_op(i - 1, *links)
        if not member and t.text in _CONTROL:
            continue
        start = s.chain_start(i, links)
        name = t.text
        if first and member:
            name = next((s.tokens[k + 1].text for k in range(start, i) if s.is_op(k, *links) and s.is_id(k + 1)), name)
        out.append((s.tokens[start].at, s.tokens[s.match[j]].at, name, s.tokens[start].line, s.tokens[start].col))
    return out


def _statement_start(s: Source, i: int) -> int:
    """The first token of the declaration that holds token i: after the last bracket, brace or semicolon."""
    while i > 0 and not s.is_op(i - 1, ";", "{", "}") and not (s.is_op(i - 1, ")") and s.tokens[i - 1].line < s.tokens[i].line):
        i -= 1
    return i


def _header_end(s: Source, i: int) -> int:
    """The opening brace or semicolon that ends a declaration's header."""
    while i < len(s.tokens) and not s.is_op(i, "{", ";"):
        i = s.match[i] + 1 if s.is_op(i, "(", "[") and i in s.match else i + 1
    return i


def _names(s: Source, a: int, b: int) -> list:
    """Identifiers between two tokens, the last of each dotted name, without type arguments."""
    out, depth = [], 0
    for k in range(a, b):
        t = s.tokens[k]
        if t.text == "<":
            depth += 1
        elif t.text == ">":
            depth -= 1
        elif t.kind == "id" and not depth and not s.is_op(k + 1, ".", "::", "\\"):
            out.append(t)
    return out


# --- Go

_GO = Syntax(quotes="\"'", raw="`")


def go(text: str) -> Relations:
    s, out, skip = Source(text, _GO), Relations(), set()
    tk = s.tokens
    i = 0
    while i < len(tk):
        t = tk[i]
        if t.kind == "id" and t.text == "func" and not s.is_op(i - 1, "."):
            j, receiver = i + 1, None
            if s.is_op(j, "(") and j in s.match and s.is_id(s.match[j] + 1) and s.is_op(s.match[j] + 2, "(", "["):
                inner = [x for x in tk[j + 1 : s.match[j]] if x.kind == "id"]
                receiver = inner[1] if len(inner) > 1 else inner[0] if inner else None
                params = (j, s.match[j])
                _go_parameters(s, *params, out)
                j = s.match[j] + 1
            if s.is_id(j):
                out.symbols.append((tk[j].text, t.line, t.col))
                skip.add(j)
                if receiver:
                    out.type_methods.append((receiver.text, tk[j].text, t.line, t.col))
                j += 1
            if s.is_op(j, "[") and j in s.match:
                j = s.match[j] + 1
            if s.is_op(j, "(") and j in s.match:
                _go_parameters(s, j, s.match[j], out)
                if s.is_op(s.match[j] + 1, "(") and s.match[j] + 1 in s.match:
                    _go_parameters(s, s.match[j] + 1, s.match[s.match[j] + 1], out)
        elif t.kind == "id" and t.text == "type" and (s.is_id(i + 1) or s.is_op(i + 1, "(")):
            j = i + 1 if s.is_id(i + 1) else i + 2
            if s.is_id(j) and not s.is_op(j + 1, "="):
                name, k = tk[j].text, j + 1
                if s.is_op(k, "[") and k in s.match and s.is_id(k + 1):
                    k = s.match[k] + 1
                out.symbols.append((name, t.line, t.col))
                if s.is_id(k, "interface") and s.is_op(k + 1, "{") and k + 1 in s.match:
                    k += 2
                    out.interface_methods.append((name, ""))
                    while k < s.match[k - 1] if s.is_op(k - 1, "{") else not s.is_op(k, "}"):
                        if s.is_id(k) and s.is_op(k + 1, "("):
                            out.interface_methods.append((name, tk[k].text))
                            skip.add(k)
                            _go_parameters(s, k + 1, s.match.get(k + 1, k + 1), out)
                            line = tk[k].line
                            k = s.match.get(k + 1, k + 1) + 1
                            while not s.is_op(k, "}") and k < len(tk) and tk[k].line == line and not s.is_op(k, ";"):
                                k = s.match[k] + 1 if s.is_op(k, "(", "{", "[") and k in s.match else k + 1
                        elif s.is_id(k) and not s.is_op(k + 1, ".") and not s.is_op(k - 1, "."):
                            out.inherits.append((name, tk[k].text, t.line, t.col, "exact"))
                            k += 1
                        else:
                            k += 1
                        if k >= len(tk):
                            break
        elif t.kind == "id" and t.text == "import" and not s.is_op(i - 1, "."):
            j = i + 1
            end = s.match.get(j, j) if s.is_op(j, "(") else j + 2
            first = None
            for k in range(j, min(end + 1, len(tk))):
                if tk[k].kind == "id" or s.is_op(k, "."):
                    first = first or tk[k]
                elif tk[k].kind == "str":
                    at = first or tk[k]
                    out.imports.append((tk[k].value, at.line, at.col))
                    first = None
                    if not s.is_op(j, "("):
                        break
        i += 1
    out.calls = in_order([c for c in _calls(s, (".",), skip, first=True) if c[2] not in ("func", "import", "var", "const", "type")])
    return out


def _go_parameters(s: Source, a: int, b: int, out: Relations) -> None:
    """Plain type names of a parameter list."""
    k = a + 1
    group: list = []
    while k <= b:
        if k == b or s.is_op(k, ","):
            ids = [x for x in group if x.kind == "id"]
            if len(ids) == 2 and len(group) == 2:
                out.type_refs.append((ids[1].text, ids[0].line, ids[0].col))
            elif len(ids) == 1 and len(group) == 1 and k == b and a + 2 == b:
                out.type_refs.append((ids[0].text, ids[0].line, ids[0].col))
            group = []
        else:
            group.append(s.tokens[k])
            if s.is_op(k, "(", "[", "{") and k in s.match:
                k = s.match[k]
        k += 1


# --- Rust

_RUST = Syntax(quotes='"')
_RUST_TYPES = re.compile(r"[A-Z]\w*$")


def rust(text: str) -> Relations:
    text = re.sub(r"'(\\.|[^\\'])'", lambda m: " " * len(m[0]), text)  # characters; lifetimes stay
    s, out, skip = Source(text, _RUST), Relations(), set()
    tk = s.tokens
    for i, t in enumerate(tk):
        if t.kind != "id":
            continue
        if t.text in ("fn", "struct", "enum", "trait", "mod") and s.is_id(i + 1) and not s.is_op(i - 1, "."):
            first = i
            while first and (s.is_id(first - 1, "pub", "async", "unsafe", "const", "extern", "default") or s.is_op(first - 1, ")") and s.is_op(s.match.get(first - 1, 0) if first - 1 in s.match else 0, "(") and s.is_id(s.match.get(first - 1, 0) - 1, "pub")):
                first = s.match[first - 1] - 1 if s.is_op(first - 1, ")") else first - 1
            at, name = tk[first], tk[i + 1].text
            if t.text == "mod":
                out.imports.append((name, at.line, at.col))
                continue
            body = t.text != "fn" or s.is_op(_header_end(s, i), "{")
            if body:  # a signature in a trait is no item with a body
                out.symbols.append((name, at.line, at.col))
            skip.add(i + 1)
        elif t.text == "impl":
            end = _header_end(s, i)
            j = s.after_angles(i + 1)
            cut = next((k for k in range(j, end) if s.is_id(k, "for")), None)
            where = next((k for k in range(j, end) if s.is_id(k, "where")), end)
            if cut:
                before, after = _plain_type(s, j, cut), _plain_type(s, cut + 1, where)
                if before and after:
                    out.inherits.append((after, before, t.line, t.col, "exact"))
    # Types inside references, pointers, `dyn` and type arguments; each wrapper repeats what it holds.
    refs = []
    for i, t in enumerate(tk):
        wraps = []
        if s.is_op(i, "&") and (s.is_id(i + 1, "dyn", "mut") or s.is_id(i + 1) and _RUST_TYPES.match(tk[i + 1].text)):
            j = i + 1
            while s.is_id(j, "mut"):
                j += 1
            if s.is_id(j, "dyn") or s.is_id(j) and _RUST_TYPES.match(tk[j].text):
                wraps.append((i, j))
        elif s.is_id(i, "dyn"):
            wraps.append((i, i + 1))
        elif s.is_id(i) and _RUST_TYPES.match(t.text) and s.is_op(i + 1, "<") and s.after_angles(i + 1) > i + 1 and not s.is_id(i - 1, "struct", "enum", "trait"):
            wraps.append((i, i))
        for at, j in wraps:
            if s.is_id(j, "dyn"):
                j += 1
            if not s.is_id(j):
                continue
            while s.is_op(j + 1, "::") and s.is_id(j + 2):
                j += 2
            end = s.after_angles(j + 1)
            for k in range(j, max(end, j + 1)):
                if s.is_id(k) and _RUST_TYPES.match(tk[k].text):
                    refs.append((tk[at].at, tk[k].text, tk[at].line, tk[at].col))
    out.type_refs = [(name, line, col) for _, name, line, col in sorted(refs, key=lambda r: r[0])]
    found = [c for c in _calls(s, (".",), skip, first=True, generics=False)]
    macro = {s.tokens[i].at for i in range(len(tk)) if s.is_id(i) and s.is_op(i + 1, "!")}
    scoped = {s.tokens[i].at for i in range(1, len(tk)) if s.is_id(i) and s.is_op(i - 1, "::")}
    out.calls = in_order([c for c in found if c[0] not in macro and c[0] not in scoped and c[2] != "fn"])
    return out


def _plain_type(s: Source, a: int, b: int) -> str | None:
    """The name of a type that is a single identifier."""
    return s.tokens[a].text if b == a + 1 and s.is_id(a) else None


# --- Java

_JAVA = Syntax(triple=True)


def java(text: str) -> Relations:
    s, out, skip = Source(text, _JAVA), Relations(), set()
    tk = s.tokens
    for i, t in enumerate(tk):
        if t.kind != "id":
            continue
        if t.text in ("class", "interface") and s.is_id(i + 1) and not s.is_op(i - 1, ".", "@"):
            at, name, end = tk[_statement_start(s, i)], tk[i + 1].text, _header_end(s, i)
            out.symbols.append((name, at.line, at.col))
            ext = next((k for k in range(i, end) if s.is_id(k, "extends")), None)
            imp = next((k for k in range(i, end) if s.is_id(k, "implements")), None)
            if ext and t.text == "class":
                parents = _names(s, ext + 1, imp or end)
                out.inherits += [(name, p.text, at.line, at.col, "exact") for p in parents[:1]]
            if imp:
                out.inherits += [(name, x.text, at.line, at.col, "exact") for x in tk[imp + 1 : end] if x.kind == "id"]
        elif t.text == "import" and not s.is_op(i - 1, "."):
            end = next((k for k in range(i, len(tk)) if s.is_op(k, ";")), len(tk) - 1)
            out.imports.append((s.text[t.at + 6 : tk[end].at].strip(), t.line, t.col))
        elif s.is_op(i + 1, "(") and i + 1 in s.match and not s.is_op(i - 1, ".") and (s.is_id(i - 1) and tk[i - 1].text not in ("new", "return", "else", "throw", "case", "assert", "public", "private", "protected") or s.is_op(i - 1, ">", "]")):
            closed = s.match[i + 1]
            k = closed + 1
            while s.is_id(k, "throws") or s.is_id(k - 1, "throws") or s.is_id(k) and s.is_op(k - 1, ",") or s.is_op(k, ",") and closed + 1 < k:
                k += 1
            if s.is_op(k, "{", ";") and t.text not in _CONTROL:
                at = tk[_statement_start(s, i)]
                out.symbols.append((t.text, at.line, at.col))
                skip.add(i)
                _parameters(s, i + 1, closed, out)
        elif s.is_op(i + 1, "(") and i + 1 in s.match and s.is_op(s.match[i + 1] + 1, "{") and t.text not in _CONTROL and not s.is_op(i - 1, ".") and not s.is_id(i - 1, "new"):
            skip.add(i)  # a constructor
            _parameters(s, i + 1, s.match[i + 1], out)
    new = {i for i in range(1, len(tk)) if _after_new(s, i) or s.is_id(i, "super", "this") and not s.is_op(i - 1, ".")}
    out.calls = in_order(_calls(s, (".",), skip | new))
    return out


def _after_new(s: Source, i: int) -> bool:
    """Whether the name at i is the type of a `new` expression."""
    while s.is_op(i - 1, ".") and s.is_id(i - 2):
        i -= 2
    return s.is_id(i - 1, "new")


def _parameters(s: Source, a: int, b: int, out: Relations) -> None:
    """Type names of `Type name` parameters, those in type arguments too."""
    k = a + 1
    begin = k
    while k <= b:
        if k == b or s.is_op(k, ","):
            ids = [x for x in s.tokens[begin:k] if x.kind == "id" and x.text not in ("final", "int", "long", "double", "float", "boolean", "char", "byte", "short", "void")]
            if k > begin:
                at = s.tokens[begin]
                names = ids[:-1] if ids and ids[-1] is s.tokens[k - 1] else ids
                out.type_refs += [(x.text, at.line, at.col) for x in names if x.text[:1].isupper()]
            begin = k + 1
        elif s.is_op(k, "<"):
            k = max(k, s.after_angles(k) - 1)
        elif s.is_op(k, "(", "[", "{") and k in s.match:
            k = s.match[k]
        k += 1


# --- C and C++


def _include(text: str, s: Source, out: Relations) -> None:
    for m in re.finditer(r"^[ \t]*#[ \t]*include[ \t]*([\"<])([^\">\n]+)[\">]", text, re.MULTILINE):
        at = m.start() + len(m[0]) - len(m[0].lstrip())
        out.imports.append((m[2], *s.place(at)))


def _c_family(text: str) -> tuple[Source, Relations, set[int]]:
    bare = re.sub(r"^[ \t]*#[^\n]*", lambda m: " " * len(m[0]), text, flags=re.MULTILINE)
    s, out, skip = Source(bare, Syntax()), Relations(), set()
    _include(text, s, out)
    for i, t in enumerate(s.tokens):
        if t.kind != "id" or t.text in _CONTROL or not s.is_op(i + 1, "(") or i + 1 not in s.match:
            continue
        k = s.match[i + 1] + 1
        while s.is_id(k, "const", "noexcept", "override", "final"):
            k += 1
        start = _statement_start(s, i)
        while start < i and (s.is_id(start, "public", "private", "protected") and s.is_op(start + 1, ":")):
            start += 2
        typed = start < i and all(s.tokens[x].kind == "id" or s.is_op(x, "*", "&", "::", "<", ">", ",", "~") for x in range(start, i)) and not s.is_id(start, "return", "else", "throw", "delete")
        if typed and s.is_op(k, ";", "=") and not s.is_op(i - 1, "::"):
            skip.add(i)  # a declaration
        if typed and s.is_op(k, "{"):
            at = s.tokens[start]
            out.symbols.append((t.text, at.line, at.col))
            skip.add(i)
    return s, out, skip


def c(text: str) -> Relations:
    s, out, skip = _c_family(text)
    out.calls = in_order(_calls(s, (".", "->"), skip, first=True))
    return out


def cpp(text: str) -> Relations:
    s, out, skip = _c_family(text)
    for i, t in enumerate(s.tokens):
        if t.kind == "id" and t.text in ("class", "struct") and s.is_id(i + 1) and not s.is_id(i - 1, "enum") and not s.is_op(i - 1, "<", ","):
            end = i + 2
            while end < len(s.tokens) and not s.is_op(end, "{", ";", "(", ")", "=", "*", "&"):
                end += 1
            if not (s.is_op(end, "{", ";") and (s.is_op(end, "{") or end == i + 2)):
                continue
            name = s.tokens[i + 1].text
            out.symbols.append((name, t.line, t.col))
            colon = next((k for k in range(i + 2, end) if s.is_op(k, ":")), None)
            if colon:
                begin = colon + 1
                for k in range(colon + 1, end + 1):
                    if k == end or s.is_op(k, ","):
                        words = [x.text for x in s.tokens[begin:k] if not (x.kind == "id" and x.text in ("public", "private", "protected", "virtual"))]
                        if words and "<" not in words:
                            out.inherits.append((name, "".join(words), t.line, t.col, "exact"))
                        begin = k + 1
    new = {i for i in range(1, len(s.tokens)) if s.is_id(i - 1, "new")}
    scoped = {i for i in range(1, len(s.tokens)) if s.is_op(i - 1, "::")}
    out.calls = in_order(_calls(s, (".", "->"), skip | new | scoped, first=True))
    return out


# --- C#


def csharp(text: str) -> Relations:
    s, out, skip = Source(text, Syntax()), Relations(), set()
    tk, refs = s.tokens, []
    for i, t in enumerate(tk):
        if t.kind != "id":
            continue
        if t.text in ("class", "interface", "struct") and s.is_id(i + 1) and not s.is_op(i - 1, ":", ","):
            at, name, end = tk[_statement_start(s, i)], tk[i + 1].text, _header_end(s, i)
            out.symbols.append((name, at.line, at.col))
            where = next((k for k in range(i, end) if s.is_id(k, "where")), end)
            colon = next((k for k in range(i, where) if s.is_op(k, ":")), None)
            begin = colon + 1 if colon else where
            for k in range(begin, where + 1):
                if colon and (k == where or s.is_op(k, ",")):
                    part = tk[begin:k]
                    if part and all(x.kind == "id" or x.text == "." for x in part):
                        out.inherits.append((name, part[-1].text, at.line, at.col, "exact"))
                        refs.append((at.at, part[-1].text, at.line, at.col))
                    begin = k + 1
        elif s.is_op(i + 1, "(") and i + 1 in s.match and not s.is_op(i - 1, ".") and t.text not in _CONTROL:
            closed = s.match[i + 1]
            typed = s.is_id(i - 1) and tk[i - 1].text not in ("new", "return", "else", "throw", "await", "in", "is", "as") or s.is_op(i - 1, ">", "]", "?")
            opens = s.is_op(closed + 1, "{", "=>", ";") or s.is_id(closed + 1, "where")
            if typed and opens:
                at = tk[_statement_start(s, i)]
                out.symbols.append((t.text, at.line, at.col))
            if typed and opens or s.is_op(closed + 1, "{", ":") and not s.is_id(i - 1, "new") and not s.is_op(i - 1, "=", "(", ","):
                skip.add(i)
                begin = i + 2
                for k in range(i + 2, closed + 1):
                    if k == closed or s.is_op(k, ","):
                        ids = [x for x in tk[begin:k] if x.kind == "id" and x.text not in ("ref", "out", "in", "params", "this")]
                        if len(ids) >= 2 and ids[0].text not in ("int", "long", "string", "bool", "double", "float", "char", "byte", "object", "decimal", "short", "uint", "ulong"):
                            kind = ids[-2].text if s.is_op(begin + 1, ".") else ids[0].text
                            refs.append((tk[begin].at, kind, tk[begin].line, tk[begin].col))
                        begin = k + 1
    new = {i for i in range(1, len(tk)) if _after_new(s, i)}
    out.calls = in_order(_calls(s, (".", "?."), skip | new, generics=True))
    out.type_refs = [(name, line, col) for _, name, line, col in sorted(refs, key=lambda r: r[0])]
    return out


# --- PHP

_PHP = Syntax(line=("//", "#"), words=r"\$?[A-Za-z_\u0080-￿][\w\u0080-￿]*")


def php(text: str) -> Relations:
    s, out, skip = Source(text, _PHP), Relations(), set()
    tk = s.tokens
    for i, t in enumerate(tk):
        if t.kind != "id":
            continue
        if t.text == "function" and s.is_id(i + 1):
            first = i
            while s.is_id(first - 1, "public", "private", "protected", "static", "abstract", "final"):
                first -= 1
            out.symbols.append((tk[i + 1].text, tk[first].line, tk[first].col))
            skip.add(i + 1)
        elif t.text == "class" and s.is_id(i + 1) and not s.is_op(i - 1, "::"):
            first = i
            while s.is_id(first - 1, "abstract", "final", "readonly"):
                first -= 1
            at = tk[first]
            out.symbols.append((tk[i + 1].text, at.line, at.col))
            if s.is_id(i + 2, "extends") and s.is_id(i + 3):
                out.inherits.append((tk[i + 1].text, tk[i + 3].text, at.line, at.col, "exact"))
    skip |= {i for i in range(1, len(tk)) if _after_new(s, i) or s.is_op(i - 1, "::") or s.is_id(i, "function", "fn", "array", "list", "isset", "unset", "empty", "echo", "print", "exit", "die")}
    found = _calls(s, ("->", "?->"), skip)
    out.calls = in_order([(a, b, name.removeprefix("$"), line, col) for a, b, name, line, col in found])
    return out


# --- Ruby

_RUBY = Syntax(line=("#",), block=(("=begin", "=end"),), words=r"[A-Za-z_\u0080-￿][\w\u0080-￿]*[?!]?")


def ruby(text: str) -> Relations:
    s, out, skip = Source(text, _RUBY), Relations(), set()
    tk = s.tokens
    own: set[tuple[str, int]] = set()
    for i, t in enumerate(tk):
        if t.kind != "id" or s.is_op(i - 1, "."):
            continue
        if t.text == "def":
            j = i + 3 if s.is_id(i + 1) and s.is_op(i + 2, ".") else i + 1
            if s.is_id(j):
                out.symbols.append((tk[j].text, t.line, t.col))
                own.add((tk[j].text, t.line))
                skip |= set(range(i + 1, j + 1))
        elif t.text == "class" and s.is_id(i + 1):
            out.symbols.append((tk[i + 1].text, t.line, t.col))
            if s.is_op(i + 2, "<") and s.is_id(i + 3):
                out.inherits.append((tk[i + 1].text, tk[i + 3].text, t.line, t.col, "exact"))
    words = {"def", "class", "end", "if", "unless", "while", "until", "return", "puts_", "then", "do", "else", "elsif", "case", "when", "and", "or", "not", "module", "begin", "rescue", "ensure", "self", "nil", "true", "false", "yield", "super"}
    found = []
    for i, t in enumerate(tk):
        if t.kind != "id" or i in skip or t.text in words:
            continue
        lower = t.text[0].islower() or t.text[0] == "_"
        member = s.is_op(i - 1, ".", "?.")
        argument = i + 1 < len(tk) and tk[i + 1].line == t.line and (tk[i + 1].kind in ("str", "num") or tk[i + 1].kind == "id" and tk[i + 1].text not in words or s.is_op(i + 1, ":"))
        if lower and (member or s.is_op(i + 1, "(") and i + 1 in s.match or argument):
            start = s.chain_start(i, (".", "?."))
            name = t.text
            if member:  # the first plain name of the expression
                name = next((tk[k].text for k in (start, i) if tk[k].kind == "id" and tk[k].text[0].islower() and tk[k].text not in words), t.text)
            end = s.tokens[s.match[i + 1]].at if s.is_op(i + 1, "(") and i + 1 in s.match else t.at + len(t.text)
            found.append((tk[start].at, end, name, tk[start].line, tk[start].col))
    out.calls = in_order(found)
    known = {name for name, *_ in out.symbols} | {"send", "public_send", "method_missing"}
    seen = set(out.calls)
    for i, t in enumerate(tk):  # bare names of methods
        call = (t.text, t.line, t.col)
        if t.kind == "id" and i not in skip and t.text in known and t.text[0].islower() and (t.text, t.line) not in own and call not in seen:
            seen.add(call)
            out.calls.append(call)
    return out


# --- Bash


_BASH_WORD = re.compile(r"""(?:[^\s;&|()<>"'$`\\]|\\.|"(?:[^"\\]|\\.)*"|'[^']*'|\$\{[^}]*\}|\$\w+|\$[@*#?!$-])+""")
_BASH_KEYWORDS = {"if", "then", "else", "elif", "fi", "for", "while", "until", "do", "done", "case", "esac", "in", "function", "{", "}", "!", "time", "select", "[[", "]]"}
_BASH_DECLARE = {"export", "local", "declare", "readonly", "typeset", "unset"}


def bash(text: str) -> Relations:
    out = Relations()
    pending: str | None = None  # the end of a here-document
    for number, raw in enumerate(text.split("\n"), 1):
        if pending is not None:
            if raw.strip() == pending:
                pending = None
            continue
        i, start, data = 0, True, False
        while i < len(raw):
            ch = raw[i]
            if ch in " \t\r":
                i += 1
                continue
            if ch == "#" and (i == 0 or raw[i - 1] in " \t;&|"):
                break
            if raw.startswith("<<", i) and not raw.startswith("<<<", i):
                m = re.match(r"<<-?\s*['\"]?(\w+)", raw[i:])
                if m:
                    pending = m[1]
                    i += len(m[0])
                    continue
            if ch in ";&|(`" or raw.startswith("$(", i):
                i += 2 if raw.startswith(("$(", "&&", "||", ";;"), i) else 1
                start, data = True, False
                continue
            if ch in ")<>\"'$\\" and not _BASH_WORD.match(raw, i):
                i += 1
                continue
            if ch in "<>":
                i += 1
                m = re.match(r"[&>]*\s*\S+", raw[i:])
                i += len(m[0]) if m else 0
                continue
            m = _BASH_WORD.match(raw, i)
            if not m:
                i += 1
                continue
            word, at, i = m[0], i + 1, m.end()
            if data or not start:
                continue
            func = re.match(r"\s*\(\s*\)", raw[i:])
            if func:
                out.symbols.append((word, number, at))
                i += len(func[0])
                continue
            if word == "function":
                m = _BASH_WORD.match(raw, i + len(raw[i:]) - len(raw[i:].lstrip()))
                if m:
                    out.symbols.append((m[0], number, at))
                    i = m.end()
                    func = re.match(r"\s*\(\s*\)", raw[i:])
                    i += len(func[0]) if func else 0
                continue
            if word in ("for", "case", "select"):
                data = True
                continue
            if word in _BASH_KEYWORDS:
                continue
            if re.match(r"[A-Za-z_]\w*\+?=", word):
                continue
            start = False
            if word in _BASH_DECLARE or word in ("[", "[["):
                continue
            if word in ("source", "."):
                m = re.match(r"\s+", raw[i:])
                n = _BASH_WORD.match(raw, i + len(m[0])) if m else None
                if n and n[0][0] not in "\"'$":
                    out.imports.append((n[0], number, at))
                continue
            out.calls.append((word, number, at))
    return out


# --- Haskell

_HASKELL = Syntax(line=("--",), block=(("{-", "-}"),), quotes='"', words=r"[A-Za-z_][\w']*")
_HASKELL_WORDS = {"module", "where", "import", "data", "type", "newtype", "class", "instance", "let", "in", "case", "of", "if", "then", "else", "do", "deriving", "infixl", "infixr", "infix", "qualified", "as", "hiding"}


def haskell(text: str) -> Relations:
    s, out = Source(text, _HASKELL), Relations()
    tk, found, heads = s.tokens, [], set()
    for i, t in enumerate(tk):
        if t.col == 1 and t.kind == "id" and (t.text[0].islower() or t.text[0] == "_") and t.text not in _HASKELL_WORDS and tk[i - 1 if i else 0].line < t.line + (not i):
            j = i + 1
            while j < len(tk) and not s.is_op(j, "=", "|", ":") and tk[j].line == t.line:
                j += 1
            if s.is_op(j, "=", "|") and (j > i + 1):  # with arguments: a function, not a plain binding
                out.symbols.append((t.text, t.line, t.col))
                heads |= set(range(i, j))
            elif s.is_op(j, "="):
                heads.add(i)
            else:
                heads |= {k for k in range(i, len(tk)) if tk[k].line == t.line}  # a signature
    for i, t in enumerate(tk):
        if t.kind != "id" or i in heads or t.text in _HASKELL_WORDS or not (t.text[0].islower() or t.text[0] == "_"):
            continue
        argument = i + 1 < len(tk) and tk[i + 1].line == t.line and (tk[i + 1].kind in ("str", "num") or tk[i + 1].kind == "id" and tk[i + 1].text not in _HASKELL_WORDS or s.is_op(i + 1, "(", "["))
        applied = i and tk[i - 1].line == t.line and (tk[i - 1].kind in ("str", "num") or tk[i - 1].kind == "id" and tk[i - 1].text not in _HASKELL_WORDS or s.is_op(i - 1, ")", "]"))
        if argument and not applied:
            found.append((t.text, t.line, t.col))
    out.calls = found
    return out


# --- Julia

_JULIA = Syntax(line=("#",), block=(("#=", "=#"),), quotes='"', triple=True, words=r"[A-Za-z_\u0080-￿][\w!\u0080-￿]*")


def julia(text: str) -> Relations:
    s, out = Source(text, _JULIA), Relations()
    skip = set()
    for i, t in enumerate(s.tokens):
        if t.kind == "id" and t.text == "function" and s.is_id(i + 1):
            out.symbols.append((s.tokens[i + 1].text, t.line, t.col))
            skip.add(i + 1)
    found = [c for c in _calls(s, (".",), skip)]
    plain = {s.tokens[i].at for i in range(len(s.tokens)) if s.is_id(i) and not s.is_op(i - 1, ".")}
    out.calls = in_order([c for c in found if c[0] in plain and s.text.startswith(c[2], c[0]) and c[2] not in ("function", "elseif", "end")])
    return out


# --- Scala

_SCALA = Syntax(triple=True, quotes='"')


def scala(text: str) -> Relations:
    s, out, skip = Source(text, _SCALA), Relations(), set()
    tk = s.tokens
    modifiers = ("private", "protected", "override", "final", "abstract", "sealed", "implicit", "lazy", "case", "inline")
    for i, t in enumerate(tk):
        if t.kind != "id" or s.is_op(i - 1, "."):
            continue
        first = i
        while s.is_id(first - 1, *modifiers):
            first -= 1
        if t.text == "def" and s.is_id(i + 1):
            j = i + 2
            while s.is_op(j, "[", "(") and j in s.match:
                j = s.match[j] + 1
            if s.is_op(j, ":"):
                j += 1
                while j < len(tk) and not s.is_op(j, "=", "{", "}", ";") and not s.is_id(j, "def", "val", "var", "class", "object", "trait"):
                    j = s.match[j] + 1 if s.is_op(j, "[", "(") and j in s.match else j + 1
            if s.is_op(j, "=", "{"):  # without a body it is a declaration
                out.symbols.append((tk[i + 1].text, tk[first].line, tk[first].col))
            skip.add(i + 1)
        elif t.text in ("class", "object", "trait") and s.is_id(i + 1):
            at, name, j = tk[first], tk[i + 1].text, i + 2
            out.symbols.append((name, at.line, at.col))
            skip.add(i + 1)
            while s.is_op(j, "[", "(") and j in s.match:
                j = s.match[j] + 1
            if s.is_id(j, "extends") and s.is_id(j + 1):
                out.inherits.append((name, tk[j + 1].text, at.line, at.col, "exact"))
                if s.is_op(j + 2, "("):
                    skip.add(j + 1)
    skip |= {i for i in range(1, len(tk)) if _after_new(s, i)}
    found = []
    for start, end, name, line, col in _calls(s, (".",), skip):
        head = next(k for k, x in enumerate(tk) if x.at == start)
        member = s.is_op(head + 1, ".") and not s.is_id(head - 1, "new")
        found.append((start, end, tk[head].text if member and tk[head].kind == "id" else name, line, col))
    out.calls = in_order(found)
    return out
