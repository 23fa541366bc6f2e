"""Relations of TypeScript and JavaScript: module-level declarations and methods, imports, calls."""

from __future__ import annotations

from .lexer import Relations, Source, Syntax, in_order

SYNTAX = Syntax(template=True, regex=True)
_NOT_CALLED = {
    "if", "for", "while", "switch", "catch", "return", "function", "typeof", "super", "import", "with", "await", "delete", "void",
    "throw", "case", "do", "else", "in", "of", "instanceof", "yield", "async", "constructor", "new",
}
_MODIFIERS = {"export", "default", "declare", "abstract", "async", "public", "private", "protected", "static", "readonly", "override"}


def _statement_end(s: Source, i: int) -> int:
    """The token after the declaration list that starts at i."""
    line = s.tokens[i].line if i < len(s.tokens) else 0
    while i < len(s.tokens):
        t = s.tokens[i]
        if t.kind == "op" and t.text in "([{" and i in s.match:
            i = s.match[i]
            line = s.tokens[i].line
        elif t.text == ";":
            return i + 1
        elif t.text in CLOSERS:
            return i
        elif t.line > line and t.kind == "id" and _ends_value(s, i - 1) and not s.is_op(i, ".", ","):
            return i
        line = s.tokens[i].line
        i += 1
    return i


CLOSERS = (")", "]", "}")


def _ends_value(s: Source, i: int) -> bool:
    """Whether a line may end after this token."""
    return i >= 0 and (s.tokens[i].kind in ("id", "num", "str") or s.is_op(i, ")", "]", "}")) and not s.is_id(i, "extends", "typeof", "new", "in", "of", "return")


def _variables(s: Source, i: int, end: int, exported: bool, out: Relations) -> None:
    """Names of a declaration list with a value, or exported."""
    while i < end:
        name = s.tokens[i] if s.is_id(i) else None
        value, j = False, i
        while j < end and not s.is_op(j, ",", ";"):
            if s.is_op(j, "="):
                value = True
            if s.is_op(j, "([{"[0], "[", "{") and j in s.match:
                j = s.match[j]
            elif not value and s.is_op(j, "<"):
                j = max(j, s.after_angles(j) - 1)
            j += 1
        if name and (value or exported):
            out.symbols.append((name.text, name.line, name.col))
        i = j + 1
        if s.is_op(j, ";"):
            return


def _members(s: Source, owner: str, i: int, end: int, out: Relations) -> None:
    """Methods of a class body: not constructors, accessors, or properties."""
    while i < end:
        while s.is_op(i, "@"):
            i += 2
            while s.is_op(i, "."):
                i += 2
            if s.is_op(i, "(") and i in s.match:
                i = s.match[i] + 1
        first = i
        accessor = False
        while i < end and s.is_id(i) and (s.tokens[i].text in _MODIFIERS or s.tokens[i].text in ("get", "set")) and (s.is_id(i + 1) or s.is_op(i + 1, "*", "[", "#") or (i + 1 < end and s.tokens[i + 1].kind == "str")):
            accessor |= s.tokens[i].text in ("get", "set")
            i += 1
        if s.is_op(i, "*"):
            i += 1
        if s.is_id(i):
            name, j = s.tokens[i], i + 1
            if s.is_op(j, "?"):
                j += 1
            j = s.after_angles(j)
            if s.is_op(j, "(") and not accessor and name.text != "constructor":
                at = s.tokens[first]
                out.symbols.append((f"{owner}.{name.text}", at.line, at.col))
        # To the end of the member: its body, a semicolon, or a new line after a value.
        line = s.tokens[i].line if i < end else 0
        while i < end:
            if s.is_op(i, ";"):
                i += 1
                break
            if s.is_op(i, "{") and i in s.match:
                body = not s.is_op(i - 1, "=", ":", "=>", "|", "&", "(", ",")
                i = s.match[i] + 1
                line = s.tokens[i - 1].line
                if body:
                    break
                continue
            if s.is_op(i, "(", "[") and i in s.match:
                i = s.match[i]
            elif s.tokens[i].line > line and _ends_value(s, i - 1) and (s.is_id(i) or s.is_op(i, "@", "#", "[")):
                break
            line = s.tokens[i].line
            i += 1


def _type_ranges(s: Source) -> list[tuple[int, int]]:
    """Bodies of interfaces, where names before brackets are signatures."""
    out = []
    for i, t in enumerate(s.tokens):
        if t.kind == "id" and t.text == "interface" and s.is_id(i + 1) and not s.is_op(i - 1, "."):
            j = i + 2
            while j < len(s.tokens) and not s.is_op(j, "{", ";"):
                j += 1
            if s.is_op(j, "{") and j in s.match:
                out.append((j, s.match[j]))
    return out


def extract(text: str) -> Relations:
    s, out = Source(text, SYNTAX), Relations()
    tokens, i = s.tokens, 0
    while i < len(tokens):  # statements of the module
        first = i
        while s.is_op(i, "@") and s.is_id(i + 1):
            i += 2
            if s.is_op(i, "(") and i in s.match:
                i = s.match[i] + 1
        exported = False
        while s.is_id(i, "export", "default", "declare", "abstract", "async") and not s.is_op(i + 1, "=", ".", "(", ":"):
            exported |= tokens[i].text == "export"
            i += 1
        if i >= len(tokens):
            break
        at = tokens[first]
        if s.is_id(i, "function"):
            j = i + 2 if s.is_op(i + 1, "*") else i + 1
            if s.is_id(j):
                out.symbols.append((tokens[j].text, at.line, at.col))
            j = s.after_angles(j + s.is_id(j))
            j = s.match.get(j, j) + 1
            while j < len(tokens) and not s.is_op(j, "{", ";") and not (tokens[j].kind == "id" and tokens[j].line > tokens[j - 1].line and _ends_value(s, j - 1)):
                j = s.match[j] + 1 if s.is_op(j, "(", "[") and j in s.match else j + 1
            # An object type before the body isn't the body.
            while s.is_op(j, "{") and s.is_op(j - 1, ":", "|", "&") and j in s.match:
                j = s.match[j] + 1
            i = s.match[j] + 1 if s.is_op(j, "{") and j in s.match else j + 1
        elif s.is_id(i, "class"):
            name = tokens[i + 1].text if s.is_id(i + 1) and tokens[i + 1].text not in ("extends", "implements") else None
            if name:
                out.symbols.append((name, at.line, at.col))
            j = i + 1
            while j < len(tokens) and not s.is_op(j, "{"):
                j = s.match[j] + 1 if s.is_op(j, "(") and j in s.match else j + 1
            if name and j in s.match:
                _members(s, name, j + 1, s.match[j], out)
            i = s.match.get(j, j) + 1
        elif s.is_id(i, "interface") and s.is_id(i + 1):
            out.symbols.append((tokens[i + 1].text, at.line, at.col))
            while i < len(tokens) and not s.is_op(i, "{"):
                i += 1
            i = s.match.get(i, i) + 1
        elif s.is_id(i, "type") and s.is_id(i + 1) and s.is_op(s.after_angles(i + 2), "="):
            out.symbols.append((tokens[i + 1].text, at.line, at.col))
            i = _statement_end(s, i + 2)
        elif s.is_id(i, "const", "let", "var") and not s.is_id(i + 1, "enum"):
            end = _statement_end(s, i + 1)
            _variables(s, i + 1, end, exported, out)
            i = end
        else:
            i = s.match[i] + 1 if s.is_op(i, "(", "[", "{") and i in s.match else i + 1
            if exported and i == first + 1:
                continue
    signatures = _type_ranges(s)
    calls = []
    for i, t in enumerate(tokens):
        if t.kind != "id":
            continue
        if t.text in ("import", "export") and not s.is_op(i - 1, ".") and not s.is_op(i + 1, "(", "."):
            j = i + 1
            if t.text == "import" and j < len(tokens) and tokens[j].kind == "str":
                out.imports.append((tokens[j].value, t.line, t.col))
                continue
            while j < len(tokens) and (s.is_id(j) and tokens[j].text != "from" or s.is_op(j, "*", ",", "{")):
                j = s.match[j] + 1 if s.is_op(j, "{") and j in s.match else j + 1
            if s.is_id(j, "from") and j + 1 < len(tokens) and tokens[j + 1].kind == "str":
                out.imports.append((tokens[j + 1].value, t.line, t.col))
            continue
        opened = i + 1
        if s.is_op(opened, "?."):
            opened += 1
        opened = s.after_angles(opened)
        if not s.is_op(opened, "(") or opened not in s.match:
            continue
        member = s.is_op(i - 1, ".", "?.")
        if not member and t.text in _NOT_CALLED:
            continue
        if not member and (s.is_id(i - 1, "function", "new", "class", "get", "set") or s.is_op(i - 1, "*") and s.is_id(i - 2, "function")):
            continue
        closed = s.match[opened]
        start = s.chain_start(i, (".", "?."))
        if s.is_id(start - 1, "new"):  # new a.b(): the brackets belong to `new`, but for later links of the chain
            before = [k for k in range(start, i) if s.is_op(k, "(")]
            if not before:
                continue
            start -= 1
        if any(a < i < b for a, b in signatures):
            continue
        if not member and s.is_op(closed + 1, "{") and (s.is_op(i - 1, "{", "}", ",", ";", "*", "]", ")") or s.is_id(i - 1, *_MODIFIERS) or tokens[i - 1].line < t.line):
            continue  # a method's own declaration
        if not member and s.is_op(closed + 1, ":") and _typed_method(s, closed + 1) and (s.is_op(i - 1, "{", "}", ",", ";") or s.is_id(i - 1, *_MODIFIERS)):
            continue
        calls.append((tokens[start].at, tokens[closed].at, t.text, tokens[start].line, tokens[start].col))
    out.calls = in_order(calls)
    return out


def _typed_method(s: Source, i: int) -> bool:
    """Whether a colon after brackets starts a return type that a body follows."""
    j = i + 1
    while j < len(s.tokens) and j - i < 60:
        if s.is_op(j, "{"):
            if s.is_op(j - 1, ":", "|", "&", "<", ","):
                j = s.match.get(j, j)
            else:
                return True
        elif s.is_op(j, "(", "[") and j in s.match:
            j = s.match[j]
        elif s.is_op(j, ";", ")", "}", "="):
            return s.is_op(j, ";")
        j += 1
    return False
