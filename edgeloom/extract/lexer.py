"""A small tokenizer for source text, and the raw relations that extraction gives."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

OPEN, CLOSE = "([{", ")]}"


@dataclass(frozen=True)
class Token:
    """kind: id, num, str, op. at: offset; line and col from 1."""

    kind: str
    text: str
    at: int
    line: int
    col: int
    value: str = ""


@dataclass
class Relations:
    """Raw relations of a file, each with its place (line, col), in the order of the text."""

    symbols: list[tuple[str, int, int]] = field(default_factory=list)
    imports: list[tuple[str, int, int]] = field(default_factory=list)
    calls: list[tuple[str, int, int]] = field(default_factory=list)
    inherits: list[tuple[str, str, int, int, str]] = field(default_factory=list)  # child, parent, place, confidence
    type_refs: list[tuple[str, int, int]] = field(default_factory=list)
    interface_methods: list[tuple[str, str]] = field(default_factory=list)
    type_methods: list[tuple[str, str, int, int]] = field(default_factory=list)


@dataclass(frozen=True)
class Syntax:
    """How a language writes comments and strings. words: what else an identifier may hold."""

    line: tuple[str, ...] = ("//",)
    block: tuple[tuple[str, str], ...] = (("/*", "*/"),)
    quotes: str = "\"'"
    triple: bool = False
    raw: str = ""
    template: bool = False
    regex: bool = False
    words: str = r"[A-Za-z_$\u0080-￿][\w$\u0080-￿]*"


class Source:
    """Tokens of a text with matching brackets."""

    def __init__(self, text: str, syntax: Syntax):
        self.text, self.syntax = text, syntax
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.tokens: list[Token] = []
        self._word = re.compile(syntax.words)
        self._scan(0, len(text), False)
        self.match: dict[int, int] = {}
        stack: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.kind == "op" and t.text in OPEN:
                stack.append(i)
            elif t.kind == "op" and t.text in CLOSE:
                want = OPEN[CLOSE.index(t.text)]
                while stack and self.tokens[stack[-1]].text != want:
                    stack.pop()
                if stack:
                    j = stack.pop()
                    self.match[i], self.match[j] = j, i

    def place(self, at: int) -> tuple[int, int]:
        line = bisect_right(self.starts, at)
        return line, at - self.starts[line - 1] + 1

    def _add(self, kind: str, a: int, b: int, value: str = "") -> None:
        line, col = self.place(a)
        self.tokens.append(Token(kind, self.text[a:b], a, line, col, value))

    def _scan(self, i: int, end: int, inside: bool) -> int:
        """Tokens from i; in a template's expression, up to its closing brace."""
        text, s, depth = self.text, self.syntax, 0
        while i < end:
            c = text[i]
            if c.isspace():
                i += 1
                continue
            if any(text.startswith(x, i) for x in s.line) and not (c == "#" and i and text[i - 1] in "$\\{"):
                j = text.find("\n", i)
                i = end if j < 0 else j
                continue
            block = next((b for b in s.block if text.startswith(b[0], i)), None)
            if block:
                j = text.find(block[1], i + len(block[0]))
                i = end if j < 0 else j + len(block[1])
                continue
            if s.template and c == "`":
                i = self._template(i, end)
                continue
            if s.regex and c == "/" and self._regex_may_start():
                j = self._regex_end(i)
                if j:
                    self._add("str", i, j)
                    i = j
                    continue
            if c in s.quotes or c in s.raw:
                j, value = self._string(i, end)
                self._add("str", i, j, value)
                i = j
                continue
            m = self._word.match(text, i)
            if m:
                self._add("id", i, m.end())
                i = m.end()
                continue
            if c.isdigit():
                m = re.compile(r"[\w.]+").match(text, i)
                self._add("num", i, m.end())
                i = m.end()
                continue
            if inside and c == "{":
                depth += 1
            if inside and c == "}":
                if not depth:
                    return i
                depth -= 1
            two = next((x for x in ("=>", "->", "::", "?.", "<-", "==", "!=", "<=", ">=", "&&", "||", ":=", "...") if text.startswith(x, i)), c)
            self._add("op", i, i + len(two))
            i += len(two)
        return i

    def _string(self, i: int, end: int) -> tuple[int, str]:
        text, quote = self.text, self.text[i]
        if self.syntax.triple and text.startswith(quote * 3, i):
            j = text.find(quote * 3, i + 3)
            return (end, text[i + 3 :]) if j < 0 else (j + 3, text[i + 3 : j])
        j = i + 1
        while j < end and text[j] != quote:
            if text[j] == "\n" and quote not in self.syntax.raw:
                return j, text[i + 1 : j]
            j += 2 if text[j] == "\\" and quote not in self.syntax.raw else 1
        return min(j + 1, end), text[i + 1 : j]

    def _template(self, i: int, end: int) -> int:
        self._add("str", i, i + 1)
        j = i + 1
        while j < end and self.text[j] != "`":
            if self.text.startswith("${", j):
                j = self._scan(j + 2, end, True) + 1
            else:
                j += 2 if self.text[j] == "\\" else 1
        return min(j + 1, end)

    def _regex_may_start(self) -> bool:
        if not self.tokens:
            return True
        t = self.tokens[-1]
        if t.kind == "id":
            return t.text in ("return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "do", "else", "await", "yield")
        return t.kind == "op" and t.text not in (")", "]", "}")

    def _regex_end(self, i: int) -> int:
        inside, j = False, i + 1
        while j < len(self.text) and self.text[j] != "\n":
            c = self.text[j]
            if c == "\\":
                j += 1
            elif c == "[":
                inside = True
            elif c == "]":
                inside = False
            elif c == "/" and not inside:
                return re.compile(r"/\w*").match(self.text, j).end()
            j += 1
        return 0

    def is_op(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "op" and self.tokens[i].text in texts

    def is_id(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "id" and (not texts or self.tokens[i].text in texts)

    def after_angles(self, i: int) -> int:
        """The place after a `<...>` that starts at i; i if there is none."""
        if not self.is_op(i, "<"):
            return i
        depth, j = 0, i
        while j < len(self.tokens) and j - i < 200:
            t = self.tokens[j]
            if t.text == "<":
                depth += 1
            elif t.text == ">":
                depth -= 1
                if not depth:
                    return j + 1
            elif t.kind == "op" and t.text in ("(", "[", "{") and j in self.match:
                j = self.match[j]
            elif t.kind == "op" and t.text in (";", ")", "}", "&&", "||", "=="):
                return i
            j += 1
        return i

    def chain_start(self, i: int, links: tuple[str, ...] = (".",)) -> int:
        """The first token of the expression `a.b(c)[d].e` that ends with the name at i."""
        while i > 0 and self.is_op(i - 1, *links):
            j = i - 2
            while j > 0 and self.is_op(j, ")", "]") and j in self.match:
                j = self.match[j] - 1
                if not (self.is_id(j) or self.is_op(j, ")", "]")):
                    break
            if j >= 0 and self.tokens[j].kind in ("id", "str", "num"):
                i = j
            elif j + 1 < i and self.is_op(j + 1, "(", "["):
                return j + 1
            else:
                return i
        return i


def in_order(calls: list[tuple[int, int, str, int, int]]) -> list[tuple[str, int, int]]:
    """Calls (start, end, name, line, col) from the outside in and from left to right."""
    return [(name, line, col) for _, _, name, line, col in sorted(calls, key=lambda c: (c[0], -c[1]))]
