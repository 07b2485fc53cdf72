"""Names that SCSS files declare, read by the grammar of style sheets.

A sheet is a run of statements. Each has a prelude that ends at `;`, `{` or `}`, outside of strings,
comments, brackets and `#{...}`. A prelude before `{` that is no at-rule is a selector, over however
many lines. Identifiers may hold non-ASCII letters and escapes.
"""

from __future__ import annotations

_HEX = "0123456789abcdefABCDEF"
_OPEN = {"(": ")", "[": "]"}


def _is_start(c: str) -> bool:
    return c.isalpha() or c == "_" or c > "\x7f"


class _Sheet:
    def __init__(self, text: str):
        self.text, self.n = text, len(text)

    def skipped(self, i: int) -> int:
        """Behind the string, comment or interpolation at i; i itself if there is none."""
        t = self.text
        if t.startswith("/*", i):
            end = t.find("*/", i + 2)
            return self.n if end < 0 else end + 2
        if t.startswith("//", i):
            end = t.find("\n", i)
            return self.n if end < 0 else end
        if t[i] in "\"'":
            quote, i = t[i], i + 1
            while i < self.n and t[i] not in (quote, "\n"):
                i += 2 if t[i] == "\\" else 1
            return min(self.n, i + 1)
        if t.startswith("#{", i):
            depth, i = 1, i + 2
            while i < self.n and depth:
                depth += (t[i] == "{") - (t[i] == "}")
                i += 1
        return i

    def bracket(self, i: int) -> int:
        """Behind the bracket that opens at i. An url without quotes may hold what looks like a comment."""
        shut, plain, i = _OPEN[self.text[i]], self.text[max(0, i - 3) : i].lower() == "url", i + 1
        while i < self.n and self.text[i] != shut:
            if not plain or self.text[i] in "\"'":
                behind = self.skipped(i)
                if behind > i:
                    i = behind
                    continue
            if self.text[i] in _OPEN:
                i = self.bracket(i)
            elif self.text[i] in "{}":
                return i  # never closed
            else:
                i += 2 if self.text[i] == "\\" else 1
        return min(self.n, i + 1)

    def identifier(self, i: int) -> tuple[str, int]:
        """The identifier at i, escapes resolved, and where it ends; empty if there is none."""
        t, out, begin = self.text, [], i
        while i < self.n:
            c = t[i]
            if c == "\\" and i + 1 < self.n and t[i + 1] != "\n":
                k = i + 1
                while k < min(self.n, i + 7) and t[k] in _HEX:
                    k += 1
                code = int(t[i + 1 : k], 16) if k > i + 1 else 0
                out.append(chr(code) if 0 < code < 0x110000 else t[i + 1])
                i = k + (k < self.n and t[k] == " ") if k > i + 1 else i + 2
            elif _is_start(c) or (i > begin and (c.isdigit() or c == "-")) or (c == "-" and i + 1 < self.n and (_is_start(t[i + 1]) or t[i + 1] in "-\\")):
                out.append(c)
                i += 1
            else:
                break
        return "".join(out), i

    def blank(self, i: int) -> int:
        while i < self.n and (self.text[i].isspace() or self.text.startswith(("/*", "//"), i)):
            i = i + 1 if self.text[i].isspace() else self.skipped(i)
        return i

    def statements(self):
        """begin, end and closing character of each prelude."""
        i = begin = self.blank(0)
        while i < self.n:
            behind = self.skipped(i)
            if behind > i:
                i = behind
            elif self.text[i] in _OPEN:
                i = self.bracket(i)
            elif self.text[i] in ";{}":
                yield begin, i, self.text[i]
                i = begin = self.blank(i + 1)
            else:
                i += 2 if self.text[i] == "\\" else 1
        if begin < self.n:
            yield begin, self.n, ";"

    def marked(self, begin: int, end: int, marks: str):
        """mark, name and place of the identifiers that follow a mark, outside of attribute brackets."""
        i = begin
        while i < end:
            behind = self.skipped(i)
            if behind > i:
                i = behind
            elif self.text[i] == "[":
                i = self.bracket(i)
            elif self.text[i] in marks:
                name, behind = self.identifier(i + 1)
                if name:
                    yield self.text[i], name, i + 1
                i = max(behind, i + 1)
            else:
                i += 2 if self.text[i] == "\\" else 1

    def declared(self):
        """kind, mark, name and place of all that is declared."""
        for begin, end, closed in self.statements():
            first = self.text[begin]
            if first == "@":
                rule, at = self.identifier(begin + 1)
                if rule in ("mixin", "function"):
                    name, _ = self.identifier(self.blank(at))
                    if name:
                        yield f"Scss{rule.title()}", f"@{rule}", name, self.blank(at)
                elif rule == "extend":
                    yield from (("ScssPlaceholder", "%", name, place) for _, name, place in self.marked(at, end, "%"))
            elif first == "$":
                name, at = self.identifier(begin + 1)
                if name and self.text[self.blank(at) : self.blank(at) + 1] == ":":
                    yield "ScssVariable", "$", name, begin + 1
            elif closed == "{":
                for mark, name, place in self.marked(begin, end, ".%"):
                    yield ("ScssPlaceholder" if mark == "%" else "ScssSelector"), mark, name, place


def parse(text: str) -> dict:
    """types: each name of a kind where it first stands."""
    clean = text.replace("\r\n", "\n").replace("\r", "\n").replace("\f", "\n")
    found: dict[tuple[str, str], dict] = {}
    for kind, mark, name, place in _Sheet(clean).declared():
        if (kind, name) not in found:
            found[kind, name] = {
                "name": name, "kind": kind, "keyword": mark, "base_types": None, "start_line": clean.count("\n", 0, place) + 1, "line_count": 1, "is_nested": False, "enum_values": None,
                "namespace": None, "members": [],
            }
    return {"namespace": None, "usings": [], "aliases": {}, "types": list(found.values()), "events": [], "registrations": []}
