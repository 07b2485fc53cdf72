"""Tokens of C# and TypeScript texts."""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # name, number, string, template, punct, comment
    text: str
    start: int
    end: int


_CS = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))
    |(?P<string>\$*\"\"\"+.*?\"\"\"+|(?:\$@|@\$|@)\"(?:[^\"]|\"\")*\"|\$?\"(?:\\.|[^\"\\\n])*\"|'(?:\\.[^'\n]*|[^'\\\n])')
    |(?P<number>\d[\w.]*)|(?P<name>@?[^\W\d]\w*)|(?P<punct>=>|::|\?\?=?|\?\.|&&|\|\||[=!<>]=|[+-]{2}|.)""",
    re.S | re.X,
)
_TS = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))
    |(?P<template>`(?:\\.|[^`\\])*`)|(?P<string>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')
    |(?P<number>\d[\w.]*)|(?P<name>[^\W\d][\w$]*|[$#][\w$]*)|(?P<punct>=>|\?\.|\.\.\.|\?\?=?|&&|\|\||===?|!==?|[<>]=|[+-]{2}|.)""",
    re.S | re.X,
)


class Source:
    """A text, its tokens without comments, its comments, and line numbers from 1."""

    def __init__(self, text: str, lang: str):
        self.text = text
        every = [Token(m.lastgroup, m.group(), m.start(), m.end()) for m in (_CS if lang == "cs" else _TS).finditer(text) if m.lastgroup != "space"]
        self.tokens = [t for t in every if t.kind != "comment"]
        self.comments = [t for t in every if t.kind == "comment"]
        self._ends = [m.start() for m in re.finditer(r"\r\n?|\n", text)]
        self.match = self._brackets()

    def line(self, at: int) -> int:
        return bisect_right(self._ends, at - 1) + 1 if at else 1

    def _brackets(self) -> dict[int, int]:
        """The partner of each bracket token; unbalanced ones close at the end or are ignored."""
        pairs, stack, shut = {}, [], {")": "(", "]": "[", "}": "{"}
        for i, t in enumerate(self.tokens):
            if t.kind != "punct":
                continue
            if t.text in "([{":
                stack.append(i)
            elif t.text in shut:
                for k in range(len(stack) - 1, -1, -1):
                    if self.tokens[stack[k]].text == shut[t.text]:
                        pairs[stack[k]] = i
                        pairs[i] = stack[k]
                        del stack[k:]
                        break
        for i in stack:
            pairs[i] = len(self.tokens)
        return pairs

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind in ("punct", "name") and self.tokens[i].text in texts

    def name(self, i: int) -> str | None:
        return self.tokens[i].text.lstrip("@") if 0 <= i < len(self.tokens) and self.tokens[i].kind == "name" else None

    def between(self, i: int, j: int) -> str:
        """The text of tokens i..j-1."""
        return self.text[self.tokens[i].start : self.tokens[j - 1].end] if i < j <= len(self.tokens) else ""

    def after(self, i: int) -> int:
        """The token behind a bracket's partner."""
        return min(self.match.get(i, i) + 1, len(self.tokens))

    def angle(self, i: int) -> int | None:
        """The token behind the type arguments that open at i; None if it is no such list."""
        depth, k = 0, i
        while k < len(self.tokens):
            t = self.tokens[k]
            if t.text == "<":
                depth += 1
            elif t.text == ">":
                depth -= 1
                if not depth:
                    return k + 1
            elif t.text in "([" and t.kind == "punct":
                k = self.match.get(k, k)
            elif not (t.kind == "name" or t.text in (",", ".", "?", "::", "*", "&", "|")):
                return None
            k += 1
        return None
