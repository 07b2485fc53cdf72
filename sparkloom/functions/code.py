"""Whether a symbol's occurrences on a line are code, strings or comments."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

_LINE_END, _WORD = re.compile(r"\r\n|\r|\n"), re.compile(r"[^\W\d]\w*")


def code_spans(line: str) -> list[tuple[int, int]]:
    """The parts of a line that are code: neither strings, character literals nor a line comment;
    the holes of interpolated strings are code."""
    spans, start, i, n = [], 0, 0, len(line)
    nested: list[bool] = []  # strings whose hole we are in: whether each is verbatim
    depth = [0]

    def skip(i: int, verbatim: bool, interpolated: bool) -> tuple[int, bool]:
        """Behind a string's rest; and whether a hole opens there."""
        while i < n:
            c = line[i]
            if c == "\\" and not verbatim:
                i += 2
            elif c == '"':
                if verbatim and line[i + 1 : i + 2] == '"':
                    i += 2
                    continue
                return i + 1, False
            elif interpolated and c == "{":
                if line[i + 1 : i + 2] == "{":
                    i += 2
                    continue
                return i + 1, True
            else:
                i += 1
        return n, False

    while i < n:
        c = line[i]
        if line.startswith("//", i):
            break
        if c == "'" and (close := line.find("'", i + (3 if line[i + 1 : i + 2] == "\\" else 2))) in (i + 2, i + 3):
            spans.append((start, i))
            i = start = close + 1
        elif c == '"':
            prefix = line[max(0, i - 2) : i]
            verbatim, interpolated = "@" in prefix, prefix.endswith("$") or prefix == "$@"
            spans.append((start, i))
            i, hole = skip(i + 1, verbatim, interpolated)
            if hole:
                nested.append(verbatim)
                depth.append(0)
            start = i
        elif nested and c == "{":
            depth[-1] += 1
            i += 1
        elif nested and c == "}":
            if depth[-1]:
                depth[-1] -= 1
                i += 1
            else:
                spans.append((start, i))
                depth.pop()
                verbatim = nested.pop()
                i, hole = skip(i + 1, verbatim, True)
                if hole:
                    nested.append(verbatim)
                    depth.append(0)
                start = i
        else:
            i += 1
    return [(a, b) for a, b in [*spans, (start, i)] if a < b]


def only_outside_code(line: str, symbol: str) -> bool:
    """Whether every occurrence of the symbol lies in a string or comment."""
    spans, at = code_spans(line), line.find(symbol)
    while at >= 0:
        if any(a <= at and at + len(symbol) <= b for a, b in spans):
            return False
        at = line.find(symbol, at + 1)
    return True


def outside_code(line: Column, symbol: str) -> Column:
    """The same of a column; meant for lines that hold the symbol."""

    @F.pandas_udf(BooleanType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: only_outside_code(v or "", symbol))

    return run(line)


def code_only(line: str) -> str:
    return " ".join(line[a:b] for a, b in code_spans(line))


def code_words(text: str) -> Counter[str]:
    """How often each word stands in the code of a text, outside strings and line comments."""
    found: Counter[str] = Counter()
    for line in _LINE_END.split(text):
        # lines without a quote, an apostrophe or a comment need no state machine
        found.update(_WORD.findall(code_only(line) if '"' in line or "'" in line or "//" in line else line))
    return found
