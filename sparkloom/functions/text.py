"""Expressions over lines and paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def lines(text: Column) -> Column:
    """The lines of a text; CRLF, CR or LF ends one, and the empty rest after the last is none."""
    every = F.split(text, r"\r\n|\r|\n", -1)
    return F.element_at(F.transform(F.array(every), lambda ls: F.when(F.element_at(ls, -1) == "", F.slice(ls, 1, F.size(ls) - 1)).otherwise(ls)), 1)


def line_matches(line: Column, query: str, is_regex: bool = False, ignore_case: bool = False) -> Column:
    if is_regex:
        return F.rlike(line, F.lit(("(?i)" if ignore_case else "") + query))
    return F.lower(line).contains(query.lower()) if ignore_case else line.contains(query)


def whole_word(symbol: str) -> str:
    """A pattern for the symbol as a word, in Unicode's sense of a word."""
    return rf"(?U)\b{re.escape(symbol)}\b"


def mentions(line: Column, symbol: str) -> Column:
    """A line that refers to the symbol and is no line comment; the cheap test comes first."""
    return line.contains(symbol) & ~F.ltrim(line).startswith("//") & F.rlike(line, F.lit(whole_word(symbol)))


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def clipped(line: Column, width: int = 200, focus: str | None = None) -> Column:
    """A line cut to `width` characters: around the first occurrence of `focus`, else from its
    start; an ellipsis stands for what is cut on either side."""
    size = F.length(line)
    head = F.concat(F.substring(line, 1, width), F.lit(" …"))
    if not focus:
        return F.when(size <= width, line).otherwise(head)
    at = F.locate(focus, line)
    end = F.least(size, F.greatest(F.lit(0), at - 1 - width // 2) + width)
    start = F.greatest(F.lit(0), end - width)
    around = F.concat(F.when(start > 0, "… ").otherwise(""), F.substring(line, start + 1, F.lit(width)), F.when(end < size, " …").otherwise(""))
    return F.when(size <= width, line).when(at == 0, head).otherwise(around)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def relative_path(path: Column, root: Column) -> Column:
    norm = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(norm.startswith(F.concat(root, F.lit("/"))), F.substring(norm, F.length(root) + 2, F.length(norm))).otherwise(norm)


#: Globs of generated file names, with one star at most (fixed values).
GENERATED = [
    "*.designer.cs", "*.g.cs", "*.g.i.cs", "*.generated.cs",
    "reference.cs", "temporarygeneratedfile_*.cs", "assemblyinfo.cs", "*.assemblyattributes.cs",
]


def is_generated(file_name: Column, globs: list[str] | None = None) -> Column:
    """File names that match a glob, in any case."""
    low, out = F.lower(file_name), F.lit(False)
    for glob in GENERATED if globs is None else globs:
        head, star, tail = glob.lower().partition("*")
        out = out | (low.startswith(head) & low.endswith(tail) & (F.length(low) >= len(head) + len(tail)) if star else low == head)
    return out


def is_test(project: Column, file_name: Column, relative: Column) -> Column:
    """A project whose last part ends with Tests or is Test, a file named *Tests.cs, or a file
    under a folder test or tests within its project."""
    last = F.element_at(F.split(project, r"\."), -1)
    folders = F.transform(F.split(relative, "/"), F.lower)
    below = F.exists(F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0))), lambda p: p.isin("test", "tests"))
    return last.endswith("Tests") | (last == "Test") | F.lower(file_name).endswith("tests.cs") | below


def age(seconds: Column) -> Column:
    """Seconds, minutes, hours or days, each up to the point where the next reads better."""
    minutes, hours = F.floor(seconds / 60), F.floor(seconds / 3600)
    return (
        F.when(seconds < 90, F.concat(F.floor(seconds).cast("string"), F.lit("s")))
        .when(minutes < 90, F.concat(minutes.cast("string"), F.lit("m")))
        .when(hours < 48, F.concat(hours.cast("string"), F.lit("h")))
        .otherwise(F.concat(F.floor(seconds / 86400).cast("string"), F.lit("d")))
    )


def folder_key(path: Column) -> Column:
    """The first 12 hex digits of a path's digest, in any case."""
    return F.substring(F.upper(F.sha1(F.lower(path))), 1, 12)
