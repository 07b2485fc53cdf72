"""Expressions over names: match tiers, initials, folding, namespaces."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT, PREFIX, SUBSTRING, INITIALS, NO_MATCH = 0, 1, 2, 3, 9


def folded(name: Column) -> Column:
    """The key of case-insensitive order: upper case, so that '_' follows the letters."""
    return F.upper(name)


def same_name(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def initials(name: Column) -> Column:
    """The characters at word boundaries: the first, an upper-case letter after a lower-case one or
    a digit, and what follows '_' or '.'."""
    return F.array_join(F.regexp_extract_all(name, F.lit(r"(?:^|(?<=[_.])|(?<=[\p{Ll}\p{Nd}])(?=\p{Lu}))([^_.])"), 1), "")


def subsequence(letters: Column, query: str) -> Column:
    """Whether the letters of `query` occur in `letters` in order, in any case."""
    return F.rlike(letters, F.lit("(?i)^.*" + ".*".join(re.escape(c) for c in query)))


def is_initialism(query: str) -> bool:
    """Two to six letters, at least one of them upper case."""
    return 2 <= len(query) <= 6 and query.isalpha() and any(c.isupper() for c in query)


def match_tier(name: Column, query: str) -> Column:
    """0 exact, 1 prefix, 2 substring, 3 initials, 9 no match; all in any case."""
    low, wanted = F.lower(name), query.lower()
    tier = F.when(low == wanted, EXACT).when(low.startswith(wanted), PREFIX).when(low.contains(wanted), SUBSTRING)
    return (tier.when(subsequence(initials(name), query), INITIALS) if query else tier).otherwise(NO_MATCH)


def simple_base_name(base: Column) -> Column:
    """A base type without namespace and type arguments."""
    return F.trim(F.substring_index(F.substring_index(base, "<", 1), ".", -1))


def namespace_matches(namespace: Column, requested: str) -> Column:
    """Equal to the requested one, or ending with it after a dot; in any case."""
    low, wanted = F.lower(namespace), requested.lower()
    return (low == wanted) | low.endswith("." + wanted)


def ancestors(namespace: Column) -> Column:
    """a.b.c -> [a, a.b, a.b.c]."""

    def of(parts):
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))

    return F.element_at(F.transform(F.array(F.split(namespace, r"\.")), of), 1)


#: Kinds that a filter names, and the symbol kinds it lets through.
KIND_FILTERS = {
    "class": ["Class", "AbstractClass", "SealedClass", "StaticClass"],
    "struct": ["Struct", "RecordStruct"],
    "record": ["Record", "RecordStruct"],
    "interface": ["Interface"],
    "enum": ["Enum"],
    "delegate": ["Delegate"],
    "method": ["Method"],
    "constructor": ["Constructor"],
    "ctor": ["Constructor"],
    "property": ["Property"],
    "field": ["Field"],
    "event": ["Event"],
}


def kind_filter(kind: Column, requested: str | None) -> Column:
    """Rows of a requested kind; none requested lets all through, an unknown one is an error."""
    if not requested:
        return F.lit(True)
    if requested.lower() not in KIND_FILTERS:
        raise ValueError(f"unknown kind {requested!r}; one of {', '.join(KIND_FILTERS)}")
    return kind.isin(KIND_FILTERS[requested.lower()])
