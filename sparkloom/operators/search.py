"""Ranked symbol search and nearest names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import INITIALS, NO_MATCH, folded, is_initialism, kind_filter, match_tier, same_name
from ..functions.text import estimated_tokens, is_generated
from .scalars import first_of, packed, top

LIMIT, FEW = 50, 5


def matching_symbols(symbols: DataFrame, query: str, kind: str | None = None, project: str | None = None) -> DataFrame:
    """Symbols whose name holds the query, best first by `tier`; where those are fewer than five and
    the query looks like initials, also those whose initials hold it."""
    rows = symbols.filter(kind_filter(F.col("kind"), kind))
    if project:
        rows = rows.filter(same_name(F.col("project"), F.lit(project)))
    rows = rows.withColumn("tier", match_tier(F.col("name"), query)).filter(F.col("tier") < NO_MATCH)
    if is_initialism(query):
        direct = rows.filter(F.col("tier") < INITIALS)
        rows = rows.filter((F.col("tier") < INITIALS) | (direct.limit(FEW).agg(F.count("*")).scalar() < FEW))
    else:
        rows = rows.filter(F.col("tier") < INITIALS)
    return first_of(rows, ["path", "start_line", F.coalesce("signature", "name")], ["tier", "name", "kind"])


def symbol_order() -> list[Column]:
    return [F.col("tier"), F.col("parent_type").isNotNull(), is_generated(F.col("file")), folded(F.col("name")), F.col("path"), F.col("start_line"), F.col("name"), F.col("kind")]


def search_symbols(symbols: DataFrame, query: str, kind: str | None = None, project: str | None = None, limit: int = LIMIT) -> DataFrame:
    """The best `limit` matches, with the number of all."""
    found = matching_symbols(symbols, query, kind, project)
    return top(found.withColumn("total", found.agg(F.count("*")).scalar()), limit, symbol_order())


def search_within(symbols: DataFrame, query: str, token_budget: int, line: Column, kind: str | None = None, project: str | None = None) -> DataFrame:
    """The best matches whose lines fit a token budget."""
    return packed(matching_symbols(symbols, query, kind, project), estimated_tokens(line), token_budget, symbol_order())


def nearest_names(names: DataFrame, query: str, n: int = 5) -> DataFrame:
    """name, near, distance: up to n names that are nearly the query. Tiers: 0 equal, 1 one begins
    with the other, 2 one holds the other (queries of three letters and more), 3 few edits."""
    wanted, size = query.lower(), len(query)
    edits = 1 if size <= 4 else 2 if size <= 8 else 3
    low = F.lower("name")
    delta = F.abs(F.length("name") - size)
    distance = F.levenshtein(low, F.lit(wanted), edits)
    holds = (low.contains(wanted) | F.lit(wanted).contains(low)) if size >= 3 else F.lit(False)
    near = F.when(low == wanted, 0).when(low.startswith(wanted) | F.lit(wanted).startswith(low), 1).when(holds, 2).when((delta <= edits) & (distance >= 0), 3)
    scored = names.filter(F.length("name") > 0).select("name", near.alias("near"), F.when(near == 0, 0).when(near == 3, distance).otherwise(delta).alias("distance"), delta.alias("delta"))
    scored = scored.filter("near IS NOT NULL").distinct()
    order = ["near", "distance", "delta", "name"]
    return top(first_of(scored, [F.lower("name")], order), n if size else 0, order).select("name", "near", "distance")
