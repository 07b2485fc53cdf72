"""Joins and set operations with an order: delta, precedence, merging, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scalars import first_of


def delta(baseline: DataFrame, current: DataFrame, key: str, stamp: str) -> DataFrame:
    """key, state: added, changed, removed or same, by equality of stamps; keys in any case.
    With an empty baseline everything is added."""
    old = baseline.select(F.lower(F.col(key).cast("string")).alias("_key"), F.col(key).alias("_old"), F.col(stamp).alias("_was"))
    new = current.select(F.lower(F.col(key).cast("string")).alias("_key"), F.col(key).alias("_new"), F.col(stamp).alias("_is"))
    state = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~F.col("_was").eqNullSafe(F.col("_is")), "changed").otherwise("same")
    return old.join(new, "_key", "full_outer").select(F.coalesce("_new", "_old").alias(key), state.alias("state"))


def copied_forward(base: DataFrame, states: DataFrame, key: str, parsed: DataFrame) -> DataFrame:
    """Rows of unchanged keys, and the newly parsed ones."""
    gone = states.filter("state <> 'same'").select(F.lower(F.col(key).cast("string")).alias("_gone"))
    return base.join(gone, F.lower(F.col(key).cast("string")) == F.col("_gone"), "left_anti").unionByName(parsed)


def with_precedence(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All of `first`, and what `second` has under other keys (in any case)."""
    have = first.select(F.lower(F.col(key)).alias("_have")).distinct()
    return first.unionByName(second.join(have, F.lower(F.col(key)) == F.col("_have"), "left_anti"))


def innermost(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, name: str, order: str) -> DataFrame:
    """Each point with the interval [start, end) of its key that begins last before it; of equal
    ones the first by `order`, a number. Points in no interval are kept. The key makes it a hash join."""
    own = points.withColumn("_point", F.monotonically_increasing_id())
    side = intervals.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(start).alias("_start"), F.col(end).alias("_end"), (-F.col(order)).alias("_order"), F.col(name).alias("_name"))
    match = (F.col(at) >= F.col("_start")) & (F.col(at) < F.col("_end"))
    for k in keys:
        match = match & (F.col(k) == F.col(f"_{k}"))
    best = F.max(F.when(F.col("_start").isNotNull(), F.struct("_start", "_order", "_name")))
    met = own.join(side, match, "left").groupBy("_point", *points.columns).agg(best.alias("_best"))
    return met.select(*points.columns, F.col("_best._start").alias("enclosing_start"), F.col("_best._name").alias("enclosing"))


def merged_parts(parts: DataFrame, name: str, namespace: str, bases: str, start: str, place: list[str] | None = None, order: list | None = None) -> DataFrame:
    """Partial declarations of one name as one row for each namespace: how many parts, the union of
    their bases in order, and whether the name is ambiguous (occurs in several namespaces). `place`
    names further columns, taken from the first part in `order`."""
    key = F.lower(F.coalesce(F.col(namespace), F.lit("")))
    more = [F.min_by(F.struct(*place), F.struct(*order)).alias("_place")] if place else []
    none = F.array().cast("array<string>")
    one = parts.groupBy(F.col(name), key.alias("_ns")).agg(
        F.min(namespace).alias(namespace), F.count("*").alias("parts"), F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.coalesce(bases, none))))).alias("bases"), F.min(start).alias("first"), *more
    )
    out = one.withColumn("ambiguous", F.count("*").over(Window.partitionBy(name)) > 1).drop("_ns")
    return out.select(*(c for c in out.columns if c != "_place"), "_place.*") if place else out


def recent_notes(notes: DataFrame, most: int = 50, width: int = 300) -> DataFrame:
    """seq, note: one line each, the newest of equal notes, the newest `most` of all."""
    line = F.substring(F.trim(F.regexp_replace("note", r"\s+", " ")), 1, width)
    clean = notes.select("seq", line.alias("note")).filter("note <> ''")
    return clean.groupBy("note").agg(F.max("seq").alias("seq")).orderBy(F.desc("seq")).limit(most).select("seq", "note")


def unused_and_missing(used: DataFrame, imported: DataFrame, declared: DataFrame, defined_elsewhere: DataFrame) -> DataFrame:
    """name, finding: names used that are neither imported nor declared though defined elsewhere
    ('missing', with their first line), and imports that are never used ('unused')."""
    missing = used.join(imported, "name", "left_anti").join(declared, "name", "left_anti").join(defined_elsewhere, "name", "left_semi")
    unused = imported.join(used, "name", "left_anti")
    return missing.select("name", F.lit("missing").alias("finding"), "line").unionByName(unused.select("name", F.lit("unused").alias("finding"), F.col("line")))


def first_wins(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key (equal in any case)."""
    return first_of(df, [F.lower(key)], [order])


def edge_lists(edges: DataFrame) -> DataFrame:
    """node, references, dependents: sorted neighbours along and against the edges."""
    forward = edges.groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_set("dst")).alias("references"))
    backward = edges.groupBy(F.col("dst").alias("node")).agg(F.sort_array(F.collect_set("src")).alias("dependents"))
    none = F.array().cast("array<string>")
    return forward.join(backward, "node", "full_outer").select("node", F.coalesce("references", none).alias("references"), F.coalesce("dependents", none).alias("dependents"))
