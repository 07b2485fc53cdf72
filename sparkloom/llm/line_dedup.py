"""Line dedup over overlapping three-line windows, in DataFrame functions only.

Every run of `window` consecutive lines is hashed. Of the places that hold the same window, the
first by (doc_id, text digest, line) keeps it; at all others its lines are covered, and a line
covered by any such window goes. Windows of nothing but empty lines don't count.

A document is known by doc_id (null is a value like any other) and the digest of its text: rows
equal in both are one document and get the same result, so that a repeated row is no copy of
itself. Nulls count as empty texts; a text of fewer lines than the window is kept; lines end at
"\\n" alone; an empty table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import unused

WINDOW = 3


def _lines(text: Column, then) -> Column:
    """`then` of the lines of a text; bound once, so that no element splits the text anew."""
    return F.element_at(F.transform(F.array(F.split(text, "\n", -1)), then), 1)


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """One row for each distinct document and window start: id, digest, pos, key."""
    keys = _lines(
        F.col("text"),
        lambda lines: F.when(
            F.size(lines) >= window,
            F.transform(F.sequence(F.lit(1), F.size(lines) - (window - 1)), lambda i: F.unhex(F.md5(F.array_join(F.slice(lines, i, window), "\n")))),
        ),
    )
    return docs.select("id", "digest", F.posexplode(keys).alias("pos", "key")).filter(F.col("key") != F.unhex(F.md5(F.lit("\n" * (window - 1)))))


def covered(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """id, digest and the starts of windows that an earlier place holds. `docs` has id, digest, text."""
    every = _windows(docs, window)
    first = every.groupBy("key").agg(F.min(F.struct("id", "digest", "pos")).alias("first"), F.max(F.struct("id", "digest", "pos")).alias("last"))
    first = first.filter(~F.col("first").eqNullSafe(F.col("last"))).select("key", "first")
    later = every.join(first, "key").filter(~F.struct("id", "digest", "pos").eqNullSafe(F.col("first")))
    return later.groupBy("id", "digest").agg(F.collect_set("pos").alias("starts"))


def line_dedup(docs: DataFrame, window: int = WINDOW, counts: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with its text deduplicated; with `counts` two more columns, _n_lines and _n_removed
    (with more underscores where `docs` has those names)."""
    id_, digest, starts, n_lines, n_removed = unused(docs, "_id", "_digest", "_starts", "_n_lines", "_n_removed")
    own = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    marks = covered(docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.xxhash64(own).alias("digest"), own.alias("text")), window)
    marks = marks.select(F.col("id").alias(id_), F.col("digest").alias(digest), F.col("starts").alias(starts))
    match = F.col(id_).eqNullSafe(F.col(f"`{doc_id}`").cast("long")) & (F.col(digest) == F.xxhash64(own))
    places = F.array_distinct(F.flatten(F.transform(F.col(starts), lambda p: F.sequence(p + 1, p + window))))
    kept = _lines(own, lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(1), F.size(lines)), places), lambda i: F.element_at(lines, i)), "\n"))
    marked = F.col(starts).isNotNull()
    columns = [F.when(marked, kept).otherwise(F.col(f"`{text}`")).alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns]
    if counts:
        columns += [_lines(own, F.size).alias(n_lines), F.when(marked, F.size(places)).otherwise(0).alias(n_removed)]
    return docs.join(marks, match, "left").select(*columns)


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").cast("long").alias("n_lines"), F.col("_n_removed").cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), places AS (
  SELECT doc_id, pos, lines[pos] || chr(10) || lines[pos + 1] || chr(10) || lines[pos + 2] AS key
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS pos FROM split)
), ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) AS n FROM places WHERE key <> chr(10) || chr(10)
), gone AS (
  SELECT DISTINCT doc_id, pos + step AS line FROM ranked, (VALUES (0), (1), (2)) AS steps(step) WHERE n > 1
), lines AS (
  SELECT doc_id, unnest(lines) AS line_text, unnest(range(1, len(lines) + 1)) AS line FROM split
)
SELECT l.doc_id, count(*)::BIGINT AS n_lines, count(g.line)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(line_text, chr(10) ORDER BY l.line) FILTER (WHERE g.line IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.line = l.line GROUP BY l.doc_id
"""
