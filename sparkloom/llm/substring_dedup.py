"""Substring dedup by seeds that are extended both ways.

Seeds are winnowed anchors: of every window of `length` words, the smallest hash of `gram` words.
Documents meet at equal anchors (round 1 of `repeats`). An anchor that always stands in the same
surroundings is extended to all of them at once. At any other, a match of `length` words around it takes
b words to the left and the rest to the right: for every b the words from b left of the anchor on are
hashed, and equal hashes are matches that extend so far both ways. All splits are tried at once and
matches counted, so that no pair of documents is formed; the union of the windows that match is the
maximal repeats of `length` words and more. Every word in one goes, in all documents that hold it and at
every occurrence.

Nulls count as empty texts; a text shorter than `length` words has no window and is kept; a text of
any length is taken whole, at some 60 bytes of memory a byte; equal rows are copies of one another;
rows without an id take part like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import mix, owners, words_of
from .chunks import Chunk, answers, chunked, mapped, shards_for
from .repeats import Segments, answer_anchors, ask_anchors, by_shard, covered, open_segments, read_anchors
from .scratch import Workspace, workspace

LENGTH, GRAM = 35, 12
SCHEMA = "doc_id long, n_words long, n_removed long, kept string"


def _segments(chunk: Chunk, length: int, gram: int):
    words = words_of(chunk.data, chunk.offsets)
    return words, Segments(words[2], words[3], length, gram)


def _extended(found: Segments, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Window starts around the anchors of some segments, and the hash of each with its anchor and split."""
    windows = found.windows(found.first[segments], found.last[segments])
    sizes = found.last[segments] - found.first[segments] + 1
    left = np.repeat(found.anchor[segments], sizes) - windows
    return windows, mix(found.spans.every(found.length)[windows] ^ np.repeat(found.a_key[segments], sizes) + left.astype(np.uint64))


def _ask_windows(found: Segments, segments: np.ndarray, shards: int):
    _, keys = _extended(found, segments)
    keys = np.unique(keys)
    for s, rows in by_shard(keys, shards):
        yield s, keys[rows].tobytes()


def _answer_windows(asked: list[bytes]) -> list[bytes]:
    """Bits of the windows that several chunks hold, each of which asks of a window once."""
    keys = [np.frombuffer(x, np.uint64) for x in asked]
    _, which, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    twice = times[which] > 1
    return [np.packbits(x).tobytes() for x in np.split(twice, np.cumsum([len(k) for k in keys])[:-1])]


def _hits(found: Segments, segments: np.ndarray, replies: dict[int, bytes], shards: int) -> np.ndarray:
    """The windows that match elsewhere, in this chunk or another."""
    windows, keys = _extended(found, segments)
    distinct, which, times = np.unique(keys, return_inverse=True, return_counts=True)
    twice = times > 1
    for s, rows in by_shard(distinct, shards):
        twice[rows] |= np.unpackbits(np.frombuffer(replies[s], np.uint8), count=len(rows)).astype(bool)
    return windows[twice[which]]


def removed_words(work: Workspace, docs: DataFrame, out, schema: str, length: int = LENGTH, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`out(chunk, starts, ends, offsets, gone)` for each chunk: words, and which of them go."""
    if not 1 <= gram <= length:
        raise ValueError("gram lies between 1 and length")
    chunks = chunked(work, docs, doc_id, text)
    shards = shards_for(chunks)
    first = answers(work, chunks, lambda c, n: ask_anchors(_segments(c, length, gram)[1], n), answer_anchors, shards)

    def ask(chunk, n):
        found = _segments(chunk, length, gram)[1]
        yield from _ask_windows(found, open_segments(found, read_anchors(found, chunk.answers(1), shards)), n)

    second = answers(work, chunks, ask, _answer_windows, shards, 2, first)

    def finish(chunk):
        (starts, ends, _, offsets), found = _segments(chunk, length, gram)
        flags = read_anchors(found, chunk.answers(1), shards)
        gone = covered(found, flags, _hits(found, open_segments(found, flags), chunk.answers(2), shards), len(starts))
        return out(chunk, starts, ends, offsets, gone)

    return mapped(chunks, finish, schema, [first, second])


def kept_words(data: np.ndarray, starts, ends, offsets, gone) -> list[bytes]:
    """The kept words of each document, joined by one space."""
    if not len(starts):
        return [b""] * (len(offsets) - 1)
    keep = ~gone
    sizes = (ends - starts)[keep]
    doc = owners(offsets)[keep]
    at = np.cumsum(sizes + 1) - (sizes + 1)
    joined = np.full(int(sizes.sum() + len(sizes)), 0x20, np.uint8)
    inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    joined[np.repeat(at, sizes) + inside] = data[np.repeat(starts[keep], sizes) + inside]
    raw = joined.tobytes()
    edges = np.append(at, len(joined))[np.searchsorted(doc, np.arange(len(offsets)))]
    return [raw[a : b - 1] if b > a else b"" for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def _counts(offsets, gone):
    sums = np.concatenate([[0], np.cumsum(gone)])
    return np.diff(offsets), sums[offsets[1:]] - sums[offsets[:-1]]


def substring_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and the kept words of each text, joined by one space."""

    def out(chunk, starts, ends, offsets, gone):
        n, cut = _counts(offsets, gone)
        kept = kept_words(chunk.data, starts, ends, offsets, gone)
        return pa.RecordBatch.from_arrays([pa.array(chunk.doc_ids, pa.int64()), pa.array(n), pa.array(cut), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return _finished(docs, out, SCHEMA, length, gram, doc_id, text)


def _finished(docs, out, schema, *names) -> DataFrame:
    """The result as a table, so that what led to it can go."""
    with workspace(docs.sparkSession) as work:
        return work.written(removed_words(work, docs, out, schema, *names), "substring-dedup", stay=True)


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    def out(chunk, starts, ends, offsets, gone):
        n, cut = _counts(offsets, gone)
        kept = [hashlib.sha256(x).hexdigest() for x in kept_words(chunk.data, starts, ends, offsets, gone)]
        return pa.RecordBatch.from_arrays([pa.array(chunk.doc_ids, pa.int64()), pa.array(n), pa.array(cut), pa.array(kept)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _finished(spark.read.parquet(f"{sf_dir}/documents.parquet"), out, "doc_id long, n_words long, n_removed long, kept_sha256 string")


OP9_SQL = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS key FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM split WHERE len(ws) >= 35)
), twice AS (
  SELECT doc_id, i FROM windows WHERE key IN (SELECT key FROM windows GROUP BY key HAVING count(*) > 1)
), gone AS (
  SELECT DISTINCT doc_id, i + step AS place FROM twice, range(0, 35) AS steps(step)
), words AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS place FROM split
), kept AS (
  SELECT w.doc_id, count(g.place) AS n_removed, string_agg(word, ' ' ORDER BY w.place) FILTER (WHERE g.place IS NULL) AS kept
  FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.place = w.place GROUP BY w.doc_id
)
SELECT s.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON k.doc_id = s.doc_id
"""
