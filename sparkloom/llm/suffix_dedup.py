"""Dedup of byte strings by a logarithmic family of suffix arrays.

The suffixes that can matter are found by winnowing (`repeats`): those at windows whose anchor
occurs in more than one surrounding. They go to shards by what all windows at about the same distance
from their anchor share (`pieces`), so that a common anchor is spread by the text around it. A shard
takes them in batches. Each batch gets a suffix array (positions in the order of the `length` bytes
that follow), which is merge-scanned against the arrays of the existing levels: neighbours that agree
over `length` bytes mark both sides. What is new becomes a level, and levels of equal size merge, so
that a suffix is merged a logarithmic number of times.

`SuffixFamily` keeps such a family in a folder, over all windows of what was added: a later batch is
scanned against its levels, and only the levels that merge are written anew.

Nulls count as empty texts; a text shorter than `length` bytes is kept; a text of any length is taken
whole, at some 60 bytes of memory a byte; equal rows are copies of one another; rows without an id
take part like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import BYTE_CODE, mix, owners
from .chunks import Chunk, answers, chunked, mapped, shards_for
from .repeats import Segments, answer_anchors, ask_anchors, by_shard, covered, open_segments, read_anchors
from .scratch import Workspace, unused, workspace, written

LENGTH, GRAM = 200, 100
#: Shards of round 2 for each of round 1, and classes of distances from an anchor.
FINER, CLASSES = 4, 2
#: Suffixes that a batch of a shard holds at least; chunks are added together until then.
BATCH = 1 << 15
#: Neighbours that a merge scan compares at once.
_STRETCH = 1 << 14


class Level:
    """A suffix array: a text, positions in the order of what follows them, and their numbers."""

    def __init__(self, text: np.ndarray, at: np.ndarray, numbers: np.ndarray, serial: str = ""):
        self.text, self.at, self.numbers, self.serial, self.rank = text, at, numbers, serial, len(at).bit_length()

    def keys(self, length: int) -> np.ndarray:
        return _cut(self.text, self.at, length)


def _cut(text: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The `length` bytes from each position, comparable."""
    if not len(at):
        return np.zeros(0, f"S{length}")
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, length)[at]).view(f"S{length}").ravel()


def merge_scan(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two sorted arrays in one pass (a stable sort of two runs merges them): their common order, and
    the places in `old` and `new` of neighbours that are equal. Each array holds a key once.
    Neighbours are compared a stretch at a time, since a key takes as many bytes as a match is long."""
    both = np.concatenate([old, new])
    order = np.argsort(both, kind="stable")
    met = [np.zeros(0, np.int64)]
    for i in range(0, len(order) - 1, _STRETCH):
        part = both[order[i : i + _STRETCH + 1]]
        met.append(np.flatnonzero(part[1:] == part[:-1]) + i)
    met = np.concatenate(met)
    return order, order[met], order[met + 1] - len(old)


class SuffixLevels:
    """Suffix arrays over all batches added so far, in levels of geometric sizes."""

    def __init__(self, length: int, levels: list[Level] | None = None):
        self.length, self.levels, self.n = length, [], 0
        self.repeated = np.zeros(1024, bool)  # by number
        for level in sorted(levels or [], key=lambda x: -x.rank):
            level.numbers = self._numbered(len(level.at))
            self.levels.append(level)

    def _numbered(self, n: int) -> np.ndarray:
        self.n += n
        if self.n > len(self.repeated):
            self.repeated = np.concatenate([self.repeated, np.zeros(max(self.n, len(self.repeated)), bool)])
        return np.arange(self.n - n, self.n)

    def add(self, text: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Adds the suffixes of a batch, the positions `at` of its text, and returns their numbers."""
        keys = _cut(text, at, self.length)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        head = np.ones(len(keys), bool)
        head[1:] = keys[1:] != keys[:-1]
        group = np.cumsum(head) - 1
        keys, first = keys[head], at[order[head]]
        number = np.full(len(keys), -1, np.int64)
        for level in self.levels:
            _, theirs, mine = merge_scan(level.keys(self.length), keys)
            number[mine] = level.numbers[theirs]
            self.repeated[number[mine]] = True
        new = number < 0
        number[new] = self._numbered(int(new.sum()))
        self.repeated[number[np.bincount(group, minlength=len(keys)) > 1]] = True
        if new.any():
            self._push(Level(text, first[new], number[new]))
        out = np.empty(len(at), np.int64)
        out[order] = number[group]
        return out

    def _push(self, level: Level) -> None:
        while self.levels and self.levels[-1].rank <= level.rank:
            old = self.levels.pop()
            order, _, _ = merge_scan(old.keys(self.length), level.keys(self.length))
            at, numbers = np.concatenate([old.at, level.at + len(old.text)])[order], np.concatenate([old.numbers, level.numbers])[order]
            level = Level(np.concatenate([old.text, level.text]), at, numbers)
        self.levels.append(level)


def _segments(chunk: Chunk, length: int, gram: int) -> Segments:
    return Segments(BYTE_CODE[chunk.data], chunk.offsets, length, gram)


def pieces(found: Segments, segments: np.ndarray, shards: int):
    """For each shard the first and last windows of its runs. Windows are classed by their distance from
    the anchor; those of a class share all but a few bytes around it, and go by the hash of that."""
    step = -(-(found.length - found.gram + 1) // CLASSES)
    anchor, every = found.anchor[segments], []
    for c in range(CLASSES):
        low, high = c * step, min((c + 1) * step - 1, found.length - found.gram)
        first, last = np.maximum(found.first[segments], anchor - high), np.minimum(found.last[segments], anchor - low)
        some = first <= last
        key = mix(found.spans.hash(anchor[some] - low, anchor[some] - high + found.length) + np.uint64(c))
        every.append((key, first[some], last[some]))
    key, first, last = (np.concatenate(x) for x in zip(*every, strict=True))
    for s, rows in by_shard(key, shards):
        yield s, first[rows], last[rows]


def _ask_suffixes(found: Segments, data: np.ndarray, segments: np.ndarray, shards: int):
    """For each shard: the number of runs, their numbers of windows, and their bytes."""
    for s, first, last in pieces(found, segments, shards):
        sizes = last - first + found.length
        raw = data[np.arange(int(sizes.sum())) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)]
        yield s, np.int64(len(first)).tobytes() + (last - first + 1).astype(np.int32).tobytes() + raw.tobytes()


def _suffixes(asked: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The text of a chunk's runs, and the positions of their windows."""
    n = int(np.frombuffer(asked, np.int64, 1)[0])
    windows = np.frombuffer(asked, np.int32, n, 8).astype(np.int64)
    sizes = windows + length - 1
    first = np.cumsum(sizes) - sizes
    return np.frombuffer(asked, np.uint8, offset=8 + 4 * n), np.arange(int(windows.sum())) + np.repeat(first - (np.cumsum(windows) - windows), windows)


def _answer_suffixes(asked: list[bytes], index: SuffixLevels) -> list[bytes]:
    """Bits of the suffixes that occur twice, for each chunk."""
    numbers, batch, held = [], [], 0
    for k, one in enumerate(asked):
        batch.append(_suffixes(one, index.length))
        held += len(batch[-1][1])
        if held >= BATCH or k == len(asked) - 1:
            begin = np.cumsum([0, *(len(t) for t, _ in batch)])
            found = index.add(np.concatenate([t for t, _ in batch]), np.concatenate([at + b for (_, at), b in zip(batch, begin, strict=False)]))
            numbers += np.split(found, np.cumsum([len(at) for _, at in batch])[:-1])
            batch, held = [], 0
    return [np.packbits(index.repeated[x]).tobytes() for x in numbers]


def _hits(found: Segments, segments: np.ndarray, replies: dict[int, bytes], shards: int) -> np.ndarray:
    """The windows that occur twice, from the bits of round 2."""
    out = [np.zeros(0, np.int64)]
    for s, first, last in pieces(found, segments, shards):
        windows = found.windows(first, last)
        out.append(windows[np.unpackbits(np.frombuffer(replies[s], np.uint8), count=len(windows)).astype(bool)])
    return np.concatenate(out)


def removed_bytes(work: Workspace, docs: DataFrame, out, schema: str, length: int = LENGTH, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`out(chunk, gone)` for each chunk: which of its bytes go."""
    if not 1 <= gram <= length:
        raise ValueError("gram lies between 1 and length")
    chunks = chunked(work, docs, doc_id, text)
    shards = shards_for(chunks)
    fine = shards * FINER
    first = answers(work, chunks, lambda c, n: ask_anchors(_segments(c, length, gram), n), answer_anchors, shards)

    def ask(chunk, n):
        found = _segments(chunk, length, gram)
        yield from _ask_suffixes(found, chunk.data, open_segments(found, read_anchors(found, chunk.answers(1), shards)), n)

    second = answers(work, chunks, ask, lambda asked: _answer_suffixes(asked, SuffixLevels(length)), fine, 2, first)

    def finish(chunk):
        found = _segments(chunk, length, gram)
        flags = read_anchors(found, chunk.answers(1), shards)
        return out(chunk, covered(found, flags, _hits(found, open_segments(found, flags), chunk.answers(2), fine), len(chunk.data)))

    return mapped(chunks, finish, schema, [first, second])


class SuffixFamily:
    """A family of levels in a folder that driver and executors share."""

    _LEVELS, _LIVE = "shard int, serial string, rank int, data binary", "shard int, serial string"

    def __init__(self, spark: SparkSession, folder: str, shards: int, length: int = LENGTH, gram: int = GRAM):
        """`shards` stays the same for the life of a folder."""
        self.spark, self.folder, self.shards, self.length, self.gram = spark, folder.rstrip("/"), shards, length, gram

    def _versions(self) -> int:
        try:
            return self.spark.read.schema("version int").json(f"{self.folder}/versions").agg(F.max("version")).first()[0] or 0
        except AnalysisException:
            return 0

    def levels(self) -> DataFrame:
        """The live levels: shard, serial, rank, data."""
        n = self._versions()
        if not n:
            return self.spark.createDataFrame([], self._LEVELS)
        live = self.spark.read.parquet(f"{self.folder}/live-{n}")
        return self.spark.read.schema(self._LEVELS).parquet(*(f"{self.folder}/levels-{k}" for k in range(1, n + 1))).join(live, ["shard", "serial"], "left_semi")

    def add(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """Scans a batch against the levels and itself, and adds it: doc_id, n_bytes, and n_repeated, the
        bytes that lie in strings of `length` bytes which the family or the batch holds elsewhere."""
        length, gram, shards, n = self.length, self.gram, self.shards, self._versions() + 1

        def ask(chunk, shards):
            found = _segments(chunk, length, gram)
            yield from _ask_suffixes(found, chunk.data, found.distinct, shards)

        def scan(key, mail, levels):
            have = [Level(*pickle.loads(d), serial=s) for s, d in zip(levels.column("serial").to_pylist(), levels.column("data").to_pylist(), strict=True)]
            index = SuffixLevels(length, have)
            got = [(b, pickle.loads(d)) for b, d in zip(mail.column("bundle").to_pylist(), mail.column("data").to_pylist(), strict=True)]
            said = iter(_answer_suffixes([d for _, asked in got for _, d in asked], index))
            rows = [{"shard": key[0].as_py(), "bundle": b, "data": pickle.dumps([(c, next(said)) for c, _ in asked])} for b, asked in got]
            for level in index.levels:
                fresh = not level.serial
                level.serial = level.serial or uuid.uuid4().hex
                rows.append({"shard": key[0].as_py(), "serial": level.serial, "rank": level.rank, "data": pickle.dumps((level.text, level.at, level.numbers)) if fresh else None})
            return pa.Table.from_pylist(rows, pa.schema([("shard", pa.int32()), ("bundle", pa.int64()), ("serial", pa.string()), ("rank", pa.int32()), ("data", pa.binary())]))

        def finish(chunk):
            found = _segments(chunk, length, gram)
            gone = covered(found, np.zeros(len(found.first), np.uint8), _hits(found, found.distinct, chunk.answers(1), shards), len(chunk.data))
            twice = np.flatnonzero(found.count[found.pair] > 1)
            for a, b in zip(found.first[twice].tolist(), (found.last[twice] + length).tolist(), strict=True):
                gone[a:b] = True
            cut, _ = _runs(chunk, gone)
            return pa.RecordBatch.from_arrays([pa.array(chunk.doc_ids, pa.int64()), pa.array(np.diff(chunk.offsets)), pa.array(cut)], ["doc_id", "n_bytes", "n_repeated"])

        with workspace(self.spark) as work:
            chunks = chunked(work, docs, doc_id, text)
            mail = answers(work, chunks, ask, None, shards)
            kept = self.levels()
            told = work.written(mail.groupBy("shard").cogroup(kept.groupBy("shard")).applyInArrow(scan, "shard int, bundle long, serial string, rank int, data binary"), "scanned")
            told.filter("serial IS NOT NULL AND data IS NOT NULL").select("shard", "serial", "rank", "data").write.mode("overwrite").parquet(f"{self.folder}/levels-{n}")
            told.filter("serial IS NOT NULL").select("shard", "serial").write.mode("overwrite").parquet(f"{self.folder}/live-{n}")
            replies = told.filter("serial IS NULL").select(F.lit(1).alias("round"), "shard", "bundle", "data")
            out = work.written(mapped(chunks, finish, "doc_id long, n_bytes long, n_repeated long", [replies]), "repeated", stay=True)
        self.spark.createDataFrame([(n,)], "version int").coalesce(1).write.mode("append").json(f"{self.folder}/versions")  # from now on the batch is in
        return out


def kept_bytes(chunk: Chunk, gone: np.ndarray) -> list[bytes]:
    """The bytes of each document that stay, in order."""
    sums = np.concatenate([[0], np.cumsum(~gone)])
    raw, edges = chunk.data[~gone].tobytes(), sums[chunk.offsets].tolist()
    return [raw[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _runs(chunk: Chunk, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Removed bytes, and maximal runs of them, of each document."""
    n = len(chunk.offsets) - 1
    doc = owners(chunk.offsets)
    opens = gone.copy()
    opens[1:] &= ~(gone[:-1] & (doc[1:] == doc[:-1]))
    return np.bincount(doc[gone], minlength=n), np.bincount(doc[opens], minlength=n)


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and `kept`: the text without its repeated strings, as
    UTF-8 bytes; a cut can fall inside a character."""

    def out(chunk, gone):
        cut, spans = _runs(chunk, gone)
        return pa.RecordBatch.from_arrays([pa.array(chunk.doc_ids, pa.int64()), pa.array(np.diff(chunk.offsets)), pa.array(cut), pa.array(spans), pa.array(kept_bytes(chunk, gone), pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return _finished(docs, out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", length, gram, doc_id, text)


def _finished(docs, out, schema, *names) -> DataFrame:
    """The result as a table, so that what led to it can go."""
    with workspace(docs.sparkSession) as work:
        return work.written(removed_bytes(work, docs, out, schema, *names), "suffix-dedup", stay=True)


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """`docs` with every repeated string cut from its texts. Of a character cut in two, nothing
    stays. Rows are matched by id and digest of the text; rows without a cut stay untouched."""

    def out(chunk, gone):
        cut, _ = _runs(chunk, gone)
        kept, rows = kept_bytes(chunk, gone), np.flatnonzero(cut).tolist()
        digests = [hashlib.md5(chunk.data[chunk.offsets[i] : chunk.offsets[i + 1]]).hexdigest() for i in rows]
        texts = [kept[i].decode(errors="ignore") for i in rows]
        return pa.RecordBatch.from_arrays([pa.array([chunk.doc_ids[i] for i in rows], pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())], ["_id", "_digest", "_text"])

    names = unused(docs, "_id", "_digest", "_text")
    with workspace(docs.sparkSession) as work:
        changed = work.written(removed_bytes(work, docs, out, "_id long, _digest string, _text string", length, gram), "changed", stay=True)
    changed = changed.dropDuplicates(["_id", "_digest"]).toDF(*names)
    match = F.col("doc_id").eqNullSafe(F.col(names[0])) & (F.md5(F.col("text").cast("binary")) == F.col(names[1]))
    return docs.join(changed, match, "left").select(*(F.coalesce(names[2], "text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns))


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    def out(chunk, gone):
        cut, spans = _runs(chunk, gone)
        kept = [hashlib.sha256(x).hexdigest() for x in kept_bytes(chunk, gone)]
        return pa.RecordBatch.from_arrays([pa.array(chunk.doc_ids, pa.int64()), pa.array(np.diff(chunk.offsets)), pa.array(cut), pa.array(spans), pa.array(kept)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _finished(spark.read.parquet(f"{sf_dir}/documents.parquet"), out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


OP5_SQL = r"""
WITH hexed AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), windows AS (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS key FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM hexed WHERE length(h) >= 400)
), twice AS (
  SELECT doc_id, i FROM windows WHERE key IN (SELECT key FROM windows GROUP BY key HAVING count(*) > 1)
), marked AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS opens FROM twice
), numbered AS (
  SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM marked
), runs AS (
  SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM numbered GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM runs
), kept AS (
  SELECT g.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS front, max(b) AS last
  FROM gaps g JOIN hexed USING (doc_id) GROUP BY g.doc_id
)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE front || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM hexed d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
