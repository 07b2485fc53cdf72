"""Questions and answers between chunks of documents and shards of hashes.

A chunk is a run of documents of about a megabyte, kept compressed as one row; up to BUNDLE chunks
that one task wrote form a bundle. To learn which of its hashes occur elsewhere, a chunk sends each
shard one packed array of its distinct hashes; what the chunks of a bundle send to a shard travels as
one row, and so do the packed answers. Rows are few and large (never more than hashes), a key that
fills the corpus costs an entry per chunk rather than per document, and no text moves to the shards.

A task holds one bundle, or what one shard was asked: shards are as many as the shuffle has
partitions, and more where one would answer for more than SHARD_TEXT bytes of text.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import slices, texts_of
from .scratch import Workspace, bounded_batches, partitions

CHUNK_BYTES, BUNDLE, SHARD_TEXT = 1 << 20, 16, 256 << 20
#: Bytes of questions that a task gathers before it sends them.
_FLUSH = 48 << 20
_CHUNK = "chunk long, bundle long, doc_ids array<long>, offsets binary, size long, data binary"
_MAIL = "shard int, bundle long, data binary"


def _squeeze(raw) -> bytes:
    return pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


class Answered:
    """A row with an id that shards reply to."""

    def __init__(self, row: dict, answers: dict[int, dict[int, bytes]] | None = None):
        self.id, self.bundle, self._answers = row["chunk"], row["bundle"], answers or {}

    def answers(self, number: int = 1) -> dict[int, bytes]:
        """The replies of a round, by shard."""
        return self._answers.get(number, {})


class Chunk(Answered):
    """A chunk as the operators see it: ids, offsets and the concatenated bytes."""

    def __init__(self, row: dict, answers: dict[int, dict[int, bytes]] | None = None):
        super().__init__(row, answers)
        self.doc_ids = row["doc_ids"]
        self.offsets = np.frombuffer(row["offsets"], np.int64)
        raw = pa.Codec("zstd").decompress(row["data"], row["size"], asbytes=True) if row["size"] else b""
        self.data = np.frombuffer(raw, np.uint8)


def _rows(batch: pa.RecordBatch | pa.Table) -> Iterator[dict]:
    for k in range(batch.num_rows):
        yield {n: batch.column(i)[k].as_py() for i, n in enumerate(batch.schema.names)}


def chunked(work: Workspace, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents as a written table of chunks. Null texts count as empty."""

    def pack(batches):
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            data, offsets = texts_of(batch.column(1))
            for i, j in slices(offsets, CHUNK_BYTES):
                raw = data[offsets[i] : offsets[j]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([(part << 32) + n], pa.int64()),
                        pa.array([(part << 32) + n // BUNDLE], pa.int64()),
                        pa.array([batch.column(0).slice(i, j - i).to_pylist()], pa.list_(pa.int64())),
                        pa.array([(offsets[i : j + 1] - offsets[i]).tobytes()], pa.binary()),
                        pa.array([len(raw)], pa.int64()),
                        pa.array([_squeeze(np.ascontiguousarray(raw)) if len(raw) else b""], pa.binary()),
                    ],
                    ["chunk", "bundle", "doc_ids", "offsets", "size", "data"],
                )
                n += 1

    bounded_batches(docs.sparkSession)
    two = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return work.written(two.mapInArrow(pack, _CHUNK), "chunks")


def shards_for(chunks: DataFrame) -> int:
    """How many shards answer for these chunks."""
    size = chunks.agg(F.sum("size")).first()[0] or 0
    return max(partitions(chunks.sparkSession), -(-size // SHARD_TEXT))


class _Outbox:
    """What the chunks of a bundle ask, one row for each shard."""

    def __init__(self):
        self.bundle, self.size, self.by_shard = None, 0, {}

    def add(self, bundle: int, chunk: int, asked) -> Iterator[pa.RecordBatch]:
        if self.bundle != bundle or self.size > _FLUSH:
            yield from self.flush()
            self.bundle = bundle
        for shard, data in asked:
            self.by_shard.setdefault(shard, []).append((chunk, data))
            self.size += len(data)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.by_shard:
            mail = [pickle.dumps(x) for x in self.by_shard.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(self.by_shard), pa.int32()), pa.array([self.bundle] * len(mail), pa.int64()), pa.array(mail, pa.binary())], ["shard", "bundle", "data"])
        self.size, self.by_shard = 0, {}


def answers(
    work: Workspace,
    chunks: DataFrame,
    ask: Callable[[Answered, int], Iterator[tuple[int, bytes]]],
    answer: Callable[[list[bytes]], list[bytes]] | None,
    shards: int,
    number: int = 1,
    told: DataFrame | None = None,
    kind: type[Answered] = Chunk,
) -> DataFrame:
    """What each shard replied to `ask(chunk, shards)`, as a written table. `told` are the replies of
    earlier rounds; `answer` gets all that was asked of a shard and returns a reply for each. Without
    it: what was asked, not written."""

    def asks(batches):
        box = _Outbox()
        for batch in batches:
            for row in _rows(batch):
                chunk = kind(row)
                yield from box.add(row["bundle"], chunk.id, ask(chunk, shards))
        yield from box.flush()

    def asks_again(bundle):
        box = _Outbox()
        for chunk, at in bundle:
            yield from box.add(at, chunk.id, ask(chunk, shards))
        yield from box.flush()

    def replies(batches):
        by_shard: dict[int, list] = {}
        for batch in batches:
            for row in _rows(batch):
                by_shard.setdefault(row["shard"], []).append((row["bundle"], pickle.loads(row["data"])))
        for shard, got in by_shard.items():
            said = iter(answer([data for _, mail in got for _, data in mail]))
            for bundle, mail in got:
                back = pickle.dumps([(chunk, next(said)) for chunk, _ in mail])
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([bundle], pa.int64()), pa.array([back], pa.binary())], ["shard", "bundle", "data"])

    asked = chunks.mapInArrow(asks, _MAIL) if told is None else _bundles(chunks, told, asks_again, _MAIL, kind)
    if answer is None:
        return asked
    asked = asked.repartitionById(shards, F.col("shard"))
    return work.written(asked.mapInArrow(replies, _MAIL).select(F.lit(number).alias("round"), "shard", "bundle", "data"), "answers")


def _bundles(chunks: DataFrame, told: DataFrame, out: Callable, schema: str, kind: type[Answered]) -> DataFrame:
    """`out` of the chunks of each bundle (pairs of chunk and bundle), which know the replies so far."""
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(chunks.sparkSession.createDataFrame([], schema).schema)

    def run(left, right):
        said: dict[int, dict] = {}
        for row in _rows(right):
            for chunk, data in pickle.loads(row["data"]):
                said.setdefault(chunk, {}).setdefault(row["round"], {})[row["shard"]] = data
        got = list(out((kind(row, said.get(row["chunk"])), row["bundle"]) for row in _rows(left)))
        return pa.Table.from_batches([b.cast(target) for b in got], target)

    return chunks.groupBy("bundle").cogroup(told.groupBy("bundle")).applyInArrow(run, schema)


def mapped(chunks: DataFrame, out: Callable[[Answered], pa.RecordBatch], schema: str, told: list[DataFrame] | None = None, kind: type[Answered] = Chunk) -> DataFrame:
    """One record batch for each chunk, which knows the replies `told`."""

    def run(batches):
        for batch in batches:
            for row in _rows(batch):
                yield out(kind(row))

    if told is None:
        return chunks.mapInArrow(run, schema)
    return _bundles(chunks, reduce(DataFrame.unionByName, told), lambda bundle: (out(chunk) for chunk, _ in bundle), schema, kind)
