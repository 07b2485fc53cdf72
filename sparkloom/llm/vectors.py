"""What the vector searches share: valid rows, shards by place, one tree a shard, two rounds.

1. Places. A bounded sample (the rows with the smallest hashes of their ids) divides the space into
   places (`Space`, of the operator's own kind), 4096 at most; every row goes to its place. A place of
   more than SHARD_BYTES is split into several shards by a hash of the id, so that no task holds more.
2. Trees. Each shard is gathered once. Its tree is built there, its own queries are answered in it,
   which gives each a k-th score so far, and tree, queries and answers are written as one row.
3. The rest. A block of queries tests its k-th scores against what the driver knows of the places
   (a few numbers for each) and is sent only to the shards of those that can still improve one; a
   cell (block, shard) brings only the queries that passed. Trees are read, never built again.

What is sent grows with queries times the places that they can't rule out; where no place can be ruled
out, as with vectors in random directions, that is the square of the table.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import bounded_batches, workspace

#: Bytes of a shard's vectors (in double precision), of the sample, and queries of a block.
SHARD_BYTES, SAMPLE_BYTES, BLOCK_ROWS = 4 << 20, 16 << 20, 1024
PLACES, SAMPLE_ROWS, LEAF = 4096, 16, 128
_SHARD = "shard int, place int, tree binary, queries binary, found binary"


class Described:
    """The rows that take part, and what one pass over them tells."""

    def __init__(self, table: DataFrame, queries: Column, vec_id: str, vector: str, nonzero: bool):
        element = table.schema[vector].dataType.elementType.simpleString()
        self.type = "float" if element == "float" else "double"
        finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
        rows = table.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast(f"array<{self.type}>").alias("v"))
        rows = rows.filter(F.col("vec_id").isNotNull() & (F.size("v") > 0)).filter(F.forall("v", finite))
        if nonzero:
            rows = rows.filter(F.exists("v", lambda x: x != 0))
        self.rows = rows.withColumn("q", F.coalesce(queries, F.lit(False)))
        squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        told = self.rows.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v")), F.max(squares)).first()
        self.n, self.dimensions, most, self.longest = told[0], told[1] or 1, told[2] or 1, (told[3] or 0.0) ** 0.5
        if self.dimensions != most:
            raise ValueError(f"vectors of {self.dimensions} and of {most} components: an inner product needs one dimension")

    def sample(self, rows: int) -> np.ndarray:
        """Distinct vectors among the rows with the smallest hashes; bounded by SAMPLE_BYTES too."""
        most = max(1, min(rows, SAMPLE_BYTES // (8 * self.dimensions)))
        got = self.rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).select("v").collect()
        return np.unique(np.array([r[0] for r in got], np.float64).reshape(-1, self.dimensions), axis=0)


def unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors as rows."""
    v = batch.column(batch.schema.get_field_index("v"))
    return batch.column(batch.schema.get_field_index("vec_id")).to_numpy(zero_copy_only=False), v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)


def halved(points: np.ndarray, most: int, least: int, direction: Callable) -> list[np.ndarray]:
    """Rows of `points` in up to `most` parts, each halved along its `direction` while large."""
    parts = [np.arange(len(points))]
    while len(parts) < most:
        parts.sort(key=len)
        rows = parts.pop()
        along = direction(points[rows]) if len(rows) >= 2 * least else None
        if along is None:
            parts.append(rows)
            break
        half = len(rows) // 2
        rows = rows[np.argpartition(along, half)]
        parts += [rows[:half], rows[half:]]
    return parts


def search(base: Described, k: int, space, score: str) -> DataFrame:
    """The k best of each query: query_id, rank, vec_id, score.

    `space` divides the vectors into places and searches a shard:
    - `learn(sample, places)`; `assign(x)` gives each row's place and a number whose maximum over the
      place (`widest`) it wants to know; `open_places(q, kth, widest)` says which places can improve a query;
    - `tree(x)` builds a tree, `answer(tree, ids, x, q_ids, q, kth)` gives a `Best`.
    """
    spark, types = base.rows.sparkSession, {"float": np.float32, "double": np.float64}
    kind, d, none = types[base.type], base.dimensions, np.iinfo(np.int64).max
    room = max(1, SHARD_BYTES // (8 * d))
    wanted = min(PLACES, max(1, -(-base.n // room)))
    space.learn(base.sample(SAMPLE_ROWS * wanted), wanted)
    bounded_batches(spark)

    def count(batches):
        for batch in batches:
            ids, x = unpacked(batch)
            place, far = space.assign(x.astype(np.float64))
            names, which, n = np.unique(place, return_inverse=True, return_counts=True)
            most = np.full(len(names), -np.inf)
            np.maximum.at(most, which, far)
            yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(most)], ["place", "n", "far"])

    def place_rows(batches):
        for batch in batches:
            ids, x = unpacked(batch)
            place, _ = space.assign(x.astype(np.float64))
            raw, size = np.ascontiguousarray(x.astype(kind)).tobytes(), d * kind().itemsize
            yield pa.RecordBatch.from_arrays([pa.array(ids), batch.column(2), pa.array(place.astype(np.int32)), pa.array([raw[i : i + size] for i in range(0, len(raw), size)], pa.binary())], ["vec_id", "q", "place", "v"])

    with workspace(spark) as work:
        told = base.rows.select("vec_id", "v").mapInArrow(count, "place int, n long, far double").groupBy("place").agg(F.sum("n").alias("n"), F.max("far").alias("far")).collect()  # PLACES rows at most
        widest, shards = np.full(wanted, -np.inf), np.zeros(wanted, np.int64)
        for r in told:
            widest[r["place"]], shards[r["place"]] = r["far"], -(-r["n"] // room)
        first = np.cumsum(shards) - shards

        def build(table):
            table = table.combine_chunks()
            ids, q = table.column("vec_id").to_numpy(), table.column("q").to_numpy(zero_copy_only=False)
            x = np.frombuffer(b"".join(table.column("v").to_pylist()), kind).reshape(len(ids), d)
            order = np.argsort(ids, kind="stable")
            ids, q, x = ids[order], q[order], x[order]
            full = space.prepared(x)
            tree = space.tree(full)
            asked = [r for r in (np.flatnonzero(q)[i : i + BLOCK_ROWS] for i in range(0, int(q.sum()), BLOCK_ROWS))]
            best = [space.answer(tree, ids, full, ids[r], full[r], np.full(len(r), -np.inf), k) for r in asked]
            queries = [(ids[r], x[r], b.kth()) for r, b in zip(asked, best, strict=True)]
            found = [b.found(ids[r]) for r, b in zip(asked, best, strict=True)]
            one = table.slice(0, 1)
            return pa.table([one.column("shard"), one.column("place"), *(pa.array([pickle.dumps(p)], pa.binary()) for p in ((tree, ids, x), queries, found))], ["shard", "place", "tree", "queries", "found"])

        at = F.col("place") + 1
        part = F.pmod(F.xxhash64("vec_id"), F.element_at(F.lit(np.maximum(shards, 1).tolist()), at)) + F.element_at(F.lit(first.tolist()), at)
        placed = base.rows.select("vec_id", "v", "q").mapInArrow(place_rows, "vec_id long, q boolean, place int, v binary").withColumn("shard", part.cast("int"))
        trees = work.written(placed.groupBy("shard").applyInArrow(build, _SHARD), "trees")

        def send(batches):
            for batch in batches:
                for home, blocks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for ids, x, kth in pickle.loads(blocks):
                        open_ = space.open_places(space.prepared(x), kth, widest)
                        for place in np.flatnonzero(open_.any(axis=0) & (shards > 0)).tolist():
                            some = open_[:, place]
                            block = pickle.dumps((ids[some], x[some], kth[some]))
                            to = [s for s in range(int(first[place]), int(first[place] + shards[place])) if s != home]
                            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([block] * len(to), pa.binary())], ["shard", "block"])

        opened: dict = {}

        def answer(batches):
            for batch in batches:
                for shard, tree, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if opened.get("shard") != shard:  # cells of a shard follow one another
                        root, ids, x = pickle.loads(tree)
                        opened.update(shard=shard, parts=(root, ids, space.prepared(x)))
                    root, ids, x = opened["parts"]
                    q_ids, q, kth = pickle.loads(block)
                    yield _rows(space.answer(root, ids, x, q_ids, space.prepared(q), kth, k).found(q_ids), score)

        def own(batches):
            for batch in batches:
                for blocks in batch.column(0).to_pylist():
                    for found in pickle.loads(blocks):
                        yield _rows(found, score)

        out = f"query_id long, vec_id long, score {score}"
        cells = trees.select("shard", "queries").mapInArrow(send, "shard int, block binary")
        others = trees.select("shard", "tree").join(cells, "shard").select("shard", "tree", "block").mapInArrow(answer, out)
        return work.written(best_of(trees.select("found").mapInArrow(own, out).unionByName(others), k), "nearest", stay=True)


def _rows(found, score: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.int64() if score == "long" else pa.float64())], ["query_id", "vec_id", "score"])


def best_of(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


class Best:
    """The k best rows of each query so far, ties to the smaller id, given a bound on the k-th score."""

    def __init__(self, q_ids: np.ndarray, k: int, bounds: np.ndarray, kind=np.float64):
        self.q_ids, self.k, self.none = q_ids, k, np.iinfo(np.int64).max
        self.worst = np.iinfo(np.int64).min + 1 if kind == np.int64 else -np.inf
        self.score = np.full((len(q_ids), k), self.worst, kind)
        self.ids = np.full((len(q_ids), k), self.none)
        self.least = np.where(np.isnan(bounds), -np.inf, bounds).astype(np.float64)

    def kth(self, rows=slice(None)) -> np.ndarray:
        """A row below this cannot enter."""
        return self.least[rows]

    def offer(self, rows: np.ndarray, ids: np.ndarray, score: np.ndarray, exact: Callable | None = None, slack: float = 0.0) -> None:
        """Candidates with their scores (queries x candidates) for some queries. Where scores carry an
        error of up to `slack`, `exact(row, column)` gives the true ones of those that can enter."""
        may = (score >= self.least[rows][:, None] - slack) & (ids[None, :] != self.q_ids[rows][:, None])
        some = np.flatnonzero(may.any(axis=1))
        if not len(some):
            return
        may, mine = may[some], rows[some]
        new = np.where(may, score[some], self.worst).astype(self.score.dtype)
        if exact:
            r, c = np.nonzero(may)
            new[r, c] = exact(mine[r], c)
        width = min(new.shape[1], max(1, int(may.sum(axis=1).max())))
        if width < new.shape[1]:  # the candidates of a query to the front, in order of id
            front = np.argsort(~may, axis=1, kind="stable")[:, :width]
            new, who = np.take_along_axis(new, front, 1), np.where(np.take_along_axis(may, front, 1), ids[front], self.none)
        else:
            who = np.where(may, ids[None, :], self.none)
        s, i = np.concatenate([self.score[mine], new], axis=1), np.concatenate([self.ids[mine], who], axis=1)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[mine], self.ids[mine] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        full = self.ids[mine, -1] != self.none
        self.least[mine] = np.where(full, np.maximum(self.least[mine], self.score[mine, -1].astype(np.float64)), self.least[mine])

    def found(self, q_ids: np.ndarray):
        real = self.ids != self.none
        return np.repeat(q_ids, real.sum(axis=1)), self.ids[real], self.score[real]


class Tree:
    """Nodes in arrays; the rows of a node are consecutive in `order`. `split(part)` gives the values
    along which a node is halved, or None; `describe(part)` what `node` keeps of it."""

    def __init__(self, points: np.ndarray, describe: Callable, split: Callable, leaf: int = LEAF):
        self.order = np.arange(len(points))
        spans, told, children, stack = [], [], [], [(0, len(points), -1, 0)]
        while stack:
            start, end, parent, side = stack.pop()
            rows = self.order[start:end]
            part, at = points[rows], len(spans)
            spans.append((start, end))
            told.append(describe(part))
            children.append([-1, -1])
            if parent >= 0:
                children[parent][side] = at
            along = split(part) if end - start > leaf else None
            if along is not None:
                half = (end - start) // 2
                self.order[start:end] = rows[np.argpartition(along, half)]
                stack += [(start + half, end, at, 1), (start, start + half, at, 0)]
        self.spans, self.children = np.array(spans), np.array(children)
        self.told = [np.array(x) for x in zip(*told, strict=True)]

    def descend(self, n: int, test: Callable, leaf: Callable, slice_: int = LEAF) -> int:
        """Best first: `test(node, queries)` gives those that the node can still serve and a number, the
        smaller the sooner; `leaf(rows, queries)` looks at rows. The number of leaves' tests passed."""
        heap, passed = [(0.0, 0, np.arange(n))], 0
        while heap:
            _, node, active = heapq.heappop(heap)
            stay, _ = test(node, active)  # k-th scores may have risen since
            active = active[stay]
            if not len(active):
                continue
            if self.children[node, 0] < 0:
                passed += len(active)
                start, end = self.spans[node]
                for at in range(start, end, slice_):  # equal rows can fill a larger leaf
                    leaf(self.order[at : min(end, at + slice_)], active)
                continue
            for child in self.children[node].tolist():
                stay, near = test(child, active)
                if stay.any():
                    heapq.heappush(heap, (near, child, active[stay]))
        return passed
