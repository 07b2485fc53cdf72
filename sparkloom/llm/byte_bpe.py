"""Byte-level BPE encoding and decoding of whole texts.

A text is split by the tokenizer's pattern; each piece is merged on its own. A piece's bytes are
the leaves of a segment tree: a leaf holds the rank of the pair that starts at its live node, an
inner node the leftmost smallest below it. The root names the next merge; a merge changes three
leaves (the node, the neighbour it swallows, the live node before it) and their paths to the root.
Pieces that a task has not met before are merged together, as rows of one array of trees; a few
pieces of one width are merged one by one, each in a tree of plain numbers. Pieces met before come
from a memo of bounded size.

Nulls count as empty texts, which have no tokens; texts may be of any length; equal rows give
equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import slices
from .scratch import bounded_batches

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pieces that a worker remembers; beyond that it starts afresh.
MEMO = 400_000
_NONE = np.int64(1) << 62
#: Tree nodes that are merged at once.
_NODES = 1 << 20
#: Pieces below which a round of array calls costs more than a merge in each tree of plain numbers.
_FEW = 12


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.pieces = regex.compile(pattern).findall
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[(a << 32) | b] = rank
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.memo: dict[str, tuple[int, ...]] = {}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of merging tokens a and b; _NONE where they don't merge."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NONE)

    def merged(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The token ids of each piece."""
        out: list = [None] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                out[i] = (whole,)
            else:
                by_width.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
        for width, which in by_width.items():
            step = max(1, _NODES // width)
            for at in range(0, len(which), step):
                part = which[at : at + step]
                chosen = [pieces[i] for i in part]
                found = self._trees(chosen, width) if len(part) >= _FEW else (self._tree(p, width) for p in chosen)
                for i, ids in zip(part, found, strict=True):
                    out[i] = ids
        return out

    def _tree(self, piece: bytes, width: int) -> tuple[int, ...]:
        """The ids of one piece; a path is climbed only as far as its minimum changes."""
        n, none, ranks = len(piece), int(_NONE), self.pairs.get
        token = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        tree = [none] * (2 * width)
        for i in range(n - 1):
            if (rank := ranks((token[i] << 32) | token[i + 1])) is not None:
                tree[width + i] = rank * width + i
        for at in range(width - 1, 0, -1):
            tree[at] = min(tree[2 * at], tree[2 * at + 1])

        def put(place: int, rank: int | None) -> None:
            at = width + place
            value = none if rank is None else rank * width + place
            while tree[at] != value:
                tree[at] = value
                if at == 1:
                    break
                other = tree[at ^ 1]
                value = value if value < other else other
                at >>= 1

        while (best := tree[1]) < none:
            rank, i = divmod(best, width)
            j = after[i]
            k = after[j]
            token[i], token[j], after[i] = rank, None, k
            put(j, None)
            if k < n:
                before[k] = i
                put(i, ranks((rank << 32) | token[k]))
            else:
                put(i, None)
            if (p := before[i]) >= 0:
                put(p, ranks((token[p] << 32) | rank))
        return tuple(t for t in token if t is not None)

    def _trees(self, pieces: list[bytes], width: int):
        n, size = len(pieces), np.array([len(p) for p in pieces])
        place = np.arange(width)
        token = self.byte_ids[np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8)].reshape(n, width)
        live = place < size[:, None]
        after = np.where(place + 1 < size[:, None], place + 1, width)
        before = np.broadcast_to(place - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), _NONE)
        first = self.rank(token[:, :-1].ravel(), token[:, 1:].ravel()).reshape(n, width - 1)
        tree[:, width:-1] = np.where((first < _NONE) & live[:, 1:], first * width + place[:-1], _NONE)
        level = width
        while level > 1:
            level //= 2
            np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2], out=tree[:, level : 2 * level])
        flat, row = tree.ravel(), np.flatnonzero(tree[:, 1] < _NONE)
        while len(row):
            best = tree[row, 1]
            i, rank = best % width, best // width
            j = after[row, i]
            k = after[row, j]
            token[row, i], after[row, i], live[row, j] = rank, k, False
            has = k < width
            before[row[has], k[has]] = i[has]
            p = before[row, i]
            had = p >= 0
            follows = np.where(has, self.rank(rank, token[row, np.minimum(k, width - 1)]), _NONE)
            leads = np.where(had, self.rank(token[row, np.maximum(p, 0)], rank), _NONE)
            base = row * (2 * width)
            leaf = width + np.concatenate([i, j, np.where(had, p, i)])
            value = np.concatenate([follows, np.full(len(row), _NONE), np.where(had, leads, follows)])
            at = np.concatenate([base, base, base])
            flat[at + leaf] = np.where(value < _NONE, value * width + (leaf - width), _NONE)
            level = width
            while level > 1:
                level //= 2
                leaf >>= 1
                flat[at + leaf] = np.minimum(flat[at + 2 * leaf], flat[at + 2 * leaf + 1])
            row = row[tree[row, 1] < _NONE]
        ids, ends = token[live].tolist(), np.cumsum(live.sum(axis=1)).tolist()
        start = 0
        for end in ends:
            yield tuple(ids[start:end])
            start = end

    def encode_all(self, texts: list[str]):
        """The token ids of each text."""
        split = [self.pieces(t) for t in texts]
        new = set().union(*split).difference(self.memo)
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = set().union(*split)
        fresh = list(new)
        self.memo.update(zip(fresh, self.merged([p.encode() for p in fresh]), strict=True))
        known = self.memo.__getitem__
        for pieces in split:
            yield list(chain.from_iterable(map(known, pieces)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(4)
def load(path: str | None = None, pattern: str | None = None) -> ByteBPE:
    """The tokenizer of a rank file; by default the installed public one."""
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return ByteBPE(ranks, pattern)


def _each(batches, path, pattern, out):
    bpe = load(path, pattern)
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        sizes = np.array([0, *np.cumsum(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False))], np.int64)
        for i, j in slices(sizes):
            part = [t or "" for t in texts.slice(i, j - i).to_pylist()]
            yield out(bpe, ids.slice(i, j - i), bpe.encode_all(part))


def _two(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and its token ids."""

    def out(_, ids, encoded):
        return pa.RecordBatch.from_arrays([ids, pa.array(list(encoded), pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _two(docs, doc_id, text).mapInArrow(lambda b: _each(b, path, pattern, out), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and the bytes that its ids stand for."""

    def run(batches):
        bpe = load(path, pattern)
        for batch in batches:
            data = [bpe.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    bounded_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def op8_byte_bpe(spark, sf_dir: str) -> DataFrame:
    def out(bpe, doc_ids, encoded):
        names = _names(len(bpe.tokens))
        n, ids_sha, data_sha = [], [], []
        for ids in encoded:
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
            data_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([doc_ids, pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(data_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return _two(docs, "doc_id", "text").mapInArrow(lambda b: _each(b, None, None, out), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


@lru_cache(1)
def _names(n: int) -> list[str]:
    return [str(i) for i in range(n)]
