"""Exact top-k search by inner product with ball trees.

Vectors go to the nearest of the centres that a bounded sample gives (`vectors`); each shard holds a
ball tree. The best score that a query can reach in a ball is q.c + |q| r, so a block of queries
descends branch and bound: the node with the largest upper bound first, and only with those queries
whose bound is not below their current k-th score. The k-th score of a query's home shard travels
with it, and it travels only to the places whose ball can beat that score.

Scores are integers: a component x counts as floor(scale * x). Vectors that are null or empty or hold
null or non-finite components take no part; vectors of several dimensions are an error; ties go to
the smaller id; equal vectors are all candidates; an empty table gives an empty result; other columns
are ignored. Of rows that share an id, each is a candidate, and none is one for a query of that id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import Best, Described, Tree, halved, search


def _widest(part: np.ndarray) -> np.ndarray | None:
    """Places along the line from the row farthest from the middle to the one farthest from that."""
    far = ((part - part.mean(axis=0)) ** 2).sum(axis=1)
    a = part[far.argmax()]
    b = part[((part - a) ** 2).sum(axis=1).argmax()]
    return part @ (b - a) if far.max() > 0 else None


def _ball(part: np.ndarray) -> tuple[np.ndarray, float]:
    center = part.mean(axis=0)
    return center, float(np.sqrt(((part - center) ** 2).sum(axis=1).max(initial=0)))


class BallTree(Tree):
    def __init__(self, points: np.ndarray):
        super().__init__(points, _ball, _widest)


def _upper(reach: np.ndarray, length: np.ndarray, center: np.ndarray, radius) -> np.ndarray:
    """The largest inner product in a ball, from that with its center; never too small by rounding."""
    reach = reach + length * radius
    return reach + 1e-9 * (np.abs(reach) + length * (radius + np.abs(center).max(axis=-1))) + 1e-6


class Balls:
    """Places by the nearest center; the largest distance to it bounds a place."""

    def __init__(self, k: int, scale: float):
        self.k, self.scale = k, scale

    def prepared(self, x: np.ndarray) -> np.ndarray:
        return np.floor(x.astype(np.float64) * self.scale)

    def learn(self, sample: np.ndarray, places: int) -> None:
        x = self.prepared(sample)
        self.centers = np.array([x[rows].mean(axis=0) for rows in halved(x, places, 1, _widest)]) if len(x) else np.zeros((1, 1))

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.prepared(x)
        near = np.concatenate([((self.centers**2).sum(axis=1) - 2 * (x[i : i + 4096] @ self.centers.T)).argmin(axis=1) for i in range(0, len(x), 4096)])
        return near, np.sqrt(((x - self.centers[near]) ** 2).sum(axis=1))

    def open_places(self, q: np.ndarray, kth: np.ndarray, widest: np.ndarray) -> np.ndarray:
        length = np.sqrt((q**2).sum(axis=1))[:, None]
        wide = widest[: len(self.centers)]
        inside = np.where(np.isfinite(wide), wide, 0)
        open_ = np.zeros((len(q), len(widest)), bool)
        open_[:, : len(wide)] = _upper(q @ self.centers.T, length, self.centers, inside) >= kth[:, None]
        return open_

    tree = staticmethod(BallTree)

    def answer(self, tree: BallTree, ids, points, q_ids, queries, bounds, k: int) -> Best:
        """The inputs hold whole numbers; products stay exact, in double precision as long as that holds them."""
        top = np.abs(points).max(initial=0) * np.abs(queries).max(initial=0) * points.shape[1]
        kind = np.float64 if top < 2**53 else np.int64
        rows, wanted, best = points.astype(kind), queries.astype(kind), Best(q_ids, k, bounds, np.int64)
        length = np.sqrt((queries**2).sum(axis=1))
        centers, radii = tree.told

        def test(node, active):
            reach = _upper(queries[active] @ centers[node], length[active], centers[node], radii[node])
            stay = reach >= best.kth(active)
            return stay, -float(reach[stay].max(initial=-np.inf))

        best.passed = tree.descend(len(queries), test, lambda at, active: best.offer(active, ids[at], (wanted[active] @ rows[at].T).astype(np.int64)))
        return best


def ball_search(ids: np.ndarray, points: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int):
    """(query_id, vec_id, score) of each query's k best rows, its own id excluded; whole numbers."""
    return Balls(k, 1.0).answer(BallTree(points), ids, points, query_ids, queries, bounds, k).found(query_ids)


def exact_topk(table: DataFrame, queries: Column, k: int, scale: float = 256.0, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k best rows for each row that `queries` (a condition on vec_id) names."""
    return search(Described(table, queries, vec_id, vector, nonzero=False), k, Balls(k, scale), "long")


def op4_exact_topk(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return exact_topk(table, F.col("vec_id") % 50 == 0, 5)


OP4_SQL = """
WITH base AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, b.vec_id,
         list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * b.v[i]))::BIGINT AS score
  FROM base q JOIN base b ON q.vec_id <> b.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
) SELECT * FROM ranked WHERE rank <= 5
"""
