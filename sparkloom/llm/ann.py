"""Approximate nearest neighbours over stable projections.

Vectors are projected to a few dimensions by a Gaussian (2-stable) matrix; kd-trees hold the
projections. For a pair at distance d, the squared projected distance over d squared follows a
chi-square law with one degree of freedom for each projected dimension. Nodes are visited in the order
of their projected distance, and their rows verified on the original vectors; a query stops at a node
if a row as near as its current k-th would, by that law, have been met with probability `confidence`
already. The upper levels of the tree, learned from a bounded sample, deal the rows to shards
(`vectors`), where the tree goes on; the k-th of the home shard travels to those that pass the test.

The largest inner product becomes the smallest distance by one more component, sqrt(M^2 - |x|^2),
M being the largest length in the table. Every row is indexed. Vectors that are null, empty or zero or
hold null or non-finite components take no part; vectors of several dimensions are an error; ties go
to the smaller id; of rows that share an id each is a candidate, and none is one for a query of that
id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import Best, Described, Tree, search

#: Projected dimensions (an even number) and the probability of the stopping test.
DIMENSIONS, CONFIDENCE = 8, 0.97


def chi_square_cdf(x: np.ndarray, degrees: int) -> np.ndarray:
    """Of an even number of degrees of freedom: one minus a sum of Poisson probabilities."""
    half = np.minimum(np.asarray(x, float) / 2, 700)
    term = total = np.exp(-half)
    for i in range(1, degrees // 2):
        term = term * half / i
        total = total + term
    return 1 - total


def projection(dimensions: int, onto: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dimensions, onto))


def _box(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return part.min(axis=0), part.max(axis=0)


def _longest_side(part: np.ndarray) -> np.ndarray | None:
    spread = np.ptp(part, axis=0)
    return part[:, spread.argmax()] if spread.max() > 0 else None


def _outside(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances to a box; to several, if `low` and `high` have a row for each."""
    low, high = np.atleast_2d(low), np.atleast_2d(high)
    out = np.zeros((len(q), len(low)))
    for d in range(q.shape[1]):
        x = q[:, d : d + 1]
        out += np.maximum(0, np.maximum(low[:, d] - x, x - high[:, d])) ** 2
    return out


class KDTree(Tree):
    """A box of projections for each node."""

    def __init__(self, points: np.ndarray):
        super().__init__(points, _box, _longest_side)

    @property
    def leaves(self) -> list[np.ndarray]:
        return [self.order[a:b] for (a, b), c in zip(self.spans, self.children, strict=True) if c[0] < 0]

    def distances(self, queries: np.ndarray) -> np.ndarray:
        """Squared distances from each query to each leaf's box."""
        last = self.children[:, 0] < 0
        return _outside(queries, self.told[0][last], self.told[1][last])


class Projections:
    """Places are the leaves of a kd-tree over a sample's projections."""

    def __init__(self, dimensions: int, longest: float, onto: int, confidence: float):
        self.pull, self.longest, self.onto, self.confidence = projection(dimensions + 1, onto), longest, onto, confidence

    def prepared(self, x: np.ndarray) -> np.ndarray:
        return x.astype(np.float64)

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        extra = np.sqrt(np.maximum(0, self.longest**2 - (x**2).sum(axis=1)))
        return x @ self.pull[:-1] + extra[:, None] * self.pull[-1]

    def learn(self, sample: np.ndarray, places: int) -> None:
        """Splits (side, value, children) and the boxes of the leaves, unbounded at the rim."""
        points = self.of_rows(sample)
        self.splits, boxes = [], []
        stack = [(points, places, np.full(self.onto, -np.inf), np.full(self.onto, np.inf), -1, 0)]
        while stack:
            part, n, low, high, parent, side = stack.pop()
            spread = np.ptp(part, axis=0) if n > 1 and len(part) > 1 else np.zeros(1)
            if spread.max() <= 0:
                me = -1 - len(boxes)
                boxes.append((low, high))
            else:
                me, along = len(self.splits), int(spread.argmax())
                value = float(np.quantile(part[:, along], (n // 2) / n))
                left = part[:, along] < value
                if not left.any() or left.all():
                    value = float(part[:, along].mean())
                    left = part[:, along] < value
                self.splits.append([along, value, 0, 0])
                cut = [np.where(np.arange(self.onto) == along, value, x) for x in (high, low)]
                stack += [(part[~left], n - n // 2, cut[1], high, me, 3), (part[left], n // 2, low, cut[0], me, 2)]
            if parent >= 0:
                self.splits[parent][side] = me
        self.low, self.high = (np.array(x) for x in zip(*boxes, strict=True))

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, points = np.zeros(len(x), np.int64) if self.splits else np.full(len(x), -1), self.of_rows(x)
        table = np.array([s[1] for s in self.splits]), np.array([[s[0], s[2], s[3]] for s in self.splits], np.int64)
        while (inner := np.flatnonzero(at >= 0)).size:
            here = at[inner]
            right = points[inner, table[1][here, 0]] >= table[0][here]
            at[inner] = np.where(right, table[1][here, 2], table[1][here, 1])
        return -1 - at, np.zeros(len(x))

    def _goes_on(self, far: np.ndarray, length: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """Whether the stopping test fails at a squared projected distance."""
        reach = np.maximum(length + self.longest**2 - 2 * kth, 1e-300)  # squared distance of the k-th
        return ~(chi_square_cdf(np.where(np.isfinite(reach), far / reach, 0), self.onto) >= self.confidence)

    def open_places(self, q: np.ndarray, kth: np.ndarray, widest: np.ndarray) -> np.ndarray:
        open_ = np.zeros((len(q), len(widest)), bool)
        open_[:, : len(self.low)] = self._goes_on(_outside(q @ self.pull[:-1], self.low, self.high), (q**2).sum(axis=1)[:, None], kth[:, None])
        return open_

    def tree(self, x: np.ndarray) -> KDTree:
        return KDTree(self.of_rows(x))

    def answer(self, tree: KDTree, ids, points, q_ids, queries, bounds, k: int) -> Best:
        best, wanted, length = Best(q_ids, k, bounds), queries @ self.pull[:-1], (queries**2).sum(axis=1)
        low, high = tree.told
        slack = 1e-12 * (1 + float(np.sqrt(length.max(initial=0))) * self.longest)

        def test(node, active):
            far = _outside(wanted[active], low[node], high[node])[:, 0]
            stay = self._goes_on(far, length[active], best.kth(active))
            return stay, float(far[stay].min(initial=np.inf))

        def leaf(at, active):  # a product's last bit hangs on the others in its block: scores are summed pair by pair
            best.offer(active, ids[at], queries[active] @ points[at].T, lambda r, c: np.einsum("pd,pd->p", queries[r], points[at[c]]), slack)

        best.passed = tree.descend(len(queries), test, leaf)
        return best


def nearest(table: DataFrame, queries: Column, k: int, onto: int = DIMENSIONS, confidence: float = CONFIDENCE, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest rows found for each row that `queries` (a condition on vec_id) names."""
    if onto < 2 or onto % 2:
        raise ValueError("the number of projected dimensions is even")
    base = Described(table, queries, vec_id, vector, nonzero=True)
    return search(base, k, Projections(base.dimensions, base.longest, onto, confidence), "double")


def op6_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, 20)
