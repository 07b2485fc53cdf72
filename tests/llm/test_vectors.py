
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import ann, exact_topk, vectors

NAN, INF = float("nan"), float("inf")


def table(spark, n=300, d=6, seed=0, extra=()):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(5, d))
    rows = [(i, (centers[i % 5] + 0.4 * rng.normal(size=d)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n, rows[7 % n][1]), (n + 1, rows[7 % n][1]), (n + 2, None), (n + 3, [1.0] * (d - 1) + [None]), (n + 4, [NAN] * d), (n + 5, [INF] * d), (None, rows[3 % n][1]), (n + 7, []), (n + 8, [0.0] * d)]
    rows += list(extra)
    return rows, spark.createDataFrame([(i, v, 1, 2, 3, 4.0) for i, v in rows], "vec_id long, embedding array<float>, shard int, block int, rank int, score double").repartition(3)


def valid_rows(rows, d, zero):
    ok = lambda v: v is not None and len(v) == d and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))
    kept = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and ok(v)]
    return np.array([i for i, _ in kept]), np.array([v for _, v in kept])


def brute(ids, x, q, k):
    score = x @ x[q]
    order = np.lexsort((ids, -score))
    return [(int(ids[j]), score[j]) for j in order if ids[j] != ids[q]][:k]


@pytest.mark.parametrize(("shard_rows", "block_rows"), [(8192, 1024), (40, 7), (3, 5)])
def test_exact_topk(spark, monkeypatch, shard_rows, block_rows):
    monkeypatch.setattr(vectors, "SHARD_BYTES", 8 * 6 * shard_rows)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block_rows)
    rows, df = table(spark)
    ids, x = valid_rows(rows, 6, True)
    x = np.floor(256 * x)
    got = {}
    for r in exact_topk.exact_topk(df, F.col("vec_id") % 10 == 0, 5).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    asked = [i for i in range(len(ids)) if ids[i] % 10 == 0]
    assert set(got) == {int(ids[i]) for i in asked}
    for i in asked:
        assert [got[ids[i]][r] for r in range(1, 6)] == brute(ids, x, i, 5)


def test_exact_topk_few_rows(spark):
    _, df = table(spark, 3)
    few = df.filter("vec_id < 3")
    assert exact_topk.exact_topk(few, F.col("vec_id") == 0, 5).count() == 2
    assert exact_topk.exact_topk(few.limit(0), F.col("vec_id") == 0, 5).count() == 0
    assert exact_topk.exact_topk(few.filter("vec_id = 0"), F.col("vec_id") == 0, 5).count() == 0


@pytest.mark.parametrize("kind", ["exact", "near"])
def test_common_vector_fills_several_shards(spark, monkeypatch, kind):
    monkeypatch.setattr(vectors, "SHARD_BYTES", 8 * 6 * 20)
    rows, _ = table(spark, 60)
    rows = [(i, v) for i, v in rows if i is not None and i < 60] + [(i, [1.0, 0.5, 0.25, 0.0, 0.0, 0.5]) for i in range(60, 160)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    ids, x = valid_rows(rows, 6, True)
    if kind == "exact":
        x = np.floor(256 * x)
        found = exact_topk.exact_topk(df, F.col("vec_id") % 10 == 0, 5).collect()
    else:
        found = ann.nearest(df, F.col("vec_id") % 10 == 0, 5).collect()
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in found}
    mine = [(got[ids[i], r + 1], want) for i in range(0, len(ids), 10) for r, (want, _) in enumerate(brute(ids, x, i, 5))]
    assert np.mean([a == b for a, b in mine]) >= (1 if kind == "exact" else 0.9)


def test_several_dimensions_are_an_error(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "vec_id long, embedding array<float>")
    for run in (exact_topk.exact_topk, ann.nearest):
        with pytest.raises(ValueError, match="components"):
            run(df, F.col("vec_id") == 1, 5)


def test_places_and_balls_are_pruned():
    """Groups far apart: of the places, and of the leaves in a tree, few are left to a query."""
    rng = np.random.default_rng(5)
    centers = 20 * rng.normal(size=(16, 12))
    x = np.floor(np.concatenate([c + rng.normal(size=(400, 12)) for c in centers]) * 4)
    space = exact_topk.Balls(5, 1.0)
    space.learn(x[::10], 16)
    place, far = space.assign(x)
    widest = np.array([far[place == p].max(initial=0) for p in range(16)])
    kth = np.sort(x[::50] @ x.T, axis=1)[:, -6]
    open_ = space.open_places(x[::50], kth, widest)
    assert open_.mean() < 0.3
    for i, row in enumerate(x[::50] @ x.T):  # none that holds a better row is shut
        assert open_[i, place[row >= kth[i]]].all()
    found = space.answer(exact_topk.BallTree(x), np.arange(len(x)), x, np.arange(0, len(x), 50), x[::50], np.full(len(x) // 50, np.nan), 5)
    assert found.passed < 0.3 * (len(x) // 50) * len(x) / 100


def test_ball_tree_with_equal_rows():
    points = np.array([[1.0, 2.0]] * 300 + [[3.0, 1.0]])
    q, v, s = exact_topk.ball_search(np.arange(301), points, np.array([5]), np.array([[1.0, 0.0]]), np.array([np.nan]), 3)
    assert v.tolist() == [300, 0, 1] and s.tolist() == [3, 1, 1]


def test_exact_with_large_numbers():
    points = np.array([[float(1 << 30), 1.0], [float(1 << 30), 2.0], [float(1 << 30), 3.0]])
    _, v, s = exact_topk.ball_search(np.arange(3), points, np.array([9]), points[:1], np.array([np.nan]), 3)
    assert v.tolist() == [2, 1, 0] and s.tolist() == [(1 << 60) + 3, (1 << 60) + 2, (1 << 60) + 1]


@pytest.mark.parametrize("shard_rows", [8192, 60])
def test_nearest(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(vectors, "SHARD_BYTES", 8 * 16 * shard_rows)
    rows, df = table(spark, 400, 16)
    ids, x = valid_rows(rows, 16, False)
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 8 == 0, 20).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    asked = [i for i in range(len(ids)) if ids[i] % 8 == 0]
    assert set(got) == {int(ids[i]) for i in asked}
    recall = []
    for i in asked:
        want = brute(ids, x, i, 20)
        mine = [got[ids[i]][r] for r in range(1, 21)]
        assert [s for _, s in mine] == sorted((s for _, s in mine), reverse=True)
        place = {int(v): k for k, v in enumerate(ids)}
        assert all(s == pytest.approx(float(x[place[v]] @ x[i]), abs=1e-9) for v, s in mine)
        recall.append(len({v for v, _ in mine} & {v for v, _ in want}) / 20)
    assert np.mean(recall) >= 0.9


def test_nearest_few_rows(spark):
    _, df = table(spark, 4)
    few = df.filter("vec_id < 4")
    assert ann.nearest(few, F.col("vec_id") == 0, 20).count() == 3
    assert ann.nearest(few.limit(0), F.col("vec_id") == 0, 20).count() == 0
    with pytest.raises(ValueError):
        ann.nearest(few, F.col("vec_id") == 0, 5, onto=3)


def test_chi_square():
    # the median of 2 degrees is 2 ln 2; a sample mean for 8
    assert ann.chi_square_cdf(np.array([2 * np.log(2)]), 2)[0] == pytest.approx(0.5)
    rng = np.random.default_rng(1)
    sample = (rng.standard_normal((200_000, 8)) ** 2).sum(axis=1)
    for x in (3.0, 8.0, 15.0):
        assert ann.chi_square_cdf(np.array([x]), 8)[0] == pytest.approx((sample <= x).mean(), abs=0.005)


def test_kd_tree_boxes():
    points = np.random.default_rng(2).normal(size=(500, 4))
    tree = ann.KDTree(points)
    assert sorted(np.concatenate(tree.leaves).tolist()) == list(range(500))
    q = np.random.default_rng(3).normal(size=(5, 4))
    far = tree.distances(q)
    for i in range(5):
        for leaf, rows in enumerate(tree.leaves):
            assert far[i, leaf] <= ((points[rows] - q[i]) ** 2).sum(axis=1).min() + 1e-12
