import hashlib
import math
import random

import numpy as np
import pytest

from webloom.llm import elkan


def brute(rows, k, rounds, dims, salt=2):
    """Plain clustering of (id, vector) rows in Python integers: {row number: (cluster, distance, ..)}."""
    kept = {}
    for n, (_, e) in enumerate(rows):
        if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e):
            kept[n] = tuple(math.floor(256 * x) for x in e)
    first = sorted((hashlib.sha256(f"{salt}:{rows[n][0]}".encode()).hexdigest(), v) for n, v in kept.items() if rows[n][0] is not None)
    at = [v for _, v in first[:k]]

    def assigned():
        return {n: min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), i) for i, c in enumerate(at)) for n, v in kept.items()}

    for _ in range(rounds):
        of = assigned()
        for i in range(len(at)):
            mine = [kept[n] for n, (_, c) in of.items() if c == i]
            if mine:
                at[i] = tuple(sum(column) // len(mine) for column in zip(*mine, strict=True))
    of = assigned()
    inertia = {i: sum(d for d, c in of.values() if c == i) for i in range(len(at))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return [(rows[n][0], c, d, inertia[c], sum(inertia.values()), sha[c]) for n, (d, c) in of.items()]


def same(spark, rows, **more):
    table = spark.createDataFrame([(i, e, "clash", 3) for i, e in rows], "vec_id long, embedding array<double>, cluster string, id int")
    got = elkan.cluster(table, **more).collect()
    want = brute(rows, more["k"], more["rounds"], more["dims"])
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_equals_plain_clustering(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(i % 4, 0.6) for _ in range(6)]) for i in range(300)]
    same(spark, rows, k=9, rounds=5, dims=6)


def test_ties_repeats_and_unfit_rows(spark):
    """A coarse lattice, on which many centroids are equally near, with rows that take no part."""
    rng = random.Random(6)
    rows = [(i, [rng.randrange(-2, 3) / 256 for _ in range(3)]) for i in range(200)]
    rows += [(7, rows[7][1])] * 5 + [(7, [0.0, 0.0, 0.0])] + [(None, [0.004, 0.0, -0.004])] * 3
    rows += [(900, None), (901, []), (902, [1.0, None, 0.0]), (903, [math.nan, 0.0, 0.0]), (904, [math.inf, 0.0, 0.0]), (905, [0.0] * 4)]
    same(spark, rows, k=12, rounds=5, dims=3)
    same(spark, rows[:4], k=12, rounds=3, dims=3)
    same(spark, rows, k=1, rounds=2, dims=3)
    same(spark, [(i, [0.5, 0.5, 0.5]) for i in range(30)], k=5, rounds=4, dims=3)


def test_without_rows_or_ids(spark):
    same(spark, [], k=3, rounds=2, dims=3)
    table = spark.createDataFrame([(None, [1.0, 2.0]), (None, None)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in elkan.cluster(table, k=2, dims=2).collect()] == [(None,) * 6]
    huge = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1e30, 0.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.cluster for r in elkan.cluster(huge, k=1, dims=2).collect()}
    assert got == {1: 0, 2: None, 3: 0}


def test_bounds_leave_out_most_distances(monkeypatch):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(20, 16))[rng.integers(0, 20, 4000)] * 256 + rng.normal(size=(4000, 16)) * 20).astype(np.int64)
    at, rows, real = x[:20].copy(), [], elkan.squared
    a, upper, lower = np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.zeros((len(x), 20))
    before = None
    for _ in range(6):
        centroids = elkan.Centroids(at, before)
        monkeypatch.setattr(elkan, "squared", lambda v, c: rows.append(len(v)) or real(v, c))
        a, upper, lower = centroids.assign(x, a, upper, lower)
        monkeypatch.setattr(elkan, "squared", real)
        d = ((x[:, None, :] - at[None]) ** 2).sum(2)
        assert np.array_equal(a, d.argmin(1)) and (upper >= np.sqrt(d[np.arange(len(x)), a])).all() and (lower <= np.sqrt(d)).all()
        before, at = at, np.stack([x[a == c].sum(0) // max(1, (a == c).sum()) if (a == c).any() else at[c] for c in range(20)])
    assert sum(rows) < 0.5 * 6 * 20 * len(x)


@pytest.mark.parametrize("spread", [1, 1 << 20])
def test_bounds_at_the_largest_components(spread):
    rng = np.random.default_rng(2)
    x = elkan.LARGEST - rng.integers(0, 3 * spread, (500, 64))
    centroids = elkan.Centroids(x[:10])
    a, _, _ = centroids.assign(x, np.zeros(500, np.int64), np.full(500, np.inf), np.zeros((500, 10)))
    assert np.array_equal(a, ((x[:, None, :] - x[None, :10]) ** 2).sum(2).argmin(1))
