"""Centroid clustering and whitening on odd vectors, against brute force."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from listmill.llm import centroids, feast, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, id long, x int, lead int, rest string, cluster string, n int, at int, v string"
CLASH = (1, 2, 3, 4, "r", "c", 5, 6, "v")


def vectors(n=400, dims=64, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((6, dims))
    x = (middle[rng.integers(0, 6, n)] + 0.4 * rng.standard_normal((n, dims))).astype(np.float32)
    x[n // 3:n // 3 * 2] = x[0]  # a third of all rows in one point
    return [(i, x[i].tolist()) for i in range(n)]


def odd_vectors():
    rows, one = vectors(), [0.5] * 64
    rows += [(5, one), (5, one), (None, one), (None, None), (900, None), (901, []), (902, one[:63]), (903, [*one, 0.1]),
             (904, [None, *one[1:]]), (905, [float("nan"), *one[1:]]), (906, [float("inf"), *one[1:]]), (907, [0.0] * 64), (908, [-0.0] * 64)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, *CLASH) for i, v in rows], SCHEMA)


def usable(rows):
    return [(i, v) for i, v in rows if v is not None and len(v) == 64 and all(e is not None and math.isfinite(e) for e in v)]


# -- clustering ------------------------------------------------------------------------

def lloyd(rows, k=8, rounds=10):
    items = [(i, [math.floor(1024 * e) for e in v]) for i, v in usable(rows)]
    first = sorted(items, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    middle, x = [c for _, c in first], np.array([v for _, v in items], object)

    def assign():
        return [min((int(((v - np.array(c, object)) ** 2).sum()), n) for n, c in enumerate(middle)) for v in x]

    for _ in range(rounds):
        own = assign()
        for n in range(len(middle)):
            mine = [x[i] for i, (_, c) in enumerate(own) if c == n]
            if mine:
                middle[n] = [int(s) // len(mine) for s in sum(mine)]
    own = assign()
    inertia = {n: sum(d for d, c in own if c == n) for n in range(len(middle))}
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    return sorted(((-1 if i is None else i), c, d, inertia[c], sum(inertia.values()), shas[c]) for (i, _), (d, c) in zip(items, own))


@pytest.mark.parametrize("lead", [1, 16, 64])
def test_clusters_equal_plain_lloyd(spark, lead):
    rows = odd_vectors()
    got = centroids.cluster_vectors(frame(spark, rows), lead=lead).collect()
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == lloyd(rows)


def test_clusters_of_few_vectors_and_of_none(spark):
    rows = [(1, [0.5] * 64), (2, [0.5] * 64), (3, None)]
    got = centroids.cluster_vectors(frame(spark, rows), rounds=2).collect()
    assert [(r.vec_id, r.cluster, r.distance) for r in sorted(got)] == [(1, 0, 0), (2, 0, 0)]  # ties: the smaller number
    empty = centroids.cluster_vectors(frame(spark, []))
    assert empty.columns == centroids.cluster_vectors(frame(spark, rows), rounds=1).columns and empty.count() == 0


def test_the_bound_spares_most_distances_and_misses_none():
    rng = np.random.default_rng(5)
    middle = rng.integers(-1000, 1000, (20, 64))
    x = middle[rng.integers(0, 20, 3000)] + rng.integers(-150, 150, (3000, 64))
    rotation = centroids.Rotation(x.mean(axis=0), np.cov(x.T), 16)
    cluster, best, held = centroids.nearest(x, *rotation(x.astype(float)), middle, rotation)
    every = ((x[:, None, :] - middle[None]) ** 2).sum(axis=2)
    assert (best == every.min(axis=1)).all() and (cluster == every.argmin(axis=1)).all()
    assert held < 0.2 * every.size


def test_integers_that_are_too_large_are_an_error(spark):
    with pytest.raises(Exception, match="within 134217728"):
        centroids.cluster_vectors(frame(spark, [(1, [1e6] * 64)]), rounds=1).collect()


# -- eigenpairs ------------------------------------------------------------------------

def turned(values, seed=1):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    a = q @ np.diag(values) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize("values", [
    np.linspace(1, 9, 40), [5.0] * 20 + [3.0] * 20 + [1.0] * 5, 0.7 ** np.arange(50), [4.0] * 3 + [0.0] * 30, 1 + np.arange(40) // 2 * 1e-8,
    [106.5, 104.1, 68.3, *np.linspace(58, 67.6, 61)], [1e6, 5.0, *np.linspace(1, 1.001, 40)], [1e3] * 2 + [1.0] * 30 + [1e-9] * 10, [2.0], [0.0, 0.0]])
def test_leading_pairs_equal_a_full_decomposition(values):
    a, want = turned(np.asarray(values, float)), np.sort(values)[::-1]
    least = 1e-13 * np.trace(a)
    e, v = feast.leading_pairs(a, 32, least)
    want = want[want > least][:32]
    assert len(e) == len(want)
    if len(e):
        assert np.abs(e - want).max() <= 1e-13 * want[0] and (np.diff(e) <= 1e-13 * want[0]).all()
        assert np.abs(a @ v - v * e).max() <= 1e-13 * want[0]
        assert np.abs(v.T @ v - np.eye(len(e))).max() < 1e-13


def test_inertia_counts_eigenvalues_above_a_shift():
    for values in ([3, 2, -1, -4, -5], [1, -1] * 10, [0, 0, 2, -2], list(range(-20, 30)), [0.0] * 4, [7.0]):
        counts = feast.Inertia(turned(np.asarray(values, float), seed=len(values)))
        assert [counts.above(s) for s in (-30.5, -1.5, 0.5, 2.5)] == [sum(v > s for v in values) for s in (-30.5, -1.5, 0.5, 2.5)]
    assert feast.Inertia(np.array([[0.0, 1.0], [1.0, 0.0]])).above(0.0) == 1


def test_an_interval_whose_pairs_are_missing_is_an_error():
    a = turned(np.linspace(1, 9, 12))
    with pytest.raises(ArithmeticError):
        feast.pairs_in(a, feast.Inertia(a), 0.5, 1.2, 3)


# -- whitening -------------------------------------------------------------------------

def check_whitened(rows, got, components=32):
    items = [(i, [math.floor(64 * e) + 1_000_000 for e in v]) for i, v in usable(rows)]
    n, x = len(items), np.array([v for _, v in items], object)
    sums = x.sum(axis=0)
    y = (x * n - sums)
    v = np.array([[float(Fraction(int((y[:, i] * y[:, j]).sum()), n**3)) for j in range(64)] for i in range(64)])
    e = np.linalg.eigvalsh(v)[::-1]
    count = min(components, int((e > 1e-13 * np.trace(v)).sum()))
    assert len(got) == n * count
    deviation = sorted(int((row**2).sum()) for row in y)
    assert sorted(r.deviation for r in got if r.component == 1) == deviation
    for c in range(1, count + 1):
        own = [r for r in got if r.component == c]
        assert all(r.n == n for r in own) and abs(own[0].explained / (e[c - 1] / np.trace(v)) - 1) < 1e-9
    if len({i for i, _ in items}) == n:
        w = np.zeros((n, count))
        place = {i: p for p, (i, _) in enumerate(items)}
        for r in got:
            w[place[r.vec_id], r.component - 1] = r.whitened
        assert np.abs(w.T @ w / n - np.eye(count)).max() < 1e-10
        back = (x - sums / n).astype(float)
        for c in range(count):  # rows are projections on one unit vector, whichever sign
            axis = back.T @ w[:, c] / n / math.sqrt(e[c])
            assert np.abs(np.linalg.norm(axis) - 1) < 1e-9 and np.abs(back @ axis / math.sqrt(e[c]) - w[:, c]).max() < 1e-8
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-10


def test_whitened_vectors_equal_brute_force(spark):
    rows = vectors()
    check_whitened(rows, whitening.whiten(frame(spark, rows)).collect())


def test_whitening_of_odd_vectors(spark):
    rows = odd_vectors()
    got = whitening.whiten(frame(spark, rows)).collect()
    check_whitened(rows, got)
    assert sum(r.vec_id is None for r in got) == 32 and sum(r.vec_id == 5 for r in got) == 3 * 32


def test_whitening_without_variance_or_rows(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [0.25] * 64), (2, [0.25] * 64), (3, None)])).count() == 0
    two = whitening.whiten(frame(spark, [(1, [0.25] * 64), (2, [0.5] * 64)])).collect()
    assert [(r.component, round(abs(r.whitened), 9), round(r.explained, 9)) for r in two] == [(1, 1.0, 1.0)] * 2


def test_large_entries_keep_exact_sums(spark):
    rows = [(1, [1e8, 1.0]), (2, [-1e8, 2.0]), (3, [3e7, 5.0])]
    got = {r.vec_id: r.deviation for r in whitening.whiten(frame(spark, rows)).filter("component = 1").collect()}
    x = [[math.floor(64 * e) + 1_000_000 for e in np.float32(v).tolist()] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    want = {i: sum((3 * a - s) ** 2 for a, s in zip(v, sums)) for (i, _), v in zip(rows, x)}
    assert got == {i: d if d < 1 << 63 else None for i, d in want.items()} and max(want.values()) >= 1 << 63
