"""Operator 13 against numpy's eigendecomposition and exact brute force."""

import math

import numpy as np
import pytest

from fairlend.llm import charpoly
from fairlend.llm.whitening import products, whiten, whitening_report

SCHEMA = "vec_id long, vector array<float>, component string, n int"


def whole(rows):
    return np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in rows], object)


def check(spark, rows, bad=(), most=8):
    """The report of ``rows`` and ``bad`` against brute force over ``rows``."""
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in [*rows, *bad]], SCHEMA)
    got = whitening_report(df, most)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    x = whole(rows)
    n, s = len(x), x.sum(axis=0)
    y = x * n - s
    cov = (y / n).astype(float).T @ (y / n).astype(float) / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    m = min(most, int((values > 1e-9 * values[0]).sum()))
    out = got.collect()
    assert len(out) == n * m
    by = {}
    for r in out:
        by.setdefault(r.component, []).append(r)
    for k in range(m):
        part = by[k + 1]
        want = sorted((i if i is not None else -1, int(d)) for (i, _), d in zip(rows, (y * y).sum(axis=1)))
        assert sorted((r.vec_id if r.vec_id is not None else -1, r.deviation) for r in part) == want
        assert {r.n for r in part} == {n}
        assert abs(part[0].explained - values[k] / values.sum()) <= 1e-9
        assert part[0].identity_error <= 1e-9
        gap = min(abs(values[k] - v) for j, v in enumerate(values) if j != k) if len(values) > 1 else 1
        if gap > 1e-6 * values[0] and len({i for i, _ in rows}) == n:
            white = (y / n).astype(float) @ vectors[:, k] / math.sqrt(values[k])
            have = {r.vec_id: r.whitened for r in part}
            mine = np.array([have[i] for i, _ in rows])
            assert min(np.abs(mine - white).max(), np.abs(mine + white).max()) < 1e-6
    return out


def draw(n, d, seed=1):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, d)) @ np.diag(np.linspace(1, 0.2, d)) @ r.normal(size=(d, d)) / d
    return [(i, [float(c) for c in v]) for i, v in enumerate(base)]


@pytest.mark.parametrize("n,d", [(150, 12), (40, 5), (3, 6)])
def test_equals_numpy(spark, n, d):
    check(spark, draw(n, d), most=4 if n > 3 else 8)


def test_bad_vectors_take_no_part(spark):
    bad = [(900, None), (901, [float("nan")] * 4), (902, [1.0, None, 0.0, 0.0]), (903, [float("inf"), 0.0, 0.0, 0.0]),
           (904, []), (905, [1.0]), (906, [1e30, 0.0, 0.0, 0.0])]
    check(spark, draw(30, 4), bad)


def test_repeated_rows_and_null_ids(spark):
    rows = draw(20, 4)
    check(spark, rows + [(None, rows[0][1])] * 15 + [rows[1]] * 3)


def test_equal_eigenvalues(spark):
    """A cross of axes: every direction has one variance, and the components are still orthonormal."""
    rows = [(2 * i + (s > 0), [s if j == i else 0.0 for j in range(6)]) for i in range(6) for s in (-1.0, 1.0)]
    out = check(spark, rows, most=6)
    assert {round(r.explained, 9) for r in out} == {round(1 / 6, 9)}


def test_large_entries_are_exact(spark):
    rows = [(i, [c * 2.0 ** 16 for c in v]) for i, v in draw(25, 3)]
    check(spark, rows)
    x = np.array([[1 << 50, -(1 << 51)], [3, -5], [-(1 << 41) + 1, 7]], np.int64)
    assert (products(x) == x.astype(object).T @ x.astype(object)).all()


def test_no_rows_and_no_variance(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening_report(empty).collect() == []
    same = spark.createDataFrame([(1, [1.0, 2.0], "x", 1), (2, [1.0, 2.0], "x", 1)], SCHEMA)
    assert whitening_report(same).collect() == []
    assert whitening_report(spark.createDataFrame([(1, None, "x", 1)], SCHEMA)).collect() == []


def test_components_are_unit_vectors(spark):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in draw(80, 10)], SCHEMA)
    v = np.array([c.vector for c in whiten(df, ["vec_id"], "vector", 8).components])
    assert np.abs(v @ v.T - np.eye(8)).max() < 1e-14


def test_polynomial_by_remaindering():
    m = [[4, 1, 0, 2], [1, 7, 3, 0], [0, 3, 9, 1], [2, 0, 1, 5]]
    primes = charpoly.primes_for(charpoly.coefficient_bits(25, 4))
    mods = [charpoly.charpoly_mod(np.array(m, np.int64), p) for p in primes]
    got = [charpoly.remaindered(primes, [int(c[k]) for c in mods]) for k in range(5)]
    assert got == [round(c) for c in np.poly(np.array(m, float))[::-1]]


def test_roots_are_counted_exactly():
    poly = [round(c) for c in np.poly([2, 2, 2, 5, 9])[::-1]]
    assert [charpoly.roots_above(poly, a) for a in (-1, 1, 2, 4, 5, 8, 9)] == [5, 5, 2, 2, 1, 1, 0]
    assert charpoly.isolate(poly, 0, 20) == (9, 0, 1) and charpoly.isolate(poly, 3, 20) == (2, 2, 3)


def test_primes():
    assert [n for n in range(60) if charpoly.is_prime(n)] == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59]
