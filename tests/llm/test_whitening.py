"""Whitening against exact fractions, numpy's eigenvectors and hand-made matrices."""

import math
from fractions import Fraction

import numpy as np
import pytest

from fieldframe.llm import whitening as W


def determinant(rows):
    rows, out = [[Fraction(x) for x in r] for r in rows], Fraction(1)
    for k in range(len(rows)):
        pivot = next((i for i in range(k, len(rows)) if rows[i][k]), None)
        if pivot is None:
            return Fraction(0)
        if pivot != k:
            rows[k], rows[pivot], out = rows[pivot], rows[k], -out
        out *= rows[k][k]
        for i in range(k + 1, len(rows)):
            f = rows[i][k] / rows[k][k]
            rows[i] = [x - f * y for x, y in zip(rows[i], rows[k])]
    return out


def scatter(draw, d, rank):
    x = draw.integers(-9, 9, (rank, d)).astype(object)
    return (x.T @ x).tolist()


@pytest.mark.parametrize("d,rank", [(1, 3), (2, 2), (5, 9), (6, 3), (7, 7)])
def test_characteristic_polynomial_is_exact(spark, d, rank):
    matrix = scatter(np.random.default_rng(d), d, rank)
    poly = W.characteristic(spark, matrix)
    for x in (-3, 0, 1, 17, 1000):
        want = determinant([[x * (i == j) - matrix[i][j] for j in range(d)] for i in range(d)])
        assert sum(c * x ** k for k, c in enumerate(poly)) == want


def test_a_hessenberg_column_without_a_pivot():
    matrix = [[2, 0, 0, 1], [0, 3, 0, 0], [0, 0, 3, 0], [1, 0, 0, 2]]
    p = W.primes(40)
    found = W.polynomials_modulo(matrix, np.array(p))
    want = np.array([27, -54, 36, -10, 1])  # (x - 1)(x - 3)^3
    assert all(np.array_equal(f, want % q) for f, q in zip(found, p))


def test_roots_are_isolated_with_multiplicity():
    poly = [1]
    roots = [0, 0, 1, 5, 5, 5, 6, 1 << 40, (1 << 40) + 1]
    for r in roots:
        poly = [(poly[k - 1] if k else 0) - r * (poly[k] if k < len(poly) else 0) for k in range(len(poly) + 1)]
    found = W.isolate(poly)
    assert [m for _, _, m in found] == [1, 1, 1, 3, 1]
    for (a, f, m), want in zip(found, [(1 << 40) + 1, 1 << 40, 6, 5, 1]):
        assert Fraction(a, 1 << f) < want <= Fraction(a + 1, 1 << f)
        if m == 1:
            a, f = W.narrow(poly, a, f, 80)
            assert abs(Fraction(a, 1 << f) - want) <= Fraction(1, 1 << 79)
    # sqrt(2) and 2 - sqrt(2) shifted to be positive: (x - 2)^2 - 2
    for (a, f, _), want in zip(W.isolate([2, -4, 1]), (2 + math.sqrt(2), 2 - math.sqrt(2))):
        a, f = W.narrow([2, -4, 1], a, f, 100)
        assert a / 2 ** f == pytest.approx(want, rel=1e-15)


def test_components_of_close_and_equal_eigenvalues(spark):
    """Eigenvalues that doubles cannot tell apart, and a threefold one, on a known basis."""
    turn = np.array([[1, 1, 1, 1], [1, -1, 1, -1], [1, 1, -1, -1], [1, -1, -1, 1]], object)
    for values in ([10 ** 30 + 1, 10 ** 30, 7, 3], [5, 5, 5, 2]):
        matrix = (turn.T @ np.diag(np.array(values, object)) @ turn).tolist()
        found = W.components(spark, W.Moments(1, [0] * 4, matrix))
        assert found.values == pytest.approx([4.0 * v for v in values], rel=1e-14)
        assert np.abs(found.vectors.T @ found.vectors - np.eye(4)).max() < 1e-15
        for k, v in enumerate(values):
            inside = turn[[i for i, x in enumerate(values) if x == v]].astype(float) / 2
            assert np.abs(found.vectors[:, k] - inside.T @ (inside @ found.vectors[:, k])).max() < 1e-15


def plain(vectors, most=32):
    """(n, deviations, coordinates up to sign, shares) by numpy from the same grid."""
    x = np.floor(64 * vectors) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    v = np.cov(x, rowvar=False, bias=True).reshape(x.shape[1], -1)
    values, turn = np.linalg.eigh(v)
    order = np.argsort(-values)[:most]
    return n, ((n * x - s) ** 2).sum(axis=1), np.abs((x - s / n) @ turn[:, order] / np.sqrt(values[order])), values[order] / np.trace(v)


def check(rows, vectors, most=32):
    n, deviations, shown, shares = plain(vectors, most)
    by = {}
    for r in rows:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert len(by) == n
    for place, found in enumerate(by[i] for i in sorted(by)):
        assert sorted(found) == list(range(1, shown.shape[1] + 1))
        for c, r in found.items():
            assert (r.n, r.deviation) == (n, int(deviations[place])) and r.identity_error < 1e-10
            assert abs(r.whitened) == pytest.approx(shown[place, c - 1], abs=1e-7) and r.explained == pytest.approx(shares[c - 1], rel=1e-9)


def test_whole_table_with_odd_vectors(spark):
    draw = np.random.default_rng(3)
    good = draw.normal(size=(300, 5)) @ draw.normal(size=(5, 5))
    good[0], good[1:4] = 0, good[4]
    rows = [(i, v.tolist(), "clash", i) for i, v in enumerate(good)]
    odd = [None, [], [1.0], [1.0, None, 0.0, 0.0, 0.0], [float("nan")] + [0.0] * 4, [float("inf")] + [0.0] * 4, [1e300] + [0.0] * 4]
    df = spark.createDataFrame(rows + [(1000 + k, v, None, None) for k, v in enumerate(odd)], "vec_id long, embedding array<double>, component string, n int").repartition(6)
    out = W.whiten(df)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(out.collect(), good)
    check(W.whiten(df, most=2).collect(), good, 2)
    assert W.whiten(df.limit(0)).count() == 0 and W.whiten(df.where("vec_id = 7")).count() == 0 and W.whiten(df.where("vec_id > 1000 and vec_id < 1001")).count() == 0
    twice = W.whiten(df.union(spark.createDataFrame([(None, good[9].tolist(), "x", 1)], df.schema)))
    assert twice.where("vec_id is null").count() == 5


def test_a_plane_has_two_components(spark):
    draw = np.random.default_rng(4)
    plane = np.round(draw.normal(size=(60, 2)) * 8) @ np.array([[1.0, 2, 0, 1], [0, 1, 1, -1]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(plane)], "vec_id int, embedding array<double>")
    rows = W.whiten(df).collect()
    assert {r.component for r in rows} == {1, 2} and sum(r.explained for r in rows if r.vec_id == 0) == pytest.approx(1)
    check(rows, plane, 2)


def test_wide_entries_stay_exact(spark):
    vectors = [[2.0 ** 50, 1.0], [-(2.0 ** 50), 2.0], [3.0, 2.0 ** 40], [0.5, 0.25]]
    found = W.moments(spark.createDataFrame([(v,) for v in vectors], "v array<double>").repartition(2), "v", 2)
    x = [[math.floor(64 * c) for c in v] for v in vectors]
    sums = [sum(c) for c in zip(*x)]
    assert (found.n, found.sums) == (4, sums)
    assert found.matrix == [[4 * sum(r[i] * r[j] for r in x) - sums[i] * sums[j] for j in range(2)] for i in range(2)]
    rows = W.whiten(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")).collect()
    assert rows[0].deviation is None and len(rows) == 8 and rows[0].identity_error < 1e-10


def test_query_on_the_given_vectors(spark, small):
    from fieldframe.llm.queries import QUERIES

    vectors = np.array([r.embedding for r in spark.read.parquet(f"{small}/embeddings.parquet").orderBy("vec_id").collect()], np.float64)
    check(QUERIES["op12_exact_whitening"](spark, small).collect(), vectors)
