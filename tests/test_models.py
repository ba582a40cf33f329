"""Models against dense numpy solutions and known answers."""

import random

import numpy as np
import pytest

from fieldframe.operators import models as M
from fieldframe.operators import robustness as B
from fieldframe.operators import treatment as T


def dense(rows, k):
    """Dummy-variable least squares of (unit, year, y, x...)."""
    units, years = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    x = np.array([[*r[3:3 + k], *[float(r[0] == u) for u in units], *[float(r[1] == t) for t in years[1:]]] for r in rows])
    y = np.array([r[2] for r in rows])
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    resid = y - x @ beta
    df = len(y) - np.linalg.matrix_rank(x)
    cov = resid @ resid / df * np.linalg.pinv(x.T @ x)
    return beta[:k], np.sqrt(np.diag(cov))[:k], df, 1 - resid @ resid / ((y - y.mean()) @ (y - y.mean()))


def test_known_coefficient(spark):
    rows = []
    for u in range(4):
        for t in range(25):
            x = (u * 7 + t * 3) % 11 + (u * t) % 5
            rows.append((f"p{u}", 2000 + t, 1.25 * x + 2.0 * u + 0.5 * t, float(x)))
    fit = M.fit_two_way(spark.createDataFrame(rows, "province string, year int, y double, x double"), "y", ["x"])
    assert fit.estimates["x"] == pytest.approx(1.25, abs=1e-6)
    assert fit.n == 100 and fit.r2 > 0.99


def test_unbalanced_panel_equals_dummies(spark):
    rng = random.Random(11)
    rows = [
        (f"u{u}", 2000 + t, rng.gauss(u + t, 2), rng.gauss(0, 1), rng.uniform(0, 3))
        for u in range(9) for t in range(8) for _ in range(rng.choice([0, 1, 1, 2]))
    ]
    df = spark.createDataFrame(rows + [("u1", 2001, None, 1.0, 1.0), (" ", 2001, 1.0, 1.0, 1.0)], "province string, year int, y double, x double, z double")
    fit = M.fit_two_way(df, "y", ["x", "z"])
    beta, se, dof, r2 = dense(rows, 2)
    assert [fit.estimates[c] for c in "xz"] == pytest.approx(list(beta), abs=1e-9)
    assert [fit.standard_errors[c] for c in "xz"] == pytest.approx(list(se), abs=1e-9)
    assert fit.df == dof and fit.r2 == pytest.approx(r2) and not fit.rank_deficient
    low, high = fit.intervals["x"]
    assert low < fit.estimates["x"] < high


def test_unavailable_and_rank_deficient(spark):
    schema = "province string, year int, y double, x double"
    assert M.fit_two_way(spark.createDataFrame([], schema), "y", ["x"]).reason == "no complete rows"
    one = spark.createDataFrame([("a", 2000 + i, float(i), float(i)) for i in range(4)], schema)
    assert M.fit_two_way(one, "y", ["x"]).reason == "fewer than two admin units"
    flat = spark.createDataFrame([(u, t, float(ord(u) * t % 7), float(ord(u))) for u in "abc" for t in range(2000, 2004)], schema)
    assert M.fit_two_way(flat, "y", ["x"]).rank_deficient


def test_student_t():
    assert M.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert M.t_two_sided(0.0, 5) == pytest.approx(1.0)
    assert M.t_two_sided(12.70620474, 1) == pytest.approx(0.05, abs=1e-8)
    assert M.t_quantile(0.975, 30) == pytest.approx(2.042272456, abs=1e-7)


def test_ols(spark):
    df = spark.createDataFrame([(1.0, 3.0, 1.0), (2.0, 5.0, 0.0), (3.0, 7.0, 5.0), (4.0, 9.0, 2.0), (None, 1.0, 1.0)], "x double, y double, z double")
    fit = M.fit_ols(df, "y", ["x", "z"])
    assert fit.n == 4 and fit.r2 == pytest.approx(1.0)
    assert fit.coefficients["x"] == pytest.approx(2.0) and fit.coefficients["intercept"] == pytest.approx(1.0)
    assert max(abs(r["residual"]) for r in M.ols_predictions(df, "y", fit).collect()) < 1e-9
    with pytest.raises(ValueError):
        M.fit_ols(df.withColumn("w", df.x * 2), "y", ["x", "w"])
    assert M.fit_ols(df.where("x > 99"), "y", ["x"]).n == 0


def test_event_study_equals_dummies(spark):
    rng = random.Random(4)
    rows = [(f"u{u}", t, rng.gauss(0, 1), float(u) if t == 2003 else rng.gauss(0, 1)) for u in range(8) for t in range(2000, 2006) if rng.random() < 0.9 or t == 2003]
    df = spark.createDataFrame(rows, "province string, year int, y double, x double")
    fit = M.event_study_fe(df, "y", "x", "province", 2003, 0.5, 2)
    treated = {f"u{u}" for u in range(4, 8)}
    offsets = [-2, 0, 1, 2]
    wide = [(u, t, y, *[float(u in treated and t - 2003 == o) for o in offsets]) for u, t, y, _ in rows]
    beta, se, *_ = dense(wide, 4)
    assert [fit.estimates[T.term_name(o)] for o in offsets] == pytest.approx(list(beta), abs=1e-9)
    assert [fit.standard_errors[T.term_name(o)] for o in offsets] == pytest.approx(list(se), abs=1e-9)
    assert M.event_study_fe(df, "y", "x", "province", 2003, 0.0, 2).reason is not None
    assert M.event_study_ols(df, "y", "x", "province", 2003, 0.5, 1).n == len(rows)


def test_specs_are_nine():
    from fieldframe.operators.climate import ChdSettings

    names = [s.name for s in B.standard_specs(ChdSettings())]
    assert len(names) == len(set(names)) == 9
    rows = B.spec_rows({}, B.standard_specs(ChdSettings()), {})
    assert all(r[5] == "unavailable" and r[8] == "fixed_effects_unavailable" for r in rows)
