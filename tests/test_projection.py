"""Alternating projection against the direct solver and dense dummies."""

import random

import numpy as np
import pytest

from fieldframe.operators import models as M
from fieldframe.operators import projection as J
from test_models import dense

SHAPE = "province string, year int, y double, x double, z double"


def panel(seed, units, years, keep):
    """Random unbalanced panel with missing unit-years and repeated ones."""
    rng = random.Random(seed)
    rows = [(f"u{u}", 1990 + t, 1e3 + rng.gauss(u + t, 2), rng.gauss(0, 1) + u * t / 9, 1e-3 * rng.uniform(0, 3))
            for u in range(units) for t in range(years) for _ in range(rng.choice(keep))]
    return rows


@pytest.mark.parametrize("seed,units,years,keep", [(1, 12, 9, [0, 1, 1, 2]), (2, 40, 15, [0, 0, 0, 1]), (3, 6, 20, [0, 0, 1])])
def test_random_unbalanced_panels(spark, seed, units, years, keep):
    rows = panel(seed, units, years, keep)
    df = spark.createDataFrame(rows + [("u1", 1991, None, 1.0, 1.0), (" ", 1991, 1.0, 1.0, 1.0), (None, 1991, 1.0, 1.0, 1.0), ("u2", None, 1.0, 1.0, 1.0)], SHAPE)
    direct, other = M.fit_two_way(df, "y", ["x", "z"]), J.fit_two_way_alternating(df, "y", ["x", "z"])
    beta, se, dof, r2 = dense(rows, 2)
    for k, c in enumerate("xz"):
        assert other.estimates[c] == pytest.approx(direct.estimates[c], rel=1e-8) == pytest.approx(beta[k], rel=1e-7)
        assert other.standard_errors[c] == pytest.approx(direct.standard_errors[c], rel=1e-8) == pytest.approx(se[k], rel=1e-7)
        assert other.p_values[c] == pytest.approx(direct.p_values[c], rel=1e-6) and other.intervals[c] == pytest.approx(direct.intervals[c], rel=1e-7)
    assert (other.n, other.df) == (direct.n, direct.df) == (len(rows), dof)
    assert other.r2 == pytest.approx(direct.r2, abs=1e-9) == pytest.approx(r2, abs=1e-9) and other.adjusted_r2 == pytest.approx(direct.adjusted_r2, abs=1e-9)


def test_panels_in_two_parts_and_a_chain_of_years(spark):
    """Units that share no year with others, and units that each join two neighbouring years only."""
    rng = random.Random(5)
    rows = [(f"a{u}", 2000 + t, rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)) for u in range(4) for t in range(4)]
    rows += [(f"b{u}", 2010 + t, rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)) for u in range(14) for t in (u, u + 1)]
    df = spark.createDataFrame(rows, SHAPE)
    direct, other = M.fit_two_way(df, "y", ["x"]), J.fit_two_way_alternating(df, "y", ["x"])
    assert other.df == direct.df and other.estimates["x"] == pytest.approx(direct.estimates["x"], rel=1e-8)
    units, *_ = J._stored(df, ["y", "x"], "province", "year")
    assert J.year_effects(units, sorted({r[1] for r in rows}), 2)[1] < 100


def test_unavailable_and_rank_deficient(spark):
    make = lambda rows: spark.createDataFrame(rows, SHAPE)
    assert J.fit_two_way_alternating(make([]), "y", ["x"]).reason == "no complete rows"
    assert J.fit_two_way_alternating(make([("a", 2000 + i, float(i), float(i), 0.0) for i in range(4)]), "y", ["x"]).reason == "fewer than two admin units"
    assert J.fit_two_way_alternating(make([(u, 2000, 1.0, 2.0, 0.0) for u in "abc"]), "y", ["x"]).reason == "fewer than two years"
    flat = make([(u, t, float(ord(u) * t % 7), float(ord(u)), float(ord(u) * t % 5)) for u in "abc" for t in range(2000, 2004)])
    fit = J.fit_two_way_alternating(flat, "y", ["x", "z"])
    assert fit.rank_deficient and fit.estimates["z"] == pytest.approx(M.fit_two_way(flat, "y", ["x", "z"]).estimates["z"], rel=1e-8)


def test_event_terms_on_an_unbalanced_panel(spark):
    rows = [r for r in panel(7, 10, 8, [0, 1, 1, 1])]
    df = spark.createDataFrame([(*r[:4], float(r[0] in ("u1", "u2", "u3") and r[1] >= 1994)) for r in rows], SHAPE)
    direct, other = M.fit_two_way(df, "y", ["z", "x"]), J.fit_two_way_alternating(df, "y", ["z", "x"])
    assert [other.estimates[c] for c in "zx"] == pytest.approx([direct.estimates[c] for c in "zx"], rel=1e-8)
    assert np.isfinite(other.standard_errors["z"])
