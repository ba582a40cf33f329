"""Two-way fixed effects by alternating projection, for any panel and any number of years.

Unit means and year means are taken out in turn until the year effects no longer change. Rows are
summed to unit-year cells once and stored with one row per unit, whose cells are bounded by the
calendar; a round is then a narrow expression per unit and one small aggregate by year. The driver
keeps one number per year and column, and speeds the rounds up from the last few of them. No
years-by-years matrix is made. An independent way to the results of ``models.fit_two_way``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldframe.operators.models import FixedEffectsFit, complete_cases, t_quantile, t_two_sided
from fieldframe.session import materialize

#: Rounds that the extrapolation looks back on.
MEMORY = 12


def _stored(df: DataFrame, names: Sequence[str], unit: str, year: str) -> tuple[DataFrame, np.ndarray, int]:
    """(one row per unit with its cells, variances of the columns, number of rows); columns have mean 0 and variance 1."""
    rows = complete_cases(df, [*names, year]).select(
        F.trim(F.col(unit).cast("string")).alias("_u"), F.col(year).cast("int").alias("_y"), *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(names)],
    ).where("_u is not null and _u <> ''")
    rows = materialize(rows, "projection-rows")
    columns = [f"_v{i}" for i in range(len(names))]
    facts = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{c}") for c in columns], *[F.var_pop(c).alias(f"s{c}") for c in columns]).first()
    if not facts["n"]:
        return rows, np.zeros(len(names)), 0
    variances = np.array([facts[f"s{c}"] for c in columns])
    even = [((F.col(c) - facts[f"m{c}"]) / (math.sqrt(v) if v > 0 else 1.0)).alias(c) for c, v in zip(columns, variances)]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    cells = rows.select("_u", "_y", *even).groupBy("_u", "_y").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.array(*[F.sum(c) for c in columns]).alias("s"),
        F.array(*[F.sum(F.col(columns[i]) * F.col(columns[j])) for i, j in pairs]).alias("p"))
    units = cells.groupBy("_u").agg(F.collect_list(F.struct(F.col("_y").alias("y"), "n", "s", "p")).alias("_cells"), F.sum("n").alias("_n"))
    return materialize(units, "projection"), variances, facts["n"]


def _effects(years: list[int], effects: np.ndarray) -> Column:
    """Year effects of all columns as a map of arrays."""
    return F.create_map(*[F.lit(x) for y, e in zip(years, effects) for x in (y, F.array(*[F.lit(float(v)) for v in e]))])


def _left(k: int, of_year: Column):
    """Step of a sum over cells of what the year effects leave of column k."""
    return lambda total, c: total + c["s"][k] - c["n"] * of_year[c["y"]][k]


def _round(units: DataFrame, years: list[int], effects: np.ndarray) -> np.ndarray:
    """Year means of what is left after unit means of what the year effects leave."""
    many, of_year = effects.shape[1], _effects(years, effects)
    mean = F.array(*[F.aggregate("_cells", F.lit(0.0), _left(k, of_year)) / F.col("_n") for k in range(many)])
    spread = units.select(mean.alias("_a"), F.explode("_cells").alias("_c"))
    sums = spread.groupBy(F.col("_c.y").alias("y")).agg(F.sum("_c.n").alias("n"), *[F.sum(F.col("_c.s")[k] - F.col("_c.n") * F.col("_a")[k]).alias(f"s{k}") for k in range(many)])
    found = {r["y"]: [r[f"s{k}"] / r["n"] for k in range(many)] for r in sums.collect()}
    return np.array([found[y] for y in years])


def _products(units: DataFrame, years: list[int], effects: np.ndarray) -> np.ndarray:
    """Cross products of what unit and year effects leave of the columns."""
    many, of_year = effects.shape[1], _effects(years, effects)
    total = lambda k: F.aggregate("_cells", F.lit(0.0), _left(k, of_year)) / F.col("_n")
    spread = units.select(F.array(*[total(k) for k in range(many)]).alias("_a"), F.explode("_cells").alias("_c")).select(
        "_c", *[(F.col("_a")[k] + of_year[F.col("_c.y")][k]).alias(f"e{k}") for k in range(many)])
    s = lambda k: F.col("_c.s")[k]
    pairs = [(i, j) for i in range(many) for j in range(i, many)]
    sums = spread.agg(*[F.sum(F.col("_c.p")[at] - F.col(f"e{i}") * s(j) - F.col(f"e{j}") * s(i) + F.col("_c.n") * F.col(f"e{i}") * F.col(f"e{j}")).alias(f"p{i}_{j}")
                        for at, (i, j) in enumerate(pairs)]).first()
    out = np.zeros((many, many))
    for i, j in pairs:
        out[i, j] = out[j, i] = sums[f"p{i}_{j}"]
    return out


def _year_parts(units: DataFrame, years: list[int]) -> int:
    """Number of groups of years that no unit joins; pairs of years met in a unit are at most their square."""
    met = units.select(F.array_min(F.transform("_cells", lambda c: c["y"])).alias("a"), F.explode("_cells").alias("_c")).select("a", F.col("_c.y").alias("b")).distinct()
    root = {y: y for y in years}

    def find(y: int) -> int:
        while root[y] != y:
            y = root[y]
        return y

    for a, b in met.collect():
        root[find(a)] = find(b)
    return len({find(y) for y in years})


def year_effects(units: DataFrame, years: list[int], columns: int, tolerance: float = 1e-12, rounds: int = 1000) -> tuple[np.ndarray, int]:
    """(year effects of all columns, rounds taken); the change of a round, in standard deviations, ends below ``tolerance``."""
    effects = np.zeros((len(years), columns))
    moved: list[np.ndarray] = []
    reached: list[np.ndarray] = []
    for done in range(1, rounds + 1):
        new = _round(units, years, effects)
        change = new - effects
        if np.abs(change).max(initial=0.0) <= tolerance:
            return new, done
        moved, reached = [*moved, change][-MEMORY:], [*reached, new][-MEMORY:]
        effects = new.copy()
        for k in range(columns if len(moved) > 1 else 0):
            # the combination of the last rounds whose change is least
            steps = np.stack([b[:, k] - a[:, k] for a, b in zip(moved, moved[1:])], axis=1)
            ways = np.stack([b[:, k] - a[:, k] for a, b in zip(reached, reached[1:])], axis=1)
            effects[:, k] -= ways @ np.linalg.lstsq(steps, change[:, k], rcond=1e-10)[0]
    raise ArithmeticError(f"no convergence in {rounds} rounds")


def fit_two_way_alternating(df: DataFrame, outcome: str, terms: Sequence[str], unit: str = "province", year: str = "year",
                            tolerance: float = 1e-12) -> FixedEffectsFit:
    """Unit and year effects for one sample; null rows, blank units and reasons as in ``models.fit_two_way``.

    A term that the effects explain up to a part in 1e10 of its variance has no estimate of its
    own and makes the fit rank deficient.
    """
    names = [outcome, *terms]
    units, variances, n = _stored(df, names, unit, year)
    if not n:
        return FixedEffectsFit(reason="no complete rows")
    years = sorted(r[0] for r in units.select(F.explode(F.transform("_cells", lambda c: c["y"]))).distinct().collect())  # one row per calendar year
    n_units = units.count()
    if n_units < 2:
        return FixedEffectsFit(n=n, reason="fewer than two admin units")
    if len(years) < 2:
        return FixedEffectsFit(n=n, reason="fewer than two years")
    effects, _ = year_effects(units, years, len(names), tolerance)
    products = _products(units, years, effects)
    k = len(terms)
    gone = np.diag(products) <= 1e-10 * n
    products[gone], products[:, gone] = 0.0, 0.0
    scale = np.sqrt(np.where(gone, 1.0, np.diag(products)))[1:]
    design = products[1:, 1:] / np.outer(scale, scale)
    rank = int(np.linalg.matrix_rank(design, tol=1e-9)) if k else 0
    inverse = np.linalg.pinv(design, rcond=1e-9, hermitian=True) / np.outer(scale, scale)
    slopes = inverse @ products[0, 1:]
    residual = max(float(products[0, 0] - slopes @ products[0, 1:]), 0.0)
    df_left = n - n_units - (len(years) - _year_parts(units, years)) - rank
    r2 = 1.0 - residual / n if variances[0] > 0 else None
    adjusted = 1.0 - (1.0 - r2) * (n - 1) / df_left if r2 is not None and df_left > 0 else None
    fit = FixedEffectsFit(n=n, df=df_left, r2=r2, adjusted_r2=adjusted, rank_deficient=rank < k)
    unit_of = np.sqrt(np.where(variances > 0, variances, 1.0))
    for j, name in enumerate(terms):
        b = float(slopes[j] * unit_of[0] / unit_of[j + 1])
        se = math.sqrt(max(residual / df_left * inverse[j, j], 0.0)) * float(unit_of[0] / unit_of[j + 1]) if df_left > 0 else float("nan")
        fit.estimates[name], fit.standard_errors[name] = b, se
        if df_left > 0 and se > 0:
            half = t_quantile(0.975, df_left) * se
            fit.p_values[name], fit.intervals[name] = t_two_sided(b / se, df_left), (b - half, b + half)
    return fit
