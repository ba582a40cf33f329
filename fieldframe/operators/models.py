"""Linear models from sufficient statistics.

Spark reduces the rows to cross products in a few aggregates; only matrices of the size
of the terms and years reach the driver, which solves them with numpy. Nothing grows
with the number of rows or units there.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldframe.session import materialize
from fieldframe.operators.treatment import assign_treatment, event_study_terms, term_name


@dataclass(frozen=True)
class OlsFit:
    """Ordinary least squares with intercept."""

    n: int
    coefficients: dict[str, float | None]
    r2: float | None
    adjusted_r2: float | None


@dataclass(frozen=True)
class FixedEffectsFit:
    """Two-way fixed effects; ``reason`` says why a model is unavailable."""

    n: int = 0
    estimates: dict[str, float] = field(default_factory=dict)
    standard_errors: dict[str, float] = field(default_factory=dict)
    p_values: dict[str, float] = field(default_factory=dict)
    intervals: dict[str, tuple[float, float]] = field(default_factory=dict)
    df: int = 0
    r2: float | None = None
    adjusted_r2: float | None = None
    rank_deficient: bool = False
    reason: str | None = None


# --- Student t ------------------------------------------------------------------------------

def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(abs(1.0 - (a + b) * x / (a + 1.0)), tiny) * math.copysign(1.0, 1.0 - (a + b) * x / (a + 1.0))
    h = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return h


def _beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: int) -> float:
    """P(|T| > |t|)."""
    return _beta_cdf(df / 2.0, 0.5, df / (df + t * t))


def t_quantile(p: float, df: int) -> float:
    """Upper quantile of Student's t by bisection."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2.0
        low, high = (mid, high) if 1.0 - t_two_sided(mid, df) / 2.0 < p else (low, mid)
    return (low + high) / 2.0


# --- ordinary least squares -----------------------------------------------------------------

def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a usable number in every column."""
    ok = None
    for c in columns:
        value = F.col(c).cast("double")
        good = value.isNotNull() & ~F.isnan(value)
        ok = good if ok is None else ok & good
    return df.where(ok)


def fit_ols(df: DataFrame, y: str, xs: Sequence[str]) -> OlsFit:
    """One aggregate of means and covariances, then a small solve.

    Raises ``ValueError`` for a singular design.
    """
    names = [y, *xs]
    rows = complete_cases(df, names)
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    cast = [F.col(c).cast("double") for c in names]
    sums = rows.agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cast)],
        *[F.covar_pop(cast[i], cast[j]).alias(f"c{i}_{j}") for i, j in pairs],
    ).first()
    n = sums["n"]
    if not n:
        return OlsFit(0, {name: None for name in ["intercept", *xs]}, None, None)
    cov = np.zeros((len(names), len(names)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = sums[f"c{i}_{j}"]
    means = np.array([sums[f"m{i}"] for i in range(len(names))])
    sxx, sxy, syy = cov[1:, 1:] * n, cov[0, 1:] * n, cov[0, 0] * n
    scale = np.sqrt(np.diag(sxx))
    if len(xs) and (np.any(scale <= 1e-12) or np.linalg.matrix_rank(sxx / np.outer(scale, scale), tol=1e-12) < len(xs)):
        raise ValueError("singular design matrix")
    slopes = np.linalg.solve(sxx, sxy) if len(xs) else np.zeros(0)
    residual = max(syy - float(slopes @ sxy), 0.0)
    r2 = (1.0 if residual <= 1e-12 else 0.0) if syy <= 1e-12 else 1.0 - residual / syy
    adjusted = 1.0 - (1.0 - r2) * (n - 1) / (n - len(xs) - 1) if n > len(xs) + 1 else None
    intercept = float(means[0] - slopes @ means[1:])
    return OlsFit(n, {"intercept": intercept, **dict(zip(xs, map(float, slopes)))}, float(r2), adjusted)


def ols_predictions(df: DataFrame, y: str, fit: OlsFit) -> DataFrame:
    """Observed, predicted and residual value of the complete rows."""
    xs = [name for name in fit.coefficients if name != "intercept"]
    rows = complete_cases(df, [y, *xs])
    value = F.lit(fit.coefficients["intercept"])
    for x in xs:
        value = value + F.lit(fit.coefficients[x]) * F.col(x)
    return rows.withColumns({"observed": F.col(y), "prediction": value, "residual": F.col(y) - value})


# --- two-way fixed effects ------------------------------------------------------------------

def fit_two_way(df: DataFrame, outcome: str, terms: Sequence[str], unit: str = "province", year: str = "year") -> FixedEffectsFit:
    """Unit and year effects for one sample."""
    return fit_two_way_by(df.withColumn("_spec", F.lit("all")), "_spec", outcome, terms, unit, year).get(
        "all", FixedEffectsFit(reason="no complete rows"))


def fit_two_way_by(df: DataFrame, spec: str, outcome: str, terms: Sequence[str], unit: str = "province",
                   year: str = "year") -> dict[str, FixedEffectsFit]:
    """The same model for many samples at once, in one set of aggregates.

    Unit effects leave by demeaning within the unit (Frisch-Waugh). The demeaned year
    dummies never exist as columns: their cross products follow from counts,
    ``n_t [s=t] - sum_a n_at n_as / n_a``. Collected are, per sample, one row per year
    and one row of cross products.
    """
    if not terms:
        return {}
    names = [outcome, *terms]
    rows = complete_cases(df, [*names, year]).select(
        F.col(spec).alias("_g"), F.trim(F.col(unit).cast("string")).alias("_u"), F.col(year).cast("int").alias("_y"),
        *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(names)],
    ).where("_u is not null and _u <> ''")
    rows = materialize(rows, "fe-rows")  # read by every aggregate below
    years = sorted(r[0] for r in rows.select("_y").distinct().collect())  # one row per calendar year
    if not years:
        return {}
    values = [f"_v{i}" for i in range(len(names))]
    counts = F.array(*[F.count_if(F.col("_y") == y).cast("double") for y in years])
    units = rows.groupBy("_g", "_u").agg(
        F.count(F.lit(1)).alias("_n"), counts.alias("_counts"), *[F.avg(v).alias(f"{v}_m") for v in values]
    )
    units = materialize(units, "fe-units")
    demeaned = rows.join(units.drop("_counts", "_n"), ["_g", "_u"]).select(
        "_g", "_y", *[(F.col(v) - F.col(f"{v}_m")).alias(v) for v in values], F.col("_v0").alias("_raw")
    )
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    # One pass over the demeaned rows, split by year: the sample totals are sums over years.
    by_year = demeaned.groupBy("_g", "_y").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(v) for v in values],
        *[F.sum(F.col(values[i]) * F.col(values[j])).alias(f"p{i}_{j}") for i, j in pairs],
        F.avg("_raw").alias("mean"), F.var_pop("_raw").alias("var"),
    ).collect()
    overlap = (
        units.select("_g", "_n", "_counts", F.posexplode("_counts").alias("_s", "_c")).where("_c > 0")
        .groupBy("_g", "_s").agg(
            *[F.sum(F.col("_c") * F.col("_counts")[t] / F.col("_n")).alias(f"t{t}") for t in range(len(years))],
        ).collect()
    )
    unit_counts = {r["_g"]: r["a"] for r in units.groupBy("_g").agg(F.count(F.lit(1)).alias("a")).collect()}
    fits = {}
    for group, n_units in unit_counts.items():
        fits[group] = _solve(
            [r for r in by_year if r["_g"] == group], [r for r in overlap if r["_g"] == group], n_units, years, names)
    return fits


def _solve(by_year, overlap, n_units: int, years: list[int], names: list[str]) -> FixedEffectsFit:
    k, size = len(names) - 1, len(years)
    n = sum(r["n"] for r in by_year)
    if n_units < 2:
        return FixedEffectsFit(n=n, reason="fewer than two admin units")
    if len(by_year) < 2:
        return FixedEffectsFit(n=n, reason="fewer than two years")
    position = {y: i for i, y in enumerate(years)}
    gram, cross = np.zeros((size, size)), np.zeros((size, k + 1))
    for r in by_year:
        i = position[r["_y"]]
        gram[i, i] += r["n"]
        cross[i] = [r[f"_v{j}"] for j in range(k + 1)]
    for r in overlap:
        gram[r["_s"]] -= [r[f"t{t}"] for t in range(size)]
    products = np.zeros((k + 1, k + 1))
    for i in range(k + 1):
        for j in range(i, k + 1):
            products[i, j] = products[j, i] = sum(r[f"p{i}_{j}"] for r in by_year)
    mean = sum(r["mean"] * r["n"] for r in by_year) / n
    total = sum(r["n"] * (r["var"] + (r["mean"] - mean) ** 2) for r in by_year)
    seen = sorted(position[r["_y"]] for r in by_year)[1:]  # first observed year is the base
    design = np.block([
        [gram[np.ix_(seen, seen)], cross[np.ix_(seen, range(1, k + 1))]],
        [cross[np.ix_(seen, range(1, k + 1))].T, products[1:, 1:]],
    ])
    target = np.concatenate([cross[seen, 0], products[0, 1:]])
    scale = np.sqrt(np.maximum(np.diag(design), 0.0))
    scale[scale <= 1e-10] = 1.0
    scaled = design / np.outer(scale, scale)
    rank = int(np.linalg.matrix_rank(scaled, tol=1e-9))
    inverse = np.linalg.pinv(scaled, rcond=1e-9, hermitian=True) / np.outer(scale, scale)
    solution = inverse @ target
    residual = max(float(products[0, 0] - solution @ target), 0.0)
    df = n - n_units - rank
    variance = residual / df if df > 0 else float("nan")
    r2 = 1.0 - residual / total if total > 0 else None
    adjusted = 1.0 - (1.0 - r2) * (n - 1) / df if r2 is not None and df > 0 else None
    estimates, errors, p_values, intervals = {}, {}, {}, {}
    for j, name in enumerate(names[1:]):
        at = len(seen) + j
        b, se = float(solution[at]), math.sqrt(max(variance * inverse[at, at], 0.0)) if df > 0 else float("nan")
        estimates[name], errors[name] = b, se
        if df > 0 and se > 0:
            half = t_quantile(0.975, df) * se
            p_values[name], intervals[name] = t_two_sided(b / se, df), (b - half, b + half)
    return FixedEffectsFit(n, estimates, errors, p_values, intervals, df, r2, adjusted, rank < len(seen) + k)


COEFFICIENT_SCHEMA = (
    "model string, term string, estimate double, standard_error double, p_value double, conf_int_low double, "
    "conf_int_high double, n_obs bigint, df bigint, r2 double, adjusted_r2 double"
)


def _finite(value):
    return None if value is None or not math.isfinite(value) else float(value)


def coefficient_rows(model: str, fit: OlsFit | FixedEffectsFit) -> list[tuple]:
    """One row per term of a fitted model."""
    if isinstance(fit, OlsFit):
        return [(model, t, _finite(b), None, None, None, None, fit.n, None, _finite(fit.r2), _finite(fit.adjusted_r2))
                for t, b in fit.coefficients.items()]
    blank = (None, None)
    return [
        (model, t, _finite(b), _finite(fit.standard_errors.get(t)), _finite(fit.p_values.get(t)),
         *fit.intervals.get(t, blank), fit.n, fit.df, _finite(fit.r2), _finite(fit.adjusted_r2))
        for t, b in fit.estimates.items()
    ]


# --- event studies --------------------------------------------------------------------------

def _event_frame(df, exposure, unit, event_year, q, window, need_pre):
    """Rows with treatment and terms, and the active terms; an empty list when nothing varies."""
    treated = event_study_terms(assign_treatment(df, exposure, unit, event_year, q), "treatment", event_year, window)
    terms = [term_name(o) for o in range(-window, window + 1)]
    facts = treated.agg(
        F.count_distinct(F.when(F.col("year") == event_year, F.col("treatment"))).alias("kinds"),
        F.count_if((F.col("treatment") == 1) & (F.col("year") < event_year)).alias("before"),
        *[F.max(t).alias(t) for t in terms],
    ).first()
    if facts["kinds"] < 2 or (need_pre and not facts["before"]):
        return treated, []
    return treated, [t for t in terms if facts[t]]


def event_study_fe(df: DataFrame, outcome: str, exposure: str, unit: str, event_year: int, q: float, window: int) -> FixedEffectsFit:
    """Event-time terms with unit and year effects against the year before the event."""
    rows, active = _event_frame(df, exposure, unit, event_year, q, window, need_pre=True)
    reference = term_name(-1 if window >= 1 else 0)
    terms = [t for t in active if t != reference]
    if not terms:
        return FixedEffectsFit(reason="no treatment variation or no treated observations in the window")
    fit = fit_two_way(rows, outcome, terms, unit)
    if fit.rank_deficient:
        return FixedEffectsFit(n=fit.n, rank_deficient=True, reason="rank deficient design")
    return fit


def event_study_ols(df: DataFrame, outcome: str, exposure: str, unit: str, event_year: int, q: float, window: int) -> OlsFit | None:
    """Event-time terms by plain least squares, no reference term; None when nothing varies."""
    rows, terms = _event_frame(df, exposure, unit, event_year, q, window, need_pre=False)
    return fit_ols(rows, outcome, terms) if terms else None


CROSS_SECTION_SCOPES = ("cross_section_event_intensity", "province_event_cross_section_intensity")


def rows_for_scope(df: DataFrame, scope: str, event_year: int) -> DataFrame:
    """Event-year rows only when the scope allows no more than a cross section."""
    return df.where(F.col("year") == event_year) if scope in CROSS_SECTION_SCOPES else df
