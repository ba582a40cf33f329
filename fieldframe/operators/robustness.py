"""Robustness suite: exposure variants and sample variants of the fixed-effects model."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldframe.functions.numbers import is_true
from fieldframe.functions.text import truthy
from fieldframe.operators.climate import ChdSettings, rolling_sum
from fieldframe.operators.models import FixedEffectsFit, fit_two_way_by
from fieldframe.operators.quantiles import bounded_quantile


@dataclass(frozen=True)
class Spec:
    """One variant; thresholds are None when the panel keeps its own exposure."""

    name: str
    heat: float | None = None
    drought: float | None = None
    months: tuple[int, ...] = ()
    exclude_backfill: bool = False
    highlighted: bool = False


def standard_specs(settings: ChdSettings) -> list[Spec]:
    """Thresholds, season windows, backfill and region variants."""
    h, d = settings.heat_quantile, settings.drought_quantile
    return [
        Spec("heat_p90_drought_p10", 0.90, 0.10, (6, 7, 8, 9)),
        Spec("heat_p95_drought_p10", 0.95, 0.10, (6, 7, 8, 9)),
        Spec("heat_p90_drought_p20", 0.90, 0.20, (6, 7, 8, 9)),
        Spec("growth_months_6_9", h, d, (6, 7, 8, 9)),
        Spec("growth_months_7_9", h, d, (7, 8, 9)),
        Spec("growth_months_6_8", h, d, (6, 7, 8)),
        Spec("exclude_backfill", exclude_backfill=True),
        Spec("highlighted_region_only", highlighted=True),
        Spec("national_control"),
    ]


def variant_exposure(daily: DataFrame, specs: Sequence[Spec], settings: ChdSettings) -> DataFrame:
    """Annual compound days of every variant from one pass over the daily table.

    Each distinct quantile is computed once on the shared partitioning; the variants are
    only different conditional sums of the same flags.
    """
    s = settings
    work = rolling_sum(daily.where(F.col("year").between(s.year_min, s.year_max)), "precipitation_mm", "_rain", rows=s.rolling_days)
    month = Window.partitionBy("province", "month")
    base = lambda c: F.when(F.col("year").between(*s.baseline), F.col(c))
    hot = {q: f"_hot{i}" for i, q in enumerate(sorted({v.heat for v in specs}))}
    dry = {q: f"_dry{i}" for i, q in enumerate(sorted({v.drought for v in specs}))}
    flags = {name: is_true(F.col("tmax_c") > bounded_quantile(base("tmax_c"), q).over(month)) for q, name in hot.items()}
    flags |= {name: is_true(F.col("_rain") < bounded_quantile(base("_rain"), q).over(month)) for q, name in dry.items()}
    season = sorted({m for v in specs for m in v.months})
    counts = [
        F.when(
            F.count_if(F.col("month").isin(*v.months)) > 0,
            F.count_if(F.col(hot[v.heat]) & F.col(dry[v.drought]) & F.col("month").isin(*v.months)),
        ).alias(v.name)
        for v in specs
    ]
    return work.withColumns(flags).where(F.col("month").isin(*season)).groupBy("province", "province_code", "year").agg(*counts)


def robustness_fits(panel: DataFrame, daily: DataFrame, settings: ChdSettings, highlighted: Sequence[str], outcome: str,
                    keys: Sequence[str] = ("province", "year"), specs: Sequence[Spec] | None = None) -> dict[str, FixedEffectsFit]:
    """Fit all variants together: one long table of (variant, unit, year), one set of aggregates."""
    specs = list(specs or standard_specs(settings))
    swapped = [s for s in specs if s.heat is not None]
    wide = variant_exposure(daily, swapped, settings).select(*keys, *[s.name for s in swapped])
    joined = panel.join(wide, list(keys), "left")
    backfilled = truthy("is_backfill") if "is_backfill" in panel.columns else F.lit(False)
    entries = []
    for s in specs:
        kept = F.lit(True)
        if s.exclude_backfill:
            kept = kept & ~backfilled
        if s.highlighted:
            kept = kept & F.col("province").isin(*highlighted)
        value = F.col(s.name if s.heat is not None else "chd_annual").cast("double")
        entries.append(F.struct(F.lit(s.name).alias("spec"), F.when(kept, value).alias("x")))
    long = joined.select(*keys, outcome, F.inline(F.array(*entries))).where("x is not null")
    return fit_two_way_by(long, "spec", outcome, ["x"], keys[0], keys[1])


SPEC_SCHEMA = (
    "spec_id string, sample_size bigint, chd_coefficient double, standard_error double, p_value double, direction string, "
    "significant_at_10pct boolean, significant_at_5pct boolean, model_scope string, claim_strength_allowed string"
)


def spec_rows(fits: dict[str, FixedEffectsFit], specs: Sequence[Spec], covered: dict[str, bool]) -> list[tuple]:
    """Result row per variant; ``covered`` says whether both coverages reach the gate."""
    rows = []
    for s in specs:
        fit = fits.get(s.name, FixedEffectsFit(reason="no complete rows"))
        b, se, p = fit.estimates.get("x"), fit.standard_errors.get("x"), fit.p_values.get("x")
        sign = "unavailable" if b is None else "negative" if b < 0 else "positive" if b > 0 else "zero"
        usable = fit.reason is None
        rows.append((
            s.name, fit.n, b, se, p, sign, p is not None and p < 0.10, p is not None and p < 0.05,
            "province_fixed_effects_and_event_study_candidate" if usable else "fixed_effects_unavailable",
            "impact_assessment" if usable and covered.get(s.name, False) else "association",
        ))
    return rows
