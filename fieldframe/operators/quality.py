"""Coverage, quality, gates and summary tables.

Everything is an aggregate; only decisions over a bounded number of classes are taken
on the driver. Distinct units, years and cells are counted in levels (cell, unit, group),
so a group that holds most rows is combined before each shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldframe.operators.scalars import with_row
from fieldframe.functions.names import normalize_province_name
from fieldframe.functions.numbers import as_number
from fieldframe.functions.text import TRUE_TOKENS_WITH_PASS, blank, clean_text, contains_any, first_rule, truthy

YIELD_COLUMNS = ("yield_kg_per_hectare", "rice_yield_kg_per_hectare", "grain_yield_kg_per_hectare")
AREA_COLUMNS = ("sown_area_hectare", "harvested_area_hectare")


def present(c: Column | str) -> Column:
    """Neither null nor blank."""
    column = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.trim(column.cast("string")) != "", F.lit(False))


def tall(one_row: DataFrame, section: str | None = None) -> DataFrame:
    """One row of numbers to rows ``(metric, value)``."""
    numbers = one_row.select(*[F.col(c).cast("double").alias(c) for c in one_row.columns])
    out = numbers.unpivot([], numbers.columns, "metric", "value")
    return out if section is None else out.select(F.lit(section).alias("section"), "metric", "value")


# --- yield coverage and tier ----------------------------------------------------------------

def recommendation(level: Column, crop: Column, rate: Column) -> Column:
    """What a coverage rate allows; the labels and limits are fixed values."""
    sub = level.isin("county", "prefecture")
    return first_rule(
        [
            ((level == "county") & (crop == "rice") & (rate >= 0.75), F.lit("use_county_rice_main_model")),
            ((level == "prefecture") & (crop == "rice") & (rate >= 0.75), F.lit("use_prefecture_rice_main_model")),
            ((crop == "grain") & sub & (rate >= 0.75), F.lit("downgrade_main_model_to_grain_yield")),
            ((rate >= 0.5) & sub, F.lit("run_fixed_effects_and_exploratory_event_study_with_caution")),
        ],
        F.lit("official_yield_coverage_insufficient_use_remote_sensing_growth_analysis"),
    )


def yield_coverage(df: DataFrame, expected: tuple[int, int] | None = None) -> DataFrame:
    """Coverage per source, level and crop of rows that carry ``admin_key`` and measures."""
    groups = ["source_file", "admin_level", "crop_type"]
    span = (
        df.agg(F.min("year").alias("_lo"), F.max("year").alias("_hi")) if expected is None
        else df.sparkSession.createDataFrame([expected], "_lo int, _hi int")
    )
    within = lambda: F.col("year").between(F.col("_lo"), F.col("_hi"))
    have = lambda names: [as_number(c) for c in names if c in df.columns]
    outside = [F.when((v < 500) | (v > 15000), 1).otherwise(0) for v in have(YIELD_COLUMNS)]
    outside += [F.when(v <= 0, 1).otherwise(0) for v in have(AREA_COLUMNS)]
    outside += [F.when(v < 0, 1).otherwise(0) for v in have(("production_ton",))]
    any_of = lambda values: F.max(F.coalesce(*values).isNotNull().cast("int")) if values else F.lit(0)
    cells = df.groupBy(*groups, "admin_key", "year").agg(
        F.count(F.lit(1)).alias("_rows"), F.sum(sum(outside[1:], outside[0])).alias("_odd"),
        any_of(have(YIELD_COLUMNS)).alias("_y"), any_of(have(AREA_COLUMNS)).alias("_a"),
        any_of(have(("production_ton",))).alias("_p"),
    )
    cells = with_row(cells, span)
    named = F.col("admin_key") != ""
    units = cells.groupBy(*groups, "admin_key", "_lo", "_hi").agg(
        F.count_if(within()).alias("_in"), F.count("year").alias("_pairs"), F.count(F.lit(1)).alias("_cells"),
        F.sum("_rows").alias("_rows"), F.sum("_odd").alias("_odd"), F.max("_y").alias("_y"), F.max("_a").alias("_a"),
        F.max("_p").alias("_p"),
    )
    size = F.col("_hi") - F.col("_lo") + 1
    by_group = units.groupBy(*groups, "_lo", "_hi").agg(
        F.count_if(named).alias("admin_unit_count"), F.count_if(F.col("_in") == size).alias("balanced_panel_unit_count"),
        F.coalesce(F.sum(F.when(named, F.col("_pairs"))), F.lit(0)).alias("_pairs"),
        (F.sum("_rows") - F.sum("_cells")).alias("duplicate_record_count"), F.sum("_odd").alias("suspicious_value_count"),
        F.max("_y").alias("_y"), F.max("_a").alias("_a"), F.max("_p").alias("_p"),
    )
    years = cells.where("year is not null").select(*groups, "year", "_lo", "_hi").distinct().groupBy(*groups).agg(
        F.min("year").alias("coverage_year_start"), F.max("year").alias("coverage_year_end"),
        F.count_if(within()).alias("observed_years"),
    )
    rate = F.coalesce("observed_years", F.lit(0)) / size
    units_n = F.col("admin_unit_count")
    detected = lambda c, word: F.when(F.col(c) == 1, word).otherwise("missing")
    return by_group.join(years, groups, "left").select(
        *groups, "coverage_year_start", "coverage_year_end", size.alias("expected_years"),
        F.coalesce("observed_years", F.lit(0)).alias("observed_years"), F.round(rate, 4).alias("year_coverage_rate"),
        "admin_unit_count", "balanced_panel_unit_count", F.round(1.0 - rate, 4).alias("missing_rate_by_year"),
        F.round(F.when(units_n == 0, 1.0).otherwise(1.0 - F.try_divide(F.col("_pairs"), units_n * size)), 4).alias("missing_rate_by_admin"),
        detected("_y", "kg/ha_standardized").alias("yield_unit_detected"),
        detected("_a", "hectare_standardized").alias("area_unit_detected"),
        detected("_p", "ton_standardized").alias("production_unit_detected"),
        "suspicious_value_count", "duplicate_record_count",
        recommendation(F.col("admin_level"), F.col("crop_type"), rate).alias("recommendation"),
    )


# Words that mark a proxy row, and the tiers in order of preference.
PROXY_WORDS = ("proxy", "remote", "ndvi", "evi", "ggcp", "asiarice", "yield_proxy")
RICE_TYPES = ("rice", "early_rice", "single_rice", "late_rice")
TIERS = (
    ("tier_1", ("prefecture", "county"), RICE_TYPES),
    ("tier_2", ("prefecture", "county"), ("grain",)),
    ("tier_3", ("province",), RICE_TYPES + ("grain",)),
)


def is_proxy(columns: Sequence[Column]) -> Column:
    return contains_any(F.concat_ws(" ", *[F.lower(blank(c)) for c in columns]), PROXY_WORDS)


def data_tier(df: DataFrame) -> dict[str, object]:
    """Tier of a yield panel with ``admin_level, crop_type, is_proxy, usable, year``.

    One aggregate: which tiers have rows, the commonest level and crop of each, and the
    span of years; the decision is a lookup over that one row.
    """
    usable = ~F.col("is_proxy") & F.col("usable")
    facts = [F.count_distinct("year").alias("n"), F.min("year").alias("lo"), F.max("year").alias("hi"),
             F.bool_or("is_proxy").alias("proxy"), F.mode("admin_level", True).alias("level")]
    for name, levels, crops in TIERS:
        fits = usable & F.col("admin_level").isin(*levels) & F.col("crop_type").isin(*crops)
        facts += [F.count_if(fits).alias(f"{name}_n"), F.mode(F.when(fits, F.col("admin_level")), True).alias(f"{name}_level"),
                  F.mode(F.when(fits, F.col("crop_type")), True).alias(f"{name}_crop")]
    span = df.agg(*facts).first()
    rate = span["n"] / (span["hi"] - span["lo"] + 1) if span["n"] else 0.0
    tier, level, crop = "missing", "unknown", "unknown"
    for name, _, _ in TIERS:
        if span[f"{name}_n"]:
            tier, level, crop = name, span[f"{name}_level"], span[f"{name}_crop"]
            break
    if tier == "missing" and span["proxy"]:
        tier, level, crop = "tier_4", span["level"], "proxy"
    strength = (
        "quasi_causal" if tier == "tier_1" and rate >= 0.75
        else "impact_assessment" if tier in ("tier_1", "tier_2") and rate >= 0.5
        else "association" if tier == "tier_3" else "descriptive"
    )
    reasons = {
        "tier_2": "rice_panel_missing_use_grain_panel",
        "tier_3": "county_or_prefecture_panel_missing_use_province_panel",
        "tier_4": "remote_sensing_or_gridded_proxy_only",
    }
    if tier == "tier_1":
        reason = "none" if rate >= 0.75 else "year_coverage_below_0_75"
    else:
        reason = reasons.get(tier, "no_classifiable_yield_panel")
    scope = {"tier_4": "remote_sensing_growth_anomaly_analysis", "missing": "data_gap_only"}.get(tier, f"{level}_{crop}_yield_anomaly")
    claim = {"tier_4": "official_yield_loss_claim; strong_causal_claim", "missing": "yield_impact_claim"}.get(
        tier, "strong_causal_claim_without_valid_identification" if rate < 0.75
        else "strong_causal_claim_without_parallel_trends_and_coverage_checks")
    return {
        "tier": tier, "admin_level": level, "crop_type": crop, "observed_years": span["n"], "year_coverage_rate": rate,
        "conclusion_strength": strength, "downgrade_reason": reason, "recommended_scope": scope, "forbidden_claim": claim,
    }


# --- missing values, correlation ------------------------------------------------------------

def missing_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of rows in which a column is null or blank; an empty table misses everything."""
    rates = df.agg(*[
        F.coalesce(F.avg(F.when(present(c), 0.0).otherwise(1.0)), F.lit(1.0)).alias(c) for c in columns
    ])
    return rates.unpivot([], list(columns), "variable", "missing_rate")


def valid_observations(df: DataFrame, unit: str, column: str) -> DataFrame:
    """Non-missing values per unit; units without any stay with 0."""
    return df.where(present(unit)).groupBy(unit).agg(F.count_if(present(column)).alias("valid_observations"))


def correlation_matrix(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Pearson correlation of all pairs, pairwise complete, from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(fields) for b in fields[i:]]
    aggs = []
    for i, (a, b) in enumerate(pairs):
        x, y = as_number(a), as_number(b)
        both = x.isNotNull() & y.isNotNull()
        value = F.corr(F.when(both, x), F.when(both, y))
        aggs.append(F.round(F.when(~F.isnan(value), value), 12).alias(f"c{i}"))
    wide = df.agg(*aggs)
    cells = []
    for i, (a, b) in enumerate(pairs):
        for left, right in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(left).alias("left"), F.lit(right).alias("right"), F.col(f"c{i}").alias("correlation")))
    return wide.select(F.inline(F.array(*cells)))


def pairwise_vif(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Variance inflation from the strongest pairwise correlation; null when it is perfect."""
    matrix = correlation_matrix(df, fields)
    strongest = F.coalesce(F.max(F.when(F.col("left") != F.col("right"), F.col("correlation") * F.col("correlation"))), F.lit(0.0))
    return matrix.groupBy(F.col("left").alias("variable")).agg(
        F.when(strongest < 1.0, 1.0 / F.when(strongest < 1.0, 1.0 - strongest)).alias("vif")
    )


# --- coverage -------------------------------------------------------------------------------

def coverage_rates(df: DataFrame, columns: Sequence[str], unit: str, low: int, high: int) -> DataFrame:
    """Per column: share of rows filled, and filled rows over the expected unit-year cells."""
    units = F.count_distinct(F.when(present(unit), F.trim(F.col(unit).cast("string"))))
    row = df.agg(F.count(F.lit(1)).alias("_rows"), units.alias("_units"), *[F.count_if(present(c)).alias(c) for c in columns])
    tall_rows = row.unpivot(["_rows", "_units"], list(columns), "column", "nonmissing")
    expected = F.col("_units") * (high - low + 1)
    share = lambda d: F.coalesce(F.try_divide(F.col("nonmissing"), d), F.lit(0.0))
    return tall_rows.select(
        "column", "nonmissing", share(F.col("_rows")).alias("row_rate"), share(expected).alias("target_rate")
    )


def highlight_coverage(df: DataFrame, name: str, regions: Sequence[str], column: str, low: int, high: int) -> DataFrame:
    """Filled rows of the listed regions over their expected unit-year cells."""
    from fieldframe.operators.grid import filter_regions

    expected = len(set(regions)) * (high - low + 1)
    return filter_regions(df, name, regions).agg((F.count_if(present(column)) / F.lit(expected)).alias("coverage"))


def claim_gate(rates: DataFrame, exposure: str, outcome: str, limit: float = 0.75) -> DataFrame:
    """Allowed claim strength and panel status from the target coverage table."""
    at = lambda c: F.coalesce(F.max(F.when(F.col("column") == c, F.col("target_rate"))), F.lit(0.0))
    row = rates.agg(at(exposure).alias("exposure_rate"), at(outcome).alias("outcome_rate"))
    both = (F.col("exposure_rate") >= limit) & (F.col("outcome_rate") >= limit)
    return row.withColumns({
        "claim_strength": F.when(both, "impact_assessment").otherwise("association"),
        "status": F.when(F.col("exposure_rate") >= limit, "ok").when(F.col("exposure_rate") > 0, "partial").otherwise("empty"),
        "exposure_status": F.when(F.col("exposure_rate") >= limit, "ok_for_province_fixed_effects").otherwise("not_usable_until_fixed"),
    })


# --- exposure diagnosis ---------------------------------------------------------------------

EXPOSURE_FIELDS = ("exposure_index", "chd_annual", "CHD_intensity", "chd_event_intensity")


def counts_by(df: DataFrame, column: str, section: str, metric: str, only: Column | None = None) -> DataFrame:
    """Rows per value as ``(section, metric, value)`` with the value in the metric name."""
    rows = df if only is None else df.where(only)
    label = F.trim(F.col(column).cast("string"))
    return rows.where(present(column)).groupBy(label.alias("_k")).agg(F.count(F.lit(1)).alias("_n")).select(
        F.lit(section).alias("section"), F.concat(F.lit(f"{metric}:"), "_k").alias("metric"), F.col("_n").cast("string").alias("value")
    )


def exposure_diagnosis(model: DataFrame, annual_exposure: str, sources: Mapping[str, DataFrame], event_year: int,
                       study: Sequence[str] = ()) -> DataFrame:
    """Why exposure is missing: counts, ordered causes and the usable scope.

    The facts are one aggregate over the model panel and one small one per source; year
    sets are bounded by the calendar and units are only counted.
    """
    exposure = next((f for f in EXPOSURE_FIELDS if f in model.columns), None)
    filled = present(exposure) if exposure else F.lit(False)
    name = normalize_province_name("province")
    coded = F.count_if(present("admin_code")) if "admin_code" in model.columns else F.lit(0)
    annual = F.count_if(present(annual_exposure)) if annual_exposure in model.columns else F.lit(0)
    facts = model.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(filled).alias("filled"),
        F.collect_set(F.when(filled, F.col("year").cast("int"))).alias("years"),
        F.count_distinct(F.when(name != "", name)).alias("units"),
        F.count_distinct(F.when(filled & (name != ""), name)).alias("exposed_units"),
        (F.count_if((name != "") & ~name.isin(*study)) if study else F.lit(0)).alias("outside"),
        coded.alias("coded"), annual.alias("annual"),
    )
    out = facts
    for label, frame in sources.items():
        side = frame.agg(
            F.count(F.lit(1)).alias(f"{label}_rows"), F.min("year").cast("int").alias(f"{label}_lo"), F.max("year").cast("int").alias(f"{label}_hi")
        )
        out = with_row(out, side)
    rate = F.coalesce(F.try_divide(F.col("filled"), F.col("rows")), F.lit(0.0))
    nothing = F.lit(True)
    for label in sources:
        nothing = nothing & (F.col(f"{label}_rows") == 0)
    only_event = F.col("years") == F.array(F.lit(event_year))
    # Fixed order of causes.
    causes = F.array_compact(F.array(
        F.when(F.col("annual") == 0, "no_annual_exposure_panel"),
        F.when(only_event, "only_2022_event_exposure" if event_year == 2022 else f"only_{event_year}_event_exposure"),
        F.when(F.col("outside") > 0, "study_region_mismatch"),
        F.when((F.col("units") > F.col("exposed_units")) & (F.col("exposed_units") > 0), "national_yield_but_regional_exposure"),
        F.when((F.col("filled") < F.col("coded") * 0.25) & (F.col("filled") > 0) & (rate < 0.75), "admin_join_mismatch"),
        F.when((rate == 0) & nothing, "climate_data_missing"),
        F.when((rate == 0) & ~nothing, "aggregation_failed"),
    ))
    status = first_rule(
        [
            ((rate >= 0.75) & (F.size("years") >= 5), F.lit("ok_for_panel_model")),
            (only_event & (rate > 0), F.lit(f"ok_only_for_{event_year}_cross_section")),
        ],
        F.lit("not_usable_until_fixed"),
    )
    text = lambda c: c.cast("string")
    decimal = lambda c: F.round(c, 6).cast("decimal(20,6)").cast("string")
    entries = [
        ("summary", "model_panel_rows", text(F.col("rows"))), ("summary", "exposure_field", F.lit(exposure or "")),
        ("summary", "exposure_nonmissing", text(F.col("filled"))), ("summary", "exposure_nonmissing_rate", decimal(rate)),
        ("summary", "exposure_coverage_status", status),
        ("summary", "likely_causes", F.when(F.col("rows") == 0, "unknown").when(F.size(causes) == 0, "unknown").otherwise(F.array_join(causes, ";"))),
        ("join_loss", "missing_admin_year_count", text(F.col("rows") - F.col("filled"))),
        ("join_loss", "main_event_year", F.lit(str(event_year))),
    ]
    for label in sources:
        lo, hi = text(F.col(f"{label}_lo")), text(F.col(f"{label}_hi"))
        entries.append((label, "rows", text(F.col(f"{label}_rows"))))
        entries.append((label, "year_range", F.coalesce(F.concat_ws("-", F.nullif(lo, F.lit("")), hi), F.lit("n/a"))))
    summary = out.select(F.inline(F.array(*[
        F.struct(F.lit(s).alias("section"), F.lit(m).alias("metric"), v.alias("value")) for s, m, v in entries
    ])))
    for column in ("year", "province"):
        summary = summary.unionByName(counts_by(model, column, "model_panel", f"{column}_distribution"))
        summary = summary.unionByName(counts_by(model, column, "exposure", f"nonmissing_by_{column}", filled))
    return summary


# --- model scope ----------------------------------------------------------------------------

# Names of the gates.
GATES = (
    "yield_panel_coverage_gte_0_75", "pretrend_test_passed", "placebo_tests_passed", "robustness_direction_stable",
    "admin_crosswalk_match_rate_gte_0_90", "mechanism_remote_sensing_consistent",
)


def causal_gate(coverage: Column, crosswalk_rate: Column, overrides: DataFrame, facts: DataFrame) -> DataFrame:
    """All gates with their state; an override by name replaces the computed state."""
    computed = {GATES[0]: coverage >= 0.75, GATES[4]: crosswalk_rate >= 0.90}
    rows = facts.select(F.inline(F.array(*[
        F.struct(F.lit(g).alias("gate"), F.coalesce(computed.get(g, F.lit(False)), F.lit(False)).alias("computed")) for g in GATES
    ])))
    given = overrides.select(F.trim("gate").alias("gate"), truthy("passed", TRUE_TOKENS_WITH_PASS).alias("given")).where("gate <> ''")
    given = given.groupBy("gate").agg(F.max("given").alias("given"))
    return rows.join(given, "gate", "full").select("gate", F.coalesce("given", "computed").alias("passed"))


def model_scope(facts: DataFrame, gates: DataFrame) -> DataFrame:
    """Scope decision from one row of facts.

    ``facts``: tier, admin_level, crop_type, outcome_type, coverage_rate, exposure_rate,
    outcome_rate, has_event. Missing coverage fails every gate.
    """
    state = gates.agg(F.bool_and("passed").alias("gate_passed"), F.count_if(~F.col("passed")).alias("gates_missing"))
    f = with_row(facts, state)
    ok = lambda c, limit: F.coalesce(F.col(c) >= limit, F.lit(False))
    full = ok("coverage_rate", 0.75) & ok("exposure_rate", 0.75) & ok("outcome_rate", 0.75)
    event_only = F.col("has_event") & ~ok("exposure_rate", 0.75)
    province = (F.col("admin_level") == "province") & F.col("outcome_type").isin(
        "province_rice_yield_anomaly", "province_grain_yield_anomaly")
    official = F.col("tier").isin("tier_1", "tier_2")
    scope = first_rule(
        [
            (province & full, F.lit("province_fixed_effects_and_event_study_candidate")),
            (province & event_only, F.lit("province_event_cross_section_intensity")),
            (province, F.lit("province_descriptive_correlation_only")),
            (F.col("tier") == "tier_4", F.lit("remote_sensing_growth_anomaly_analysis")),
            (official & full, F.lit("fixed_effects_and_event_study")),
            (event_only, F.lit("cross_section_event_intensity")),
            (official & ok("coverage_rate", 0.5), F.lit("fixed_effects_with_exploratory_event_study")),
            (F.col("tier").isin("tier_1", "tier_2", "tier_3"), F.lit("descriptive_correlation_only")),
        ],
        F.lit("legacy_or_unclassified_descriptive"),
    )
    out = f.withColumn("model_scope", scope)
    s = F.col("model_scope")
    strong = s.isin("province_fixed_effects_and_event_study_candidate", "fixed_effects_and_event_study")
    explore = s.isin("fixed_effects_with_exploratory_event_study", "legacy_or_unclassified_descriptive")
    strength = first_rule(
        [
            (strong & F.col("gate_passed"), F.lit("quasi_causal_evidence")),
            (strong | explore, F.lit("impact_assessment")),
            (s == "remote_sensing_growth_anomaly_analysis", F.lit("descriptive")),
        ],
        F.lit("association"),
    )
    cross = s.isin("cross_section_event_intensity", "province_event_cross_section_intensity")
    primary = first_rule(
        [
            (cross & (F.col("admin_level") == "province") & (F.col("crop_type") == "grain"), F.lit("province_grain_event_cross_section")),
            (cross, F.lit("chd_event_cross_section")),
            (s == "province_fixed_effects_and_event_study_candidate", F.lit("province_two_way_fixed_effects")),
            (s == "fixed_effects_and_event_study", F.lit("two_way_fixed_effects_candidate")),
        ],
        F.lit("descriptive_ols"),
    )
    return out.withColumns({
        "run_event_study": strong | explore, "conclusion_strength": strength, "primary_model": primary,
    })


# --- summaries ------------------------------------------------------------------------------

def crosswalk_rate(df: DataFrame, confidence: str = "match_confidence", limit: float = 0.85) -> DataFrame:
    """Rows by confidence and the share of confident matches among rated rows."""
    value = as_number(confidence)
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(value >= limit).alias("high_confidence_rows"),
        F.count_if(value < limit).alias("low_confidence_rows"),
        F.coalesce(F.try_divide(F.count_if(value >= limit), F.count(value)), F.lit(0.0)).alias("high_confidence_rate"),
    )


def status_counts(df: DataFrame, column: str, missing: str = "missing") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias("status")).agg(F.count(F.lit(1)).alias("rows"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, distinct keys and surplus rows; counted per key first, so copies combine early."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("analysis_rows"), F.count(F.lit(1)).alias("unique_key_rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_key_rows"),
    )


def calibration_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("source", "calibration_status").agg(
        F.count(F.lit(1)).alias("row_count"), F.count("calibrated_yield").alias("calibrated_yield_nonmissing"))


def proxy_coverage(grid: DataFrame, low: int, high: int) -> DataFrame:
    """Available, missing and expected unit-year cells, overall and in the window."""
    inside = F.col("year").between(low, high)
    ready = F.col("status") == "available"
    row = grid.agg(
        F.count_if(ready).alias("available_admin_year_cells"), F.count_if(~ready).alias("missing_admin_year_cells"),
        (F.count_distinct("admin_id") * (high - low + 1)).alias("target_admin_year_cells"), F.count_if(ready & inside).alias("_in"),
    )
    return row.withColumn(
        "missing_admin_year_cells_target", F.greatest(F.col("target_admin_year_cells") - F.col("_in"), F.lit(0))).drop("_in")


def panel_availability(df: DataFrame, outcome: str, exposure: str, low: int, high: int) -> DataFrame:
    """Rows, years and filled outcome and exposure, overall, in the window and by year, as metrics."""
    inside = F.col("year").between(low, high)
    y, x = as_number(outcome), as_number(exposure)
    one = df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(inside).alias("main_rows"), F.min("year").alias("year_min"), F.max("year").alias("year_max"),
        F.count(y).alias("outcome_nonmissing"), F.count(x).alias("exposure_nonmissing"),
        F.count(F.when(inside, y)).alias("main_outcome_nonmissing"), F.count(F.when(inside, x)).alias("main_exposure_nonmissing"),
    )
    by_year = df.where(x.isNotNull()).groupBy("year").agg(F.count(F.lit(1)).alias("n")).select(
        F.concat(F.lit("exposed_rows:"), F.col("year").cast("string")).alias("metric"), F.col("n").cast("double").alias("value"))
    return tall(one).unionByName(by_year)


def assignment_summary(df: DataFrame, name: str) -> DataFrame:
    """Units with and without an assigned name, and distinct names in Latin letters."""
    return df.agg(
        F.count(F.lit(1)).alias("admin_units"), F.count_if(present(name)).alias("province_matched"),
        F.count_if(~present(name)).alias("province_unmatched"),
        F.count_distinct(F.when(F.col(name).rlike("[A-Za-z]"), F.col(name))).alias("non_chinese_province_names"),
    )


def event_year_summary(df: DataFrame, year: int, variable: str, unit: str, value: str) -> DataFrame:
    v = as_number(value)
    return df.where(F.col("year") == year).groupBy(variable).agg(
        F.lit(year).alias("year"), F.count(F.lit(1)).alias("row_count"), F.count_distinct(unit).alias("admin_unit_count"),
        F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))


def sample_flow(model: DataFrame, outcome: str, exposures: Sequence[str], annual: DataFrame, annual_value: str) -> DataFrame:
    """Attrition from all rows to complete model rows."""
    has = [c for c in exposures if c in model.columns]
    some = F.coalesce(*[F.col(c).cast("string") for c in has]).isNotNull() if has else F.lit(False)
    left = model.agg(
        F.count(F.lit(1)).alias("model_panel_rows"), F.min("year").alias("year_min"), F.max("year").alias("year_max"),
        F.count_distinct("province").alias("province_count"), F.count(outcome).alias("yield_anomaly_nonmissing"),
        F.count_if(some).alias("exposure_nonmissing"), F.count_if(some & F.col(outcome).isNotNull()).alias("complete_model_rows"))
    right = annual.agg(F.count(F.lit(1)).alias("annual_exposure_rows"), F.count(annual_value).alias("annual_exposure_nonmissing"))
    return tall(with_row(left, right))


def artifact_summary(tables: Mapping[str, DataFrame], coverage: Mapping[str, Sequence[str]]) -> DataFrame:
    """Per table: rows, columns, years, units and filled values, one aggregate each."""
    parts = []
    for name, df in tables.items():
        metrics = [F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns")]
        if "year" in df.columns:
            metrics += [F.min("year").alias("year_min"), F.max("year").alias("year_max")]
        if "province" in df.columns:
            metrics.append(F.count_distinct("province").alias("province_count"))
        metrics += [F.count(c).alias(f"nonmissing:{c}") for c in coverage.get(name, ()) if c in df.columns]
        parts.append(tall(df.agg(*metrics)).select(F.lit(name).alias("artifact"), "metric", "value"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Non-blank values with their counts, most frequent first, ties by value; all of them unless a report asks for the ``top``."""
    counts = df.where(present(column)).groupBy(F.trim(F.col(column).cast("string")).alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    ordered = counts.orderBy(F.col("rows").desc(), "value")
    return ordered.limit(top) if top else ordered


def numeric_summary(df: DataFrame, column: str) -> DataFrame:
    v = as_number(column)
    return df.agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))


def missing_year_share(df: DataFrame, low: int, high: int, watched: Sequence[int]) -> DataFrame:
    """Share of wholly absent calendar years that fall on the watched ones (0 when none is absent)."""
    seen = df.agg(F.collect_set(F.col("year").cast("int")).alias("_seen"))  # bounded by the calendar
    absent = F.array_except(F.sequence(F.lit(low), F.lit(high)), "_seen")
    hits = F.array_intersect(absent, F.array(*[F.lit(int(y)) for y in watched]))
    return seen.select(
        F.size(absent).cast("bigint").alias("missing_years"),
        F.coalesce(F.try_divide(F.size(hits), F.size(absent)), F.lit(0.0)).alias("share"))


def pretrend_test(terms: DataFrame) -> DataFrame:
    """True when every pre-event term is insignificant; false without pre-event terms."""
    b, se = as_number("estimate"), as_number("standard_error")
    fine = F.coalesce(F.when(se > 0, F.abs(b) <= 1.96 * se).otherwise(F.abs(b) <= 0.1), F.lit(False))
    return terms.where(F.col("term").startswith("event_time_m")).agg(F.coalesce(F.bool_and(fine), F.lit(False)).alias("passed"))


def top_rows(df: DataFrame, column: str, n: int, tie: Sequence[str], largest: bool = True) -> DataFrame:
    """The n largest (or smallest) rows of a column, missing values last."""
    order = F.col(column).desc_nulls_last() if largest else F.col(column).asc_nulls_last()
    return df.orderBy(order, *tie).limit(n)


# Preference of models and terms for the headline coefficient.
MODEL_ORDER = ("province_two_way_fixed_effects", "descriptive_ols")
TERM_ORDER = ("chd_annual", "chd_event_intensity", "exposure_index")


def main_coefficient(df: DataFrame, tie: Sequence[str] = ()) -> DataFrame:
    """The headline coefficient row by model, then term preference."""
    rank = lambda c, names: first_rule([(F.col(c) == n, F.lit(i)) for i, n in enumerate(names)], F.lit(99))
    return df.where(F.col("term").isin(*TERM_ORDER)).orderBy(rank("model", MODEL_ORDER), rank("term", TERM_ORDER), *tie).limit(1)


def model_audit(coefficients: DataFrame, events: DataFrame, panel: DataFrame, unit: str, event_year: int, flag_column: str,
                window: tuple[int, int], watched: Sequence[int]) -> DataFrame:
    """Audit rows ``(check, status, value)`` over coefficient, event-study and model tables."""
    from fieldframe.functions.names import direction, significance
    from fieldframe.operators.treatment import treatment_counts

    fe = (F.col("model") == MODEL_ORDER[0]) & (F.col("term") == TERM_ORDER[0])
    c = coefficients.agg(
        F.count_if(F.col("model") == "descriptive_ols").alias("ols"), F.count_if(F.col("model") == MODEL_ORDER[0]).alias("fe"),
        *[F.max(F.when(fe, F.col(x))).alias(x) for x in ("estimate", "p_value", "n_obs", "r2", "adjusted_r2")])
    e = events.agg(F.count_if(F.col("model") == "event_study_candidate").alias("event"))
    p = panel.agg(F.count_distinct(unit).alias("units"), F.count_distinct("year").alias("years"))
    row = c
    for side in (e, p, pretrend_test(events), treatment_counts(panel, unit, event_year, flag_column),
                 missing_year_share(panel, *window, watched).select("share")):
        row = with_row(row, side)
    number = lambda x: F.coalesce(F.round(F.col(x), 6).cast("decimal(20,6)").cast("string"), F.lit(""))
    whole = lambda x: F.coalesce(F.col(x).cast("bigint").cast("string"), F.lit(""))
    check = lambda name, ok: (name, F.when(ok, "passed").otherwise("failed"), F.initcap(ok.cast("string")), F.lit(""))
    info = lambda name, value, note=F.lit(""): (name, F.lit("info"), value, note)
    has_fe = F.col("fe") > 0
    checks = [
        check("has_descriptive_ols", F.col("ols") > 0), check("has_province_two_way_fixed_effects", has_fe),
        check("has_event_study_candidate", F.col("event") > 0),
        info("chd_annual_coefficient", number("estimate"), direction("estimate")),
        info("chd_annual_p_value", number("p_value"), significance("p_value")),
        info("sample_size", whole("n_obs")), info("r2", number("r2")), info("adjusted_r2", number("adjusted_r2")),
        check("contains_province_fe", has_fe & (F.col("units") >= 2)), check("contains_year_fe", has_fe & (F.col("years") >= 2)),
        check("pretrend_test_passed", F.col("passed")),
        info("treated_province_count", whole("treated")), info("control_province_count", whole("control")),
        info("missing_rows_concentrated_in_watched_years", number("share")),
    ]
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("check"), s.alias("status"), v.alias("value"), t.alias("notes")) for n, s, v, t in checks])))
