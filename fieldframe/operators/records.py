"""Row-level cleaning operators: entry templates, statistics rows, zone identifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldframe.functions import units as U
from fieldframe.functions.names import normalize_admin_code, source_priority
from fieldframe.functions.numbers import as_number, flag, parse_strict_int
from fieldframe.functions.text import blank, clean_text, first_rule
from fieldframe.operators.picks import number_rows, pick_one

# Crops an entry template may hold.
TEMPLATE_CROPS = ("rice", "early_rice", "single_rice", "middle_rice", "late_rice", "grain", "wheat", "maize")
TEMPLATE_LEVELS = ("national", "province", "prefecture", "county")


def _converted(rows: DataFrame) -> DataFrame:
    area, area_note = U.convert_coded("area_value", "area_unit", U.CODED_AREA, "area")
    mass, mass_note = U.convert_coded("production_value", "production_unit", U.CODED_PRODUCTION, "production")
    rate, rate_note = U.convert_coded("yield_value", "yield_unit", U.CODED_YIELD, "yield")
    out = rows.withColumns({"area_hectare": area, "production_ton": mass, "_reported": rate})
    derived = F.when(
        F.col("_reported").isNull() & (F.col("area_hectare") != 0),
        F.try_divide(F.col("production_ton") * 1000.0, F.col("area_hectare")),
    )
    return out.withColumns({
        "yield_kg_per_hectare": F.coalesce("_reported", derived),
        "yield_source": F.when(F.col("_reported").isNotNull(), "reported")
        .when(derived.isNotNull(), "derived_from_area_and_production")
        .otherwise(""),
        "_notes": F.concat_ws("; ", area_note, mass_note, rate_note),
    }).drop("_reported")


def validate_template(rows: DataFrame) -> DataFrame:
    """Manual template rows with metrics converted, notes, and the first reason to reject (null if accepted)."""
    texts = [c for c, t in rows.dtypes if t == "string"]
    work = _converted(rows.withColumns({c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in texts}))
    crop = F.lower(F.col("crop"))
    year = parse_strict_int("content_year")
    no_metric = F.coalesce("area_hectare", "production_ton", "yield_kg_per_hectare").isNull()
    reason = first_rule(
        [
            (~crop.isin(*TEMPLATE_CROPS), F.concat(F.lit("unsupported crop '"), crop, F.lit("'"))),
            (year.isNull(), F.lit("content_year is required and must be an integer")),
            ((F.col("province") == "") & (F.col("admin_code") == ""), F.lit("province or admin_code is required")),
            (no_metric, F.lit("at least one area, production, or yield metric is required")),
        ],
        F.lit(None).cast("string"),
    )
    level_note = F.when(
        (F.col("admin_level") != "") & ~F.col("admin_level").isin(*TEMPLATE_LEVELS),
        F.concat(F.lit("unrecognized admin_level '"), F.col("admin_level"), F.lit("'")),
    )
    names = F.array("province", "prefecture", "county")
    joined = F.regexp_replace(F.array_join(names, "|"), r"^\|+|\|+$", "")
    coded = F.col("admin_code") != ""
    return work.withColumns({
        "reject_reason": reason,
        "crop": crop,
        "year": year,
        "yearbook_year": parse_strict_int("yearbook_year"),
        "admin_id": F.when(coded, F.col("admin_code")).otherwise(joined),
        "source_priority": source_priority(F.col("source_type"), F.col("source_name")),
        "match_confidence": F.when(coded, 1.0).otherwise(0.0),
        "match_method": F.when(coded, "provided_admin_code").otherwise("name_unmatched"),
        "validation_notes": F.concat_ws("; ", level_note, F.nullif(F.col("_notes"), F.lit(""))),
    }).drop("_notes")


def validate_backfill(rows: DataFrame, first_year: int = 2008, last_year: int = 2015) -> DataFrame:
    """Yearbook backfill rows: grain, province level, content year in range, yearbook one year later."""
    texts = [c for c, t in rows.dtypes if t == "string"]
    work = _converted(rows.withColumns({c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in texts}))
    year, book = parse_strict_int("content_year"), parse_strict_int("yearbook_year")
    level = F.coalesce(F.nullif(F.col("admin_level"), F.lit("")), F.lit("province"))
    crop = F.lower(F.coalesce(F.nullif(F.col("crop"), F.lit("")), F.lit("grain")))
    reason = first_rule(
        [
            (year.isNull(), F.lit("content_year is required and must be an integer")),
            (~year.between(first_year, last_year), F.lit(f"content_year must be in {first_year}-{last_year}")),
            (book.isNotNull() & (book != year + 1), F.concat(
                F.lit("yearbook_year must equal content_year + 1 ("), (year + 1).cast("string"), F.lit(")"))),
            ((F.col("province") == "") & (F.col("admin_code") == ""), F.lit("province or province_code is required")),
            (level != "province", F.lit("admin_level must be province")),
            (crop != "grain", F.lit("crop must be grain for this backfill template")),
            (F.col("yield_kg_per_hectare").isNull(),
             F.lit("yield_value or production_value plus area_value is required")),
        ],
        F.lit(None).cast("string"),
    )
    return work.withColumns({
        "reject_reason": reason, "year": year, "yearbook_year": F.coalesce(book, year + 1),
        "admin_level": level, "crop": crop, "is_backfill": F.lit(True),
        "admin_id": F.coalesce(F.nullif(F.col("admin_code"), F.lit("")), F.col("province")),
        "validation_notes": F.col("_notes"),
    }).drop("_notes")


def dedupe_priority(rows: DataFrame, keys: Sequence[str], priority: str, tie: Sequence[Column]) -> DataFrame:
    """Best source per key; the tie order makes the choice repeatable."""
    return pick_one(rows, keys, [F.coalesce(F.col(priority), F.lit(0)).desc(), *tie])


def fill_code_from_group(rows: DataFrame, name: str, code: str, order: str) -> DataFrame:
    """Normalised code; a missing one comes from the first row of the same name that has one."""
    coded = rows.withColumn(code, normalize_admin_code(code)).withColumn(name, F.trim(F.coalesce(F.col(name), F.lit(""))))
    known = (
        coded.where((F.col(name) != "") & (F.col(code) != ""))
        .groupBy(name)
        .agg(F.min_by(code, order).alias("_code"))
    )
    filled = F.when(F.col(code) != "", F.col(code)).otherwise(F.coalesce("_code", F.lit("")))
    return coded.join(known, name, "left").withColumn(code, filled).drop("_code")


def zone_ids(zones: DataFrame, order: str, code: str | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """Standard zone id: the code column when the table has one, else a number by the given order."""
    if code is not None and code in zones.columns:
        out = zones.withColumn("admin_id", F.trim(F.col(code).cast("string")))
    else:
        out = number_rows(zones, order, "_n").withColumn(
            "admin_id", F.format_string("admin_%06d", F.col("_n"))
        ).drop("_n")
    for source, target in (names or {}).items():
        out = out.withColumn(target, F.trim(F.col(source).cast("string")))
    return out


def row_stats(rows: DataFrame) -> DataFrame:
    """Zone statistics of a source row: mean else value; the other measures default to it."""
    value = F.coalesce(as_number("mean"), as_number("value"))
    there = lambda c, default: F.when(F.col("_value").isNotNull(), F.coalesce(as_number(c), default))
    base = rows.withColumn("_value", value)
    count = F.coalesce(F.nullif(as_number("valid_pixel_count"), F.lit(0.0)), F.lit(1.0)).cast("bigint")
    return base.withColumns({
        "median": there("median", F.col("_value")),
        "min": there("min", F.col("_value")),
        "max": there("max", F.col("_value")),
        "std": there("std", F.lit(0.0)),
        "valid_pixel_count": F.when(F.col("_value").isNotNull(), count).otherwise(F.lit(0).cast("bigint")),
        "mean": F.col("_value"),
    }).drop("_value")


def fill_exposure(rows: DataFrame) -> DataFrame:
    """Keep a non-blank exposure index, else take the annual exposure."""
    kept = as_number(clean_text("exposure_index"))
    return rows.withColumn("exposure_index", F.coalesce(kept, F.col("chd_annual").cast("double")))


def statistics_row(rows: DataFrame) -> DataFrame:
    """Measures of a statistics row in tons, hectares and kg per hectare, yield derived when absent."""
    out = rows.withColumns({
        "area_hectare": U.area_to_hectare("area", "area_unit"),
        "production_ton": U.production_to_ton("production", "production_unit"),
        "_yield": U.yield_to_kg_ha("yield", "yield_unit"),
    })
    derived = U.derive_yield(F.col("production_ton"), F.col("area_hectare"))
    return out.withColumn("yield_kg_per_hectare", F.coalesce("_yield", derived)).withColumn(
        "derived", flag(F.col("_yield").isNull() & derived.isNotNull())
    ).drop("_yield")


def missing_year_events(rows: DataFrame, raw_year: str, source: Column, row_number: Column) -> DataFrame:
    """Quality events for rows whose year cell cannot be read."""
    from fieldframe.functions.numbers import parse_number

    return rows.where(parse_number(raw_year).isNull()).select(
        source.alias("source_file"), row_number.alias("source_row"),
        F.lit("missing_year").alias("issue"), F.lit("Year field is empty or invalid.").alias("message"),
    )


def default_phenology(months: Sequence[int]) -> tuple[int, int, str]:
    """Start, end and text of the default growth window."""
    kept = sorted(set(months)) or [6, 7, 8, 9]
    return kept[0], kept[-1], ",".join(str(m) for m in kept)


def default_unit_rows(units: DataFrame, target_year: int, months: Sequence[int], mask: str | None) -> DataFrame:
    """Default crop status and growth window of every unit when no grid is available."""
    start, end, text = default_phenology(months)
    return units.select(
        "admin_id", "admin_name", F.lit(target_year).alias("target_year"),
        F.lit(mask or "").alias("crop_source"),
        F.lit("metadata_only" if mask else "missing_mask").alias("crop_status"),
        F.lit(start).alias("start_month"), F.lit(end).alias("end_month"), F.lit(text).alias("months"),
        F.lit("default").alias("source"), F.lit("default").alias("phenology_status"),
    )


def phenology_window(stages: DataFrame, unit: str, year: int, months: Sequence[int]) -> DataFrame:
    """Growth window per unit: month of the first transplanting to month of the last maturity.

    ``stages`` has one row per unit, stage and day value; a unit lacking either stage, or
    whose end precedes its start, takes the default window.
    """
    start, end, text = default_phenology(months)
    days = stages.groupBy(unit).agg(
        F.min(F.when(F.col("stage") == "transplanting", F.col("doy"))).alias("_first"),
        F.max(F.when(F.col("stage") == "maturity", F.col("doy"))).alias("_last"),
    )
    both = F.col("_first").isNotNull() & F.col("_last").isNotNull()
    out = days.withColumns({
        "_s": U.doy_to_month(F.col("_first"), year), "_e": U.doy_to_month(F.col("_last"), year),
    })
    ordered = F.col("_e") >= F.col("_s")
    window = F.array_join(F.transform(F.sequence("_s", "_e"), lambda m: m.cast("string")), ",")
    default_text = ",".join(str(m) for m in range(start, end + 1))
    return out.select(
        unit,
        F.when(both & ordered, F.col("_s")).otherwise(F.lit(start)).alias("start_month"),
        F.when(both & ordered, F.col("_e")).otherwise(F.lit(end)).alias("end_month"),
        F.when(both & ordered, window).when(both, F.lit(default_text)).otherwise(F.lit(text)).alias("months"),
        F.when(both, "zonal_stats").otherwise("default").alias("status"),
    )


def infer_time_step(df: DataFrame, source: str, time: str, out: str) -> DataFrame:
    """Seconds between the two earliest distinct times of each source.

    The dense rank limit is applied before the shuffle, so a long series is not moved.
    """
    window = Window.partitionBy(source).orderBy(time)
    early = df.select(source, time).withColumn("_r", F.dense_rank().over(window)).where("_r <= 2")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return early.groupBy(source).agg(
        F.when(
            F.max(time) > F.min(time), (micros(F.max(time)) - micros(F.min(time))) / F.lit(1e6)
        ).alias(out)
    )


def yield_anomaly(actual: Column, trend: Column, mean: Column, std: Column) -> dict[str, Column]:
    """Absolute, percent and baseline z-score anomalies; all null without a trend."""
    gap = actual - trend
    return {
        "yield_anomaly_abs": gap,
        "yield_anomaly_pct": F.try_divide(gap, trend) * 100.0,
        "yield_anomaly_zscore": F.when((std > 0) & gap.isNotNull(), (actual - mean) / std),
    }


def vegetation_health(ndvi, ndvi_min, ndvi_max, lst, lst_min, lst_max) -> Column:
    """Mean of vegetation and thermal condition, null for an empty range."""
    vci = (ndvi - ndvi_min) / F.when(ndvi_max > ndvi_min, ndvi_max - ndvi_min) * 100.0
    tci = (lst_max - lst) / F.when(lst_max > lst_min, lst_max - lst_min) * 100.0
    return F.round((vci + tci) / 2.0, 12)


def chd_intensity(hot_z: Column, dry_z: Column, hot: Column, dry: Column) -> Column:
    """Aggregate: sum of heat times depth of dryness over periods flagged hot and dry."""
    return F.coalesce(F.sum(F.when(hot & dry, hot_z * F.abs(dry_z))), F.lit(0.0))
