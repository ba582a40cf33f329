"""Daily climate to annual compound heat-and-drought exposure.

The daily table has one row per unit and day (``validate_daily`` makes it so), hence a
window per unit is bounded by the calendar, however many raw rows a unit had.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldframe.operators.scalars import with_row
from fieldframe.functions.numbers import as_number, flag, is_true
from fieldframe.operators.picks import pick_one
from fieldframe.operators.quantiles import bounded_quantile, exact_quantile

DAILY_COLUMNS = ["province", "province_code", "date", "year", "month", "tmax_c", "precipitation_mm"]


@dataclass(frozen=True)
class ChdSettings:
    """Years, months and quantiles of an exposure run."""

    year_min: int = 2000
    year_max: int = 2024
    baseline: tuple[int, int] = (2000, 2021)
    event_year: int = 2022
    growth_months: tuple[int, ...] = (6, 7, 8, 9)
    heat_quantile: float = 0.90
    drought_quantile: float = 0.10
    rolling_days: int = 30
    extra: dict = field(default_factory=dict)


def validate_daily(raw: DataFrame) -> DataFrame:
    """Type the daily table, derive year and month from the date, one row per unit and day."""
    missing = [c for c in DAILY_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"daily climate table misses columns: {', '.join(missing)}")
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    typed = raw.select(
        text("province").alias("province"),
        text("province_code").alias("province_code"),
        F.col("date").try_cast("date").alias("date"),
        as_number("tmax_c").alias("tmax_c"),
        as_number("precipitation_mm").alias("precipitation_mm"),
    ).where((F.col("province") != "") & F.col("date").isNotNull())
    unique = pick_one(
        typed,
        ["province", "province_code", "date"],
        [F.col("tmax_c").asc_nulls_last(), F.col("precipitation_mm").asc_nulls_last()],
    )
    return unique.select(
        "province", "province_code", "date",
        F.year("date").alias("year"), F.month("date").alias("month"),
        "tmax_c", "precipitation_mm",
    )


def daily_warnings(raw: DataFrame, daily: DataFrame, year_min: int, year_max: int) -> DataFrame:
    """Warning rows ``(issue, detail)`` about units of measure, dates and missing years."""
    years = daily.agg(F.collect_set("year").alias("seen"))
    missing = years.select(
        F.array_sort(F.array_except(F.sequence(F.lit(year_min), F.lit(year_max)), "seen")).alias("years")
    ).where(F.size("years") > 0)
    facts = daily.agg(
        F.max("tmax_c").alias("hot"), F.min("tmax_c").alias("cold"), F.min("precipitation_mm").alias("driest"),
        F.max(F.when(F.col("precipitation_mm") > 0, F.col("precipitation_mm"))).alias("wettest"),
    )
    changed = raw.agg(
        F.count_if(~as_number("year").eqNullSafe(F.year(F.col("date").try_cast("date")).cast("double"))).alias("y"),
        F.count_if(~as_number("month").eqNullSafe(F.month(F.col("date").try_cast("date")).cast("double"))).alias("m"),
    )
    issue = lambda name, detail: [F.lit(name).alias("issue"), detail.alias("detail")]
    return (
        missing.select(*issue("missing_years", F.array_join(F.transform("years", lambda y: y.cast("string")), ",")))
        .union(facts.where("hot > 70 or cold < -90").select(*issue("tmax_not_celsius", F.col("hot").cast("string"))))
        .union(facts.where("driest < 0").select(*issue("negative_precipitation", F.col("driest").cast("string"))))
        .union(facts.where("wettest <= 1").select(*issue("precipitation_in_meters", F.col("wettest").cast("string"))))
        .union(changed.where("y > 0").select(*issue("year_from_date", F.col("y").cast("string"))))
        .union(changed.where("m > 0").select(*issue("month_from_date", F.col("m").cast("string"))))
    )


def expected_growth_days(year: Column, months: Sequence[int]) -> Column:
    """Calendar days of the growth months in a year."""
    days = [F.day(F.last_day(F.make_date(year, F.lit(m), F.lit(1)))) for m in months]
    return sum(days[1:], days[0])


def daily_qc(daily: DataFrame, year_min: int, year_max: int, months: Sequence[int]) -> DataFrame:
    """Completeness per unit and year; distinct days need no set because days are unique."""
    months = sorted(months)
    keys = ["province", "province_code", "year"]
    per_month = (
        daily.where(F.col("year").between(year_min, year_max))
        .groupBy(*keys, "month")
        .agg(
            F.count(F.lit(1)).alias("n"), F.count("tmax_c").alias("t"), F.count("precipitation_mm").alias("p")
        )
    )
    grown = F.col("month").isin(*months)
    grouped = per_month.groupBy(*keys).agg(
        F.sum("n").alias("date_count"),
        F.coalesce(F.sum(F.when(grown, F.col("n"))), F.lit(0)).alias("growth_month_date_count"),
        F.collect_set(F.when(grown, F.col("month"))).alias("_seen"),
        F.sum("t").alias("_t"),
        F.sum("p").alias("_p"),
    )
    lacking = F.array_except(F.array(*[F.lit(m) for m in months]), "_seen")
    text = F.array_join(F.transform(lacking, lambda m: m.cast("string")), ",")
    out = grouped.withColumn(
        "expected_growth_days", expected_growth_days(F.col("year"), months).cast("bigint")
    ).withColumn("missing_growth_months", text)
    short = F.col("growth_month_date_count") < F.col("expected_growth_days")
    absent = F.col("missing_growth_months") != ""
    issues = F.concat_ws(
        "; ",
        F.when(absent, F.concat(F.lit("missing growth months "), F.col("missing_growth_months"))),
        F.when(short, F.lit("incomplete growth-season daily coverage")),
        F.when(F.col("_t") < F.col("date_count"), F.lit("missing tmax_c")),
        F.when(F.col("_p") < F.col("date_count"), F.lit("missing precipitation_mm")),
    )
    return out.select(
        *keys, "date_count", "growth_month_date_count", "expected_growth_days", "missing_growth_months",
        (~absent & ~short).alias("growth_season_complete"),
        (F.col("_t") / F.col("date_count")).alias("tmax_c_nonmissing_rate"),
        (F.col("_p") / F.col("date_count")).alias("precipitation_mm_nonmissing_rate"),
        issues.alias("issue"),
    )


def rolling_sum(daily: DataFrame, value: str, out: str, unit: str = "province", order: str = "date",
                rows: int = 30) -> DataFrame:
    """Sum over the last ``rows`` rows of a unit, null until that many non-null values exist."""
    window = Window.partitionBy(unit).orderBy(order).rowsBetween(1 - rows, 0)
    return daily.withColumn(out, F.when(F.count(value).over(window) == rows, F.sum(value).over(window)))


def monthly_threshold(daily: DataFrame, value: str, q: float, baseline: tuple[int, int], out: str,
                      unit: str = "province") -> DataFrame:
    """Baseline quantile per unit and calendar month as a table."""
    rows = daily.where(F.col("year").between(*baseline))
    return rows.groupBy(unit, "month").agg(bounded_quantile(F.col(value), q).alias(out))


def with_monthly_threshold(daily: DataFrame, value: str, q: float, baseline: tuple[int, int], out: str,
                           unit: str = "province") -> DataFrame:
    """The same threshold on every row; reuses the partitioning of the unit, so no join or shuffle."""
    kept = F.when(F.col("year").between(*baseline), F.col(value))
    return daily.withColumn(out, bounded_quantile(kept, q).over(Window.partitionBy(unit, "month")))


def compound_flags(daily: DataFrame) -> DataFrame:
    """Hot, dry and compound day flags; a missing side is false."""
    hot = is_true(F.col("tmax_c") > F.col("tmax_p90"))
    dry = is_true(F.col("rolling30_precip_mm") < F.col("rolling30_precip_p10"))
    return daily.withColumns({
        "hot_day": hot.cast("bigint"),
        "dry_condition": dry.cast("bigint"),
        "compound_hot_dry_day": (hot & dry).cast("bigint"),
    })


def flag_days(daily: DataFrame, settings: ChdSettings) -> DataFrame:
    """Year filter, rolling sum, thresholds and flags; the month filter must come later."""
    s = settings
    work = daily.where(F.col("year").between(s.year_min, s.year_max))
    work = rolling_sum(work, "precipitation_mm", "rolling30_precip_mm", rows=s.rolling_days)
    work = with_monthly_threshold(work, "tmax_c", s.heat_quantile, s.baseline, "tmax_p90")
    work = with_monthly_threshold(
        work, "rolling30_precip_mm", s.drought_quantile, s.baseline, "rolling30_precip_p10"
    )
    return compound_flags(work)


def annual_from_days(flagged: DataFrame, months: Sequence[int]) -> DataFrame:
    """Growth-season totals per unit and year."""
    return (
        flagged.where(F.col("month").isin(*months))
        .groupBy("province", "province_code", "year")
        .agg(
            F.avg("tmax_c").alias("tmax_mean"),
            F.coalesce(F.sum("precipitation_mm"), F.lit(0.0)).alias("precip_sum"),
            F.sum("hot_day").alias("hot_days"),
            F.sum("dry_condition").alias("dry_days"),
            F.sum("compound_hot_dry_day").alias("compound_hot_dry_days"),
        )
    )


def baseline_anomaly(annual: DataFrame, baseline: tuple[int, int]) -> DataFrame:
    """Distance of each year from the unit's baseline mean; units hold one row per year."""
    unit = Window.partitionBy("province")
    kept = lambda c: F.avg(F.when(F.col("year").between(*baseline), F.col(c))).over(unit)
    return (
        annual.withColumn("baseline_tmax_mean", kept("tmax_mean"))
        .withColumn("baseline_precip_sum", kept("precip_sum"))
        .withColumn("tmax_anomaly", F.col("tmax_mean") - F.col("baseline_tmax_mean"))
        .withColumn("precip_anomaly", F.col("precip_sum") - F.col("baseline_precip_sum"))
    )


def event_fields(panel: DataFrame, event_year: int) -> DataFrame:
    """Years since the event and the 0/1 post flag (a missing year counts as before)."""
    return panel.withColumn("event_time", (F.col("year") - F.lit(event_year)).cast("bigint")).withColumn(
        "post", flag(F.col("year") >= event_year)
    )


def event_intensity(panel: DataFrame, unit: str, value: str, event_year: int, out: str) -> DataFrame:
    """Mean event-year value of a unit, repeated on all its rows.

    Aggregated per unit first, then joined, so a unit with very many rows is combined
    before the shuffle and its probe side may be split by adaptive execution.
    """
    events = (
        panel.where((F.col("year") == event_year) & F.col(value).isNotNull() & F.col(unit).isNotNull())
        .groupBy(unit)
        .agg(F.avg(value).alias(out))
    )
    return panel.join(events, unit, "left")


def treated_by_rows(panel: DataFrame, intensity: str, out: str, q: float = 0.75, day_counts: bool = False) -> DataFrame:
    """Treated when the repeated intensity reaches its quantile over all *rows*.

    Intensities that count days of one season have few distinct values whatever the number
    of rows, so one aggregate over value counts is enough for them.
    """
    if day_counts:
        cut = panel.agg(bounded_quantile(F.col(intensity), q).alias("_cut"))
    else:
        cut = exact_quantile(panel, [], intensity, q, "_cut")
    value = F.when(F.col("_cut").isNotNull(), flag(F.col(intensity) >= F.col("_cut")))
    return with_row(panel, cut).withColumn(out, value).drop("_cut")


def chd_panel(daily: DataFrame, settings: ChdSettings) -> DataFrame:
    """Daily table to the annual panel, before the event fields."""
    annual = annual_from_days(flag_days(daily, settings), settings.growth_months)
    return baseline_anomaly(annual, settings.baseline).withColumn("chd_annual", F.col("compound_hot_dry_days"))


def add_event_columns(panel: DataFrame, event_year: int, unit: str = "province", day_counts: bool = False) -> DataFrame:
    """Event time, post flag, repeated intensity and the row-quantile treatment."""
    out = event_intensity(event_fields(panel, event_year), unit, "chd_annual", event_year, "chd_event_intensity")
    return treated_by_rows(out, "chd_event_intensity", "chd_event_treated_p75", day_counts=day_counts)
