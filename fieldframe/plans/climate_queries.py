"""Daily climate queries: thresholds, flags, annual exposure, event fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldframe.functions.numbers import rounded
from fieldframe.operators import climate as C
from fieldframe.operators import spans
from fieldframe.operators.joins import join_thresholds
from fieldframe.plans import inputs as I
from fieldframe.plans.inputs import R, with_sql
from fieldframe.plans.registry import query
from fieldframe.session import materialize

PANEL_COLUMNS = [
    "province", "province_code", "year", "tmax_mean", "precip_sum", "hot_days", "dry_days",
    "compound_hot_dry_days", "tmax_anomaly", "precip_anomaly", "chd_annual", "event_time", "post",
    "chd_event_intensity", "chd_event_treated_p75",
]
FLOATS = {"tmax_mean", "precip_sum", "tmax_anomaly", "precip_anomaly", "chd_event_intensity"}


def _show(columns, floats):
    return [rounded(c).alias(c) if c in floats else F.col(c) for c in columns]


def _show_sql(columns, floats):
    return ", ".join(f"{R(c)} AS {c}" if c in floats else c for c in columns)


def annual_panel(spark, d, daily=None):
    """The annual panel, written once: the event fields below read it several times."""
    return materialize(C.chd_panel(daily if daily is not None else I.daily(spark, d), I.SETTINGS), "annual-chd")


@query("daily_chd_panel", with_sql(*I.CHD_CHAIN) + f"SELECT {_show_sql(PANEL_COLUMNS, FLOATS)} FROM treated")
def daily_chd_panel(spark, d):
    """Flagship: daily table to annual compound exposure with event treatment."""
    panel = C.add_event_columns(annual_panel(spark, d), I.EVENT_YEAR, day_counts=True)
    return panel.select(*_show(PANEL_COLUMNS, FLOATS))


@query("rolling_sum", with_sql(I.DAILY, I.ROLLED) + """
SELECT province, CAST(date AS VARCHAR) AS date, rolling30_precip_mm FROM rolled""")
def rolling_sum(spark, d):
    work = I.daily(spark, d).where(F.col("year").between(*I.YEARS))
    out = C.rolling_sum(work, "precipitation_mm", "rolling30_precip_mm")
    return out.select("province", F.col("date").cast("string").alias("date"), "rolling30_precip_mm")


@query("monthly_threshold", with_sql(I.DAILY, I.ROLLED, I.THRESHOLDS) + f"""
SELECT province, month, {R('tmax_p90')} AS tmax_p90 FROM thresholds""")
def monthly_threshold(spark, d):
    out = C.monthly_threshold(I.daily(spark, d), "tmax_c", 0.9, I.BASELINE, "tmax_p90")
    return out.select("province", "month", rounded("tmax_p90").alias("tmax_p90"))


@query("threshold_join", with_sql(I.DAILY) + f"""
SELECT d.province, CAST(d.date AS VARCHAR) AS date, {R('coalesce(t.q, g.q)')} AS threshold
FROM daily d
LEFT JOIN (SELECT province, month, quantile_cont(tmax_c, 0.9) AS q FROM daily
           WHERE year BETWEEN 1995 AND 1996 AND month < 12 GROUP BY province, month) t
  ON d.province = t.province AND d.month = t.month
CROSS JOIN (SELECT quantile_cont(tmax_c, 0.9) AS q FROM daily WHERE year BETWEEN 1995 AND 1996) g""")
def threshold_join(spark, d):
    """Group thresholds back on the rows; December has none and takes the global one."""
    daily = I.daily(spark, d)
    base = daily.where(F.col("year").between(1995, 1996))
    groups = C.monthly_threshold(base.where("month < 12"), "tmax_c", 0.9, (1995, 1996), "threshold")
    out = join_thresholds(daily, base, groups, ["province", "month"], "tmax_c", 0.9, "threshold")
    return out.select("province", F.col("date").cast("string").alias("date"), rounded("threshold").alias("threshold"))


@query("compound_day_flags", with_sql(I.DAILY, I.ROLLED, I.THRESHOLDS, I.FLAGGED) + """
SELECT province, CAST(date AS VARCHAR) AS date, hot_day, dry_condition, compound_hot_dry_day FROM flagged""")
def compound_day_flags(spark, d):
    out = C.flag_days(I.daily(spark, d), I.SETTINGS)
    return out.select("province", F.col("date").cast("string").alias("date"),
                      "hot_day", "dry_condition", "compound_hot_dry_day")


@query("daily_to_annual_chd", with_sql(I.DAILY, I.ROLLED, I.THRESHOLDS, I.FLAGGED, I.ANNUAL) + f"""
SELECT province, province_code, year, {R('tmax_mean')} AS tmax_mean, precip_sum, hot_days, dry_days,
       compound_hot_dry_days FROM annual""")
def daily_to_annual_chd(spark, d):
    annual = C.annual_from_days(C.flag_days(I.daily(spark, d), I.SETTINGS), I.MONTHS)
    return annual.withColumn("tmax_mean", rounded("tmax_mean"))


@query("baseline_anomaly", with_sql(I.DAILY, I.ROLLED, I.THRESHOLDS, I.FLAGGED, I.ANNUAL, I.BASED) + f"""
SELECT province, year, {R('tmax_anomaly')} AS tmax_anomaly, {R('precip_anomaly')} AS precip_anomaly FROM based""")
def baseline_anomaly(spark, d):
    out = C.chd_panel(I.daily(spark, d), I.SETTINGS)
    return out.select("province", "year", rounded("tmax_anomaly").alias("tmax_anomaly"),
                      rounded("precip_anomaly").alias("precip_anomaly"))


@query("event_fields", with_sql(*I.CHD_CHAIN) + "SELECT province, year, event_time, post FROM treated")
def event_fields(spark, d):
    out = C.event_fields(C.chd_panel(I.daily(spark, d), I.SETTINGS), I.EVENT_YEAR)
    return out.select("province", "year", "event_time", "post")


@query("event_intensity", with_sql(*I.CHD_CHAIN) + f"""
SELECT province, year, {R('chd_event_intensity')} AS chd_event_intensity FROM treated""")
def event_intensity(spark, d):
    out = C.event_intensity(annual_panel(spark, d), "province", "chd_annual", I.EVENT_YEAR, "chd_event_intensity")
    return out.select("province", "year", rounded("chd_event_intensity").alias("chd_event_intensity"))


@query("treated_p75", with_sql(I.YIELDS, """rep AS (
  SELECT y.province, y.year, y.crop, round(e.v, 6) AS intensity FROM yields y LEFT JOIN
    (SELECT province, avg(yield_kg_per_hectare) AS v FROM yields WHERE year = 2000 GROUP BY province) e
  ON y.province = e.province)""") + """
SELECT province, year, crop,
  CAST(coalesce(intensity >= (SELECT quantile_cont(intensity, 0.75) FROM rep), false) AS BIGINT) AS treated
FROM rep""")
def treated_p75(spark, d):
    panel = C.event_intensity(I.yields(spark, d), "province", "yield_kg_per_hectare", I.EVENT_YEAR, "intensity")
    panel = materialize(panel.withColumn("intensity", F.round("intensity", 6)), "intensity")
    return C.treated_by_rows(panel, "intensity", "treated").select("province", "year", "crop", "treated")


@query("daily_qc", with_sql(I.DAILY, """seasons AS (
  SELECT DISTINCT year, day(last_day(make_date(year, 6, 1))) + day(last_day(make_date(year, 7, 1)))
       + day(last_day(make_date(year, 8, 1))) + day(last_day(make_date(year, 9, 1))) AS expected FROM daily)""",
    """q AS (SELECT province, province_code, d.year, count(DISTINCT date) AS date_count,
         count(DISTINCT date) FILTER (month IN (6,7,8,9)) AS growth_month_date_count,
         CAST(any_value(expected) AS BIGINT) AS expected_growth_days,
         concat_ws(',', CASE WHEN count(*) FILTER (month = 6) = 0 THEN '6' END,
                        CASE WHEN count(*) FILTER (month = 7) = 0 THEN '7' END,
                        CASE WHEN count(*) FILTER (month = 8) = 0 THEN '8' END,
                        CASE WHEN count(*) FILTER (month = 9) = 0 THEN '9' END) AS missing_growth_months,
         count(tmax_c) / count(*) AS tmax_c_nonmissing_rate,
         count(precipitation_mm) / count(*) AS precipitation_mm_nonmissing_rate
  FROM daily d JOIN seasons s ON d.year = s.year GROUP BY province, province_code, d.year)""") + f"""
SELECT province, province_code, year, date_count, growth_month_date_count, expected_growth_days,
  missing_growth_months,
  missing_growth_months = '' AND growth_month_date_count >= expected_growth_days AS growth_season_complete,
  {R('tmax_c_nonmissing_rate')} AS tmax_c_nonmissing_rate,
  {R('precipitation_mm_nonmissing_rate')} AS precipitation_mm_nonmissing_rate,
  concat_ws('; ', CASE WHEN missing_growth_months <> '' THEN 'missing growth months ' || missing_growth_months END,
    CASE WHEN growth_month_date_count < expected_growth_days THEN 'incomplete growth-season daily coverage' END) AS issue
FROM q""")
def daily_qc(spark, d):
    daily = C.validate_daily(I.daily(spark, d))
    out = C.daily_qc(daily, *I.YEARS, I.MONTHS)
    rate = "tmax_c_nonmissing_rate", "precipitation_mm_nonmissing_rate"
    return out.withColumns({c: rounded(c) for c in rate})


@query("growth_month_filter", with_sql(I.DAILY) + """
SELECT province, CAST(date AS VARCHAR) AS date, precipitation_mm FROM daily WHERE month IN (6, 7, 8, 9)""")
def growth_month_filter(spark, d):
    out = I.daily(spark, d).where(F.col("month").isin(*I.MONTHS))
    return out.select("province", F.col("date").cast("string").alias("date"), "precipitation_mm")


CUSTOMER_YEARS = """cy AS (
  SELECT DISTINCT o_custkey AS unit, year(o_orderdate) AS year FROM orders)"""


def _customer_years(spark, d):
    return I.table(spark, d, "orders").select(
        F.col("o_custkey").alias("unit"), F.year("o_orderdate").alias("year")).distinct()


@query("year_spans", with_sql(CUSTOMER_YEARS, """islands AS (
  SELECT unit, min(year) AS a, max(year) AS b FROM (
    SELECT unit, year, year - row_number() OVER (PARTITION BY unit ORDER BY year) AS g FROM cy) GROUP BY unit, g)""")
    + """SELECT unit, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR)
                           ELSE CAST(a AS VARCHAR) || '-' || CAST(b AS VARCHAR) END, ', ' ORDER BY a) AS spans
FROM islands GROUP BY unit""")
def year_spans(spark, d):
    return spans.year_spans(_customer_years(spark, d), "unit", "year", "spans")


@query("missing_years", with_sql(CUSTOMER_YEARS) + """
SELECT unit, string_agg(CAST(y AS VARCHAR), ',' ORDER BY y) AS missing FROM (
  SELECT u.unit, y FROM (SELECT DISTINCT unit FROM cy) u CROSS JOIN range(1995, 2002) t(y)
  WHERE NOT EXISTS (SELECT 1 FROM cy WHERE cy.unit = u.unit AND cy.year = y)) GROUP BY unit""")
def missing_years(spark, d):
    return spans.missing_years(_customer_years(spark, d), "unit", "year", *I.YEARS, "missing")


@query("year_range_filter", """
SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS year FROM orders
WHERE year(o_orderdate) BETWEEN 1997 AND 1999""")
def year_range_filter(spark, d):
    orders = I.table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").cast("bigint").alias("year"))
    return spans.year_range(orders, "year", 1997, 1999)
