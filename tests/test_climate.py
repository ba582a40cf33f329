"""Known answers of the daily climate chain."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldframe.operators import climate as C


def daily_rows(year_from=2000, year_to=2022, event=2022):
    rows, day = [], dt.date(year_from, 5, 1)
    while day <= dt.date(year_to, 9, 30):
        if 5 <= day.month <= 9:
            hot = day.year == event and day.month >= 6
            dry = day.year == event
            rows.append(("江苏", "32", day.isoformat(), day.year, day.month, 36.0 if hot else 30.0, 0.0 if dry else 10.0))
        day += dt.timedelta(days=1)
    return rows


SCHEMA = "province string, province_code string, date string, year int, month int, tmax_c double, precipitation_mm double"


def test_event_year_is_hot_and_dry(spark):
    raw = spark.createDataFrame(daily_rows(), SCHEMA)
    settings = C.ChdSettings(year_min=2000, year_max=2022)
    panel = C.add_event_columns(C.chd_panel(C.validate_daily(raw), settings), 2022)
    rows = {r["year"]: r for r in panel.collect()}
    assert len(rows) == 23
    event = rows[2022]
    assert event["hot_days"] == 122 and event["dry_days"] > 80
    assert event["chd_annual"] == event["compound_hot_dry_days"] == event["chd_event_intensity"]
    assert event["post"] == 1 and rows[2021]["post"] == 0 and event["event_time"] == 0
    assert rows[2021]["chd_annual"] == 0


def test_validation_types_deduplicates_and_warns(spark):
    raw = spark.createDataFrame([
        ("A", "1", "2000-06-01", 1999, 6, 303.0, 1.0), ("A", "1", "2000-06-01", 2000, 6, 303.0, 1.0),
        ("A", "1", "2000-07-01", 2000, 6, float("nan"), -1.0), ("", "1", "2000-06-02", 2000, 6, 1.0, 1.0), ("A", "1", "x", 2000, 6, 1.0, 1.0),
    ], SCHEMA)
    daily = C.validate_daily(raw)
    assert sorted((str(r["date"]), r["month"], r["tmax_c"]) for r in daily.collect()) == [("2000-06-01", 6, 303.0), ("2000-07-01", 7, None)]
    issues = {r["issue"]: r["detail"] for r in C.daily_warnings(raw, daily, 2000, 2002).collect()}
    assert issues["missing_years"] == "2001,2002"
    assert {"tmax_not_celsius", "negative_precipitation", "year_from_date", "month_from_date"} <= set(issues)
    qc = C.daily_qc(daily, 2000, 2002, [6, 7, 8, 9]).first()
    assert qc["expected_growth_days"] == 122 and not qc["growth_season_complete"]
    assert qc["missing_growth_months"] == "8,9" and "missing tmax_c" in qc["issue"]
    with pytest.raises(ValueError):
        C.validate_daily(raw.drop("tmax_c"))


def test_rolling_sum_needs_full_window_of_values(spark):
    rows = [("A", i, None if i == 3 else 1.0) for i in range(8)]
    df = spark.createDataFrame(rows, "province string, date int, v double")
    out = [r["s"] for r in C.rolling_sum(df, "v", "s", rows=3).orderBy("date").collect()]
    assert out == [None, None, 3.0, None, None, None, 3.0, 3.0]


def test_month_filter_stays_above_the_rolling_window(spark):
    raw = C.validate_daily(spark.createDataFrame(daily_rows(2000, 2003, 2003), SCHEMA))
    annual = C.annual_from_days(C.flag_days(raw, C.ChdSettings(year_min=2000, year_max=2003, baseline=(2000, 2002))), [6, 7, 8, 9])
    lines = annual._jdf.queryExecution().optimizedPlan().toString().splitlines()
    rolling = next(i for i, l in enumerate(lines) if "RowFrame, -29" in l)
    months = next(i for i, l in enumerate(lines) if "Filter" in l and "IN (6,7,8,9)" in l)
    assert months < rolling  # nearer the root: evaluated later


def test_treatment_by_rows_and_missing_intensity(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", 1.0), ("B", 5.0), ("C", None)], "u string, x double")
    got = {(r["u"], r["t"]) for r in C.treated_by_rows(df, "x", "t").collect()}
    assert got == {("A", 0), ("B", 1), ("C", 0)}
    empty = C.treated_by_rows(df.where("x > 100").withColumn("x", F.col("x")), "x", "t")
    assert empty.count() == 0


def test_day_count_treatment_equals_the_general_one(spark):
    df = spark.createDataFrame([(f"u{i}", float(i * i % 13)) for i in range(40)] + [("none", None)], "u string, x double")
    both = C.treated_by_rows(C.treated_by_rows(df, "x", "a"), "x", "b", day_counts=True)
    assert both.where("a <> b").count() == 0 and both.where("a = 1").count() > 0
