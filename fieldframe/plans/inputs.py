"""Logical panel inputs derived from the driver tables, in Spark and as SQL text.

Sums of prices are taken over whole cents, so both engines add integers and agree; the
divisors have no factor 2 or 5, so no result sits exactly on a rounding tie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldframe.operators.climate import ChdSettings

YEARS = (1995, 2001)
BASELINE = (1995, 1999)
EVENT_YEAR = 2000
MONTHS = (6, 7, 8, 9)
SETTINGS = ChdSettings(
    year_min=1995, year_max=2001, baseline=BASELINE, event_year=EVENT_YEAR, growth_months=MONTHS
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def R(expr: str, digits: int = 6) -> str:
    """SQL twin of ``numbers.rounded``."""
    return f"(CAST(round({expr}, {digits}) AS DOUBLE) + 0.0)"


def with_sql(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit-day climate: supplier nations as units, mean and sum of shipped quantity."""
    first, last = (F.lit(f"{y}-01-01").cast("timestamp_ntz") for y in (YEARS[0], YEARS[1] + 1))
    lines = (
        table(spark, sf_dir, "lineitem")
        .where((F.col("l_shipdate") >= first) & (F.col("l_shipdate") < last))  # reaches the scan
        .select("l_suppkey", "l_shipdate", "l_quantity")
    )
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    # The join comes first: a supplier ships about once a day, so combining before it would
    # add a shuffle and save nothing, while after it a task holds one row per unit and day.
    unit = F.col("s_nationkey").cast("string")
    return (
        lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(unit.alias("province"), F.to_date("l_shipdate").alias("date"))
        .agg(F.avg("l_quantity").alias("tmax_c"), F.sum("l_quantity").alias("precipitation_mm"))
        .select(
            "province", F.col("province").alias("province_code"), "date",
            F.year("date").alias("year"), F.month("date").alias("month"), "tmax_c", "precipitation_mm",
        )
    )


DAILY = """daily AS (
  SELECT CAST(s_nationkey AS VARCHAR) AS province, CAST(s_nationkey AS VARCHAR) AS province_code,
         CAST(l_shipdate AS DATE) AS date, CAST(year(l_shipdate) AS INTEGER) AS year,
         CAST(month(l_shipdate) AS INTEGER) AS month,
         avg(l_quantity) AS tmax_c, sum(l_quantity) AS precipitation_mm
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""

ROLLED = """rolled AS (
  SELECT *, CASE WHEN count(precipitation_mm) OVER w = 30 THEN sum(precipitation_mm) OVER w END
            AS rolling30_precip_mm
  FROM daily WHERE year BETWEEN 1995 AND 2001
  WINDOW w AS (PARTITION BY province ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))"""

THRESHOLDS = """thresholds AS (
  SELECT province, month, quantile_cont(tmax_c, 0.9) AS tmax_p90,
         quantile_cont(rolling30_precip_mm, 0.1) AS rolling30_precip_p10
  FROM rolled WHERE year BETWEEN 1995 AND 1999 GROUP BY province, month)"""

FLAGGED = """flagged AS (
  SELECT r.*, tmax_p90, rolling30_precip_p10,
         CAST(coalesce(tmax_c > tmax_p90, false) AS BIGINT) AS hot_day,
         CAST(coalesce(rolling30_precip_mm < rolling30_precip_p10, false) AS BIGINT) AS dry_condition,
         CAST(coalesce(tmax_c > tmax_p90 AND rolling30_precip_mm < rolling30_precip_p10, false) AS BIGINT)
           AS compound_hot_dry_day
  FROM rolled r LEFT JOIN thresholds t ON r.province = t.province AND r.month = t.month)"""

ANNUAL = """annual AS (
  SELECT province, province_code, year, avg(tmax_c) AS tmax_mean, coalesce(sum(precipitation_mm), 0) AS precip_sum,
         CAST(sum(hot_day) AS BIGINT) AS hot_days, CAST(sum(dry_condition) AS BIGINT) AS dry_days,
         CAST(sum(compound_hot_dry_day) AS BIGINT) AS compound_hot_dry_days
  FROM flagged WHERE month IN (6, 7, 8, 9) GROUP BY province, province_code, year)"""

BASED = """based AS (
  SELECT a.*, tmax_mean - b.t AS tmax_anomaly, precip_sum - b.p AS precip_anomaly,
         compound_hot_dry_days AS chd_annual
  FROM annual a LEFT JOIN (SELECT province, avg(tmax_mean) AS t, avg(precip_sum) AS p FROM annual
                           WHERE year BETWEEN 1995 AND 1999 GROUP BY province) b ON a.province = b.province)"""

EVENTS_CTE = """evented AS (
  SELECT b.*, CAST(year - 2000 AS BIGINT) AS event_time, CAST(year >= 2000 AS BIGINT) AS post,
         e.v AS chd_event_intensity
  FROM based b LEFT JOIN (SELECT province, avg(chd_annual) AS v FROM based WHERE year = 2000 GROUP BY province) e
    ON b.province = e.province)"""

TREATED = """treated AS (
  SELECT *, CASE WHEN (SELECT quantile_cont(chd_event_intensity, 0.75) FROM evented) IS NOT NULL
    THEN CAST(coalesce(chd_event_intensity >= (SELECT quantile_cont(chd_event_intensity, 0.75) FROM evented), false)
              AS BIGINT) END AS chd_event_treated_p75 FROM evented)"""

CHD_CHAIN = (DAILY, ROLLED, THRESHOLDS, FLAGGED, ANNUAL, BASED, EVENTS_CTE, TREATED)


def yields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit-year-crop statistics: customer nations, order years, market segments as crops."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_nationkey").cast("string").alias("province"), F.year("o_orderdate").alias("year"),
                 F.col("c_mktsegment").alias("crop"))
        .agg(F.sum(cents).alias("_cents"), F.count(F.lit(1)).alias("_n"))
        .select(
            "province", "year", "crop",
            (F.col("_cents") / F.lit(9999991.0)).alias("production_ton"),
            F.col("_n").cast("double").alias("area_hectare"),
            (F.col("_cents") / F.lit(9999.991) / F.col("_n")).alias("yield_kg_per_hectare"),
        )
    )


YIELDS = """yields AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS province, CAST(year(o_orderdate) AS INTEGER) AS year, c_mktsegment AS crop,
         sum(CAST(round(o_totalprice * 100) AS BIGINT)) / CAST(9999991.0 AS DOUBLE) AS production_ton,
         CAST(count(*) AS DOUBLE) AS area_hectare,
         sum(CAST(round(o_totalprice * 100) AS BIGINT)) / CAST(9999.991 AS DOUBLE) / count(*) AS yield_kg_per_hectare
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


def unit_yields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per unit and year (all crops together)."""
    return yields(spark, sf_dir).groupBy("province", "year").agg(
        F.sum("production_ton").alias("production_ton"), F.sum("area_hectare").alias("area_hectare")
    ).withColumn("yield_kg_per_hectare", F.col("production_ton") * 1000 / F.col("area_hectare"))


UNIT_YIELDS = """unit_yields AS (
  SELECT province, year, sum(production_ton) AS production_ton, sum(area_hectare) AS area_hectare,
         sum(production_ton) * 1000 / sum(area_hectare) AS yield_kg_per_hectare
  FROM yields GROUP BY province, year)"""


def events_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long variable panel: users as units, event types as variables, days as periods."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("admin_id"),
        F.dayofmonth("ts").alias("period"), F.year("ts").alias("year"), F.month("ts").alias("month"),
        F.col("event_type").alias("variable"), F.col("value"), F.col("event_id"), F.col("ts"),
    )


EVENTS_LONG = """long AS (
  SELECT CAST(user_id AS VARCHAR) AS admin_id, CAST(day(ts) AS INTEGER) AS period, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
         event_type AS variable, value, event_id, ts FROM events)"""


def climate_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual climate panel per supplier nation (first exposure source)."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity", "l_discount")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    per_supplier = lines.groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(
        F.sum("l_quantity").alias("q"), F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("d"),
        F.count(F.lit(1)).alias("n"),
    )
    return (
        per_supplier.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.col("s_nationkey").cast("string").alias("province"), "year")
        .agg((F.sum("q") / F.sum("n")).alias("tmax"), (F.sum("d") / F.sum("n")).alias("precipitation"))
    )


CLIMATE = """climate AS (
  SELECT CAST(s_nationkey AS VARCHAR) AS province, CAST(year(l_shipdate) AS INTEGER) AS year, avg(l_quantity) AS tmax,
         sum(CAST(round(l_discount * 100) AS BIGINT)) / CAST(count(*) AS DOUBLE) AS precipitation
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""


def remote_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual vegetation-like panel per customer nation, from all crops; ndvi is missing where one crop is."""
    return yields(spark, sf_dir).groupBy("province", "year").agg(
        F.sum(F.when(F.col("crop") == "BUILDING", F.col("area_hectare"))).alias("ndvi"), F.sum("area_hectare").alias("precipitation"))


REMOTE = """remote AS (
  SELECT province, year, sum(area_hectare) FILTER (crop = 'BUILDING') AS ndvi, sum(area_hectare) AS precipitation
  FROM yields GROUP BY province, year)"""


def customer_points(customers: DataFrame) -> DataFrame:
    """Cell centres spread over the study box from the customer key."""
    k = F.col("c_custkey")
    return customers.withColumn("lon", F.lit(105.0) + (k % 1800) / 100.0).withColumn(
        "lat", F.lit(24.0) + (k * 7 % 1100) / 100.0
    )
