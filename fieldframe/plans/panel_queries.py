"""Joins, reshaping, trends, indices and the panel compositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldframe.functions import names as N
from fieldframe.functions.numbers import rounded
from fieldframe.operators import climate as C
from fieldframe.operators import indices as X
from fieldframe.operators import joins as J
from fieldframe.operators import panel as P
from fieldframe.operators.records import yield_anomaly
from fieldframe.plans import inputs as I
from fieldframe.plans.climate_queries import annual_panel
from fieldframe.plans.inputs import R, with_sql
from fieldframe.plans.registry import query
from fieldframe.session import materialize


def show(df, keys, floats, digits=6):
    return df.select(*keys, *[rounded(c, digits).alias(c) for c in floats])


def show_sql(floats, digits=6, alias=""):
    return ", ".join(f"{R(alias + c, digits)} AS {c}" for c in floats)


# --- joins ----------------------------------------------------------------------------------

@query("prefixed_left_join", with_sql(I.YIELDS, I.CLIMATE, """last AS (
  SELECT province, year, sum_qty, l_suppkey FROM (
    SELECT *, row_number() OVER (PARTITION BY province, year ORDER BY l_suppkey DESC) AS r FROM (
      SELECT CAST(s_nationkey AS VARCHAR) AS province, CAST(year(l_shipdate) AS INTEGER) AS year, l_suppkey, sum(l_quantity) AS sum_qty
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)) WHERE r = 1)""") + f"""
SELECT y.province, y.year, crop, {R('yield_kg_per_hectare')} AS yield_kg_per_hectare, l_suppkey AS climate_l_suppkey, sum_qty AS climate_sum_qty
FROM yields y LEFT JOIN last l ON y.province = l.province AND y.year = l.year""")
def prefixed_left_join(spark, d):
    lines = I.table(spark, d, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity")
    suppliers = I.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("string").alias("province"))
    right = lines.groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(F.sum("l_quantity").alias("sum_qty")).join(suppliers, "l_suppkey")
    out = J.prefixed_left_join(I.yields(spark, d), right, ["admin_id", "province", "year"], "climate", [F.col("l_suppkey").desc()])
    return out.select("province", "year", "crop", rounded("yield_kg_per_hectare").alias("yield_kg_per_hectare"),
                      "climate_l_suppkey", "climate_sum_qty")


MERGED = """merged AS (
  SELECT coalesce(c.province, r.province) AS province, coalesce(c.year, r.year) AS year, c.tmax, c.precipitation, r.ndvi,
         r.precipitation AS precipitation_remote
  FROM climate c FULL OUTER JOIN remote r ON c.province = r.province AND c.year = r.year)"""


def merged_sources(spark, d):
    return J.outer_source_merge([I.climate_source(spark, d), I.remote_source(spark, d)])


@query("outer_source_merge", with_sql(I.YIELDS, I.CLIMATE, I.REMOTE, MERGED) + f"""
SELECT province, year, {show_sql(('tmax', 'precipitation', 'ndvi', 'precipitation_remote'))} FROM merged""")
def outer_source_merge(spark, d):
    return show(merged_sources(spark, d), ["province", "year"], ["tmax", "precipitation", "ndvi", "precipitation_remote"])


@query("coalescing_left_join", with_sql(I.YIELDS, I.UNIT_YIELDS, I.CLIMATE) + f"""
SELECT u.province, u.year, {R("coalesce(CASE WHEN u.year % 3 > 0 THEN area_hectare END, c.tmax)")} AS chd_annual, {R('c.precipitation')} AS precipitation
FROM unit_yields u LEFT JOIN climate c ON u.province = c.province AND u.year = c.year""")
def coalescing_left_join(spark, d):
    text = F.when(F.col("year") % 3 == 1, F.col("area_hectare").cast("string")).when(
        F.col("year") % 3 == 2, F.col("area_hectare").cast("string")).otherwise(" ")
    model = I.unit_yields(spark, d).select("province", "year", text.alias("chd_annual"))
    annual = I.climate_source(spark, d).withColumnRenamed("tmax", "chd_annual").withColumn("province", F.concat("province", F.lit("省")))
    out = J.coalescing_left_join(model, annual, ["admin_id", "admin_code", "province"], ["chd_annual", "precipitation"], [F.col("chd_annual")])
    return show(out, ["province", "year"], ["chd_annual", "precipitation"])


@query("code_or_name_join", with_sql(I.YIELDS, I.UNIT_YIELDS, I.CLIMATE) + f"""
SELECT u.province, u.year, {R('yield_kg_per_hectare')} AS yield_kg_per_hectare, {R('tmax')} AS tmax
FROM unit_yields u LEFT JOIN climate c ON u.province = c.province AND u.year = c.year""")
def code_or_name_join(spark, d):
    panel = I.unit_yields(spark, d).withColumn("province_code", F.concat("province", F.lit(".0")))
    other = I.climate_source(spark, d).select(
        F.concat("province", F.lit("市")).alias("name"), F.col("province").alias("province_code"), "year", "tmax")
    out = J.code_or_name_join(panel, other.withColumnRenamed("name", "province"), "province_code", "province",
                              N.normalize_admin_code, N.normalize_province_name, [F.col("tmax")])
    return show(out, ["province", "year"], ["yield_kg_per_hectare", "tmax"])


@query("align_names", """
WITH l AS (SELECT n_nationkey, n_name || CASE WHEN n_nationkey % 2 = 0 THEN '省' ELSE '' END AS name FROM nation),
r AS (SELECT c_custkey, 'NATION_' || (c_custkey % 30) || '市' AS name FROM customer)
SELECT c_custkey, coalesce(l.name, r.name) AS province FROM r LEFT JOIN l ON 'NATION_' || (c_custkey % 30) = 'NATION_' || n_nationkey""")
def align_names(spark, d):
    left = I.table(spark, d, "nation").select(
        "n_nationkey", F.concat("n_name", F.when(F.col("n_nationkey") % 2 == 0, "省").otherwise("")).alias("province"))
    right = I.table(spark, d, "customer").select(
        "c_custkey", F.concat(F.lit("NATION_"), (F.col("c_custkey") % 30).cast("string"), F.lit("市")).alias("province"))
    return J.align_names(left, right, "province", N.normalize_province_name, [F.col("n_nationkey")]).select("c_custkey", "province")


@query("broadcast_to_units", with_sql(I.YIELDS, """regional AS (
  SELECT year, crop AS variable, avg(yield_kg_per_hectare) AS v FROM yields GROUP BY year, crop)""") + f"""
SELECT n_name AS admin_id, year, variable, {R('v')} AS value FROM nation CROSS JOIN regional""")
def broadcast_to_units(spark, d):
    regional = I.yields(spark, d).groupBy("year", F.col("crop").alias("variable")).agg(F.avg("yield_kg_per_hectare").alias("value"))
    units = I.table(spark, d, "nation").select(F.col("n_name").alias("admin_id"))
    return show(J.broadcast_to_units(regional, units), ["admin_id", "year", "variable"], ["value"])


@query("coverage_gap", """
SELECT u.admin_id, y.year, CAST(coalesce(n, 0) AS BIGINT) AS proxy_observation_count,
  CASE WHEN coalesce(n, 0) > 0 THEN 'available' ELSE 'missing' END AS status
FROM (SELECT c_custkey AS admin_id FROM customer) u CROSS JOIN (SELECT CAST(y AS INTEGER) AS year FROM range(1995, 2002) t(y)) y
LEFT JOIN (SELECT o_custkey, year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY ALL) p
  ON p.o_custkey = u.admin_id AND p.year = y.year""")
def coverage_gap(spark, d):
    units = I.table(spark, d, "customer").select(F.col("c_custkey").alias("admin_id"))
    panel = I.table(spark, d, "orders").select(F.col("o_custkey").alias("admin_id"), F.year("o_orderdate").alias("year"))
    return J.coverage_grid(units, *I.YEARS, panel, "admin_id")


@query("swap_variant", with_sql(I.YIELDS, I.UNIT_YIELDS, I.CLIMATE) + f"""
SELECT u.province, u.year, {R('area_hectare')} AS area_hectare, {R('c.tmax')} AS chd_annual, {R('c.precipitation')} AS precip_anomaly
FROM unit_yields u LEFT JOIN climate c ON u.province = c.province AND u.year = c.year""")
def swap_variant(spark, d):
    panel = I.unit_yields(spark, d).withColumns({"chd_annual": F.lit(0.0), "precip_anomaly": F.lit(0.0)})
    annual = I.climate_source(spark, d).withColumnsRenamed({"tmax": "chd_annual", "precipitation": "precip_anomaly"})
    out = J.swap_variant(panel, annual, ["province", "year"], ["chd_annual", "precip_anomaly"])
    return show(out, ["province", "year"], ["area_hectare", "chd_annual", "precip_anomaly"])


@query("attach_area", """
SELECT o_orderkey, CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey AS DOUBLE) END AS rice_area_proxy
FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def attach_area(spark, d):
    panel = I.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("admin_id"))
    areas = I.table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("admin_id"),
        F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey").cast("double")).alias("crop_area_ha"))
    return J.attach_area(panel, areas, "admin_id", "crop_area_ha", "rice_area_proxy").select("o_orderkey", "rice_area_proxy")


@query("unmatched_units", """
SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = 2000)""")
def unmatched_units(spark, d):
    seen = I.table(spark, d, "orders").where(F.year("o_orderdate") == 2000).select(F.col("o_custkey").alias("c_custkey"))
    return I.table(spark, d, "customer").select("c_custkey", "c_name").join(seen, "c_custkey", "left_anti")


# --- aggregation and reshaping --------------------------------------------------------------

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


@query("pivot_variables", with_sql(I.EVENTS_LONG) + f"""
SELECT admin_id, period, {', '.join(R(f"avg(value) FILTER (variable = '{v}')") + f' AS "{v}"' for v in EVENT_TYPES)}
FROM long GROUP BY admin_id, period""")
def pivot_variables(spark, d):
    return show(P.pivot_variables(I.events_long(spark, d), ["admin_id", "period"], list(EVENT_TYPES)), ["admin_id", "period"], sorted(EVENT_TYPES))


@query("weighted_zone_mean", f"""
WITH z AS (SELECT CAST(c_nationkey AS VARCHAR) AS province, CAST(year(o_orderdate) AS INTEGER) AS year, o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) / 10000000.0 AS v,
  CASE WHEN c_nationkey % 4 = 0 THEN -1.0 ELSE CAST(round(c_acctbal * 100) AS BIGINT) / 100000.0 END AS w FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT province, year, count(*) AS source_rows, {R('coalesce(sum(v * w) FILTER (w > 0) / nullif(sum(w) FILTER (w > 0), 0), avg(v))')} AS chd_annual,
  CAST(min(o_custkey) AS VARCHAR) AS province_code, 'rice_area_ha' AS aggregation_weight FROM z GROUP BY province, year""")
def weighted_zone_mean(spark, d):
    customers = I.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_acctbal")
    cents = F.round(F.col("c_acctbal") * 100).cast("bigint") / F.lit(100000.0)
    rows = I.table(spark, d, "orders").join(customers, "o_custkey").select(
        F.col("c_nationkey").cast("string").alias("province"), F.year("o_orderdate").alias("year"),
        (F.round(F.col("o_totalprice") * 100).cast("bigint") / F.lit(10000000.0)).alias("chd_annual"),
        F.when(F.col("c_nationkey") % 4 == 0, -1.0).otherwise(cents).alias("rice_area_ha"),
        F.col("o_custkey").cast("string").alias("admin_code"), "o_custkey")
    out = P.weighted_zone_mean(rows, ["province", "year"], ["chd_annual"], ["rice_area", "rice_area_ha"],
                               ["admin_code"], "o_custkey")
    return out.withColumn("chd_annual", rounded("chd_annual"))


COLLAPSE_KEYS = ["admin_id", "year", "month", "variable", "source_panel"]


@query("collapse_panel", f"""
WITH t AS (SELECT CASE WHEN user_id % 50 = 0 THEN NULL ELSE CAST(user_id % 20 AS VARCHAR) END AS admin_id, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
  event_type AS variable, 'events' AS source_panel, value, value + 1 AS hi FROM events)
SELECT admin_id, year, month, variable, source_panel, {R('avg(value)')} AS mean, {R('median(value)')} AS median, {R('min(value)')} AS "min",
  {R('max(hi)')} AS "max", {R('avg(value / 10)')} AS std, count(*) AS valid_pixel_count FROM t GROUP BY admin_id, year, month, variable, source_panel""")
def collapse_panel(spark, d):
    v, u = F.col("value"), F.col("user_id")
    rows = I.table(spark, d, "events").select(
        F.when(u % 50 != 0, (u % 20).cast("string")).alias("admin_id"), F.year("ts").alias("year"), F.month("ts").alias("month"),
        F.col("event_type").alias("variable"), F.lit("events").alias("source_panel"),
        v.alias("mean"), v.alias("median"), v.alias("min"), (v + 1).alias("max"), (v / 10).alias("std"), F.lit(1).alias("valid_pixel_count"))
    out = P.collapse_panel(rows, COLLAPSE_KEYS)
    return show(out, COLLAPSE_KEYS + ["valid_pixel_count"], ["mean", "median", "min", "max", "std"])


PROXY_KEYS = ["admin_id", "province", "year", "crop", "source", "proxy_variable"]


def proxy_rows(spark, d):
    """Seasonal proxy rows: customers as units, order priorities as source files."""
    customers = I.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("string").alias("province"))
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return I.table(spark, d, "orders").join(customers, "o_custkey").select(
        F.col("o_custkey").alias("admin_id"), "province", F.year("o_orderdate").alias("year"), F.lit("rice").alias("crop"),
        F.lit("grid").alias("source"), F.lit("yield").alias("proxy_variable"), F.col("o_orderpriority").alias("source_file"),
        (cents / F.lit(9999.991)).alias("raw_proxy_value"), F.when(F.col("o_custkey") % 5 != 0, cents / F.lit(9999.991)).alias("raw_proxy_yield"),
        F.when(F.col("o_custkey") % 4 == 0, cents / F.lit(9999.991 * 500)).otherwise(0.0).alias("raw_proxy_production_ton"),
        F.lit(1).alias("valid_pixel_count"))


PROXY = """proxy_rows AS (
  SELECT o_custkey AS admin_id, CAST(c_nationkey AS VARCHAR) AS province, CAST(year(o_orderdate) AS INTEGER) AS year, 'rice' AS crop, 'grid' AS source, 'yield' AS proxy_variable,
    o_orderpriority AS source_file, CAST(round(o_totalprice * 100) AS BIGINT) / CAST(9999.991 AS DOUBLE) AS v, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey),
proxy AS (
  SELECT admin_id, province, year, crop, source, proxy_variable, string_agg(DISTINCT source_file, '; ' ORDER BY source_file) AS source_file,
    avg(v) AS raw_proxy_value, CASE WHEN admin_id % 5 <> 0 THEN avg(v) END AS raw_proxy_yield,
    CASE WHEN admin_id % 4 = 0 THEN sum(v) / 500 END AS raw_proxy_production_ton, count(*) AS valid_pixel_count
  FROM proxy_rows GROUP BY admin_id, province, year, crop, source, proxy_variable)"""


@query("collapse_proxy", with_sql(PROXY) + f"""
SELECT admin_id, province, year, crop, source, proxy_variable, source_file, valid_pixel_count,
  {show_sql(('raw_proxy_value', 'raw_proxy_yield', 'raw_proxy_production_ton'))} FROM proxy""")
def collapse_proxy(spark, d):
    return show(P.collapse_proxy(proxy_rows(spark, d), PROXY_KEYS), [*PROXY_KEYS, "source_file", "valid_pixel_count"],
                ["raw_proxy_value", "raw_proxy_yield", "raw_proxy_production_ton"])


CALIBRATED = """panel AS (SELECT *, CASE WHEN admin_id % 11 > 0 THEN 1.0 + (admin_id % 3) * 0.5 END AS rice_area_proxy,
    coalesce(raw_proxy_production_ton, raw_proxy_yield * (CASE WHEN admin_id % 11 > 0 THEN 1.0 + (admin_id % 3) * 0.5 END) / 1000) AS proxy_production_ton FROM proxy),
official AS (SELECT province, year, max(production_ton) FILTER (crop = 'BUILDING') AS production_ton,
    max(area_hectare) FILTER (crop = 'BUILDING') * (4 + CAST(province AS INTEGER) % 3) AS area FROM yields WHERE crop = 'BUILDING' GROUP BY province, year),
totals AS (SELECT province, year, sum(proxy_production_ton) AS p, coalesce(sum(rice_area_proxy), 0) AS a FROM panel GROUP BY province, year),
coef AS (SELECT o.province, o.year, o.production_ton / nullif(p, 0) AS k FROM official o JOIN totals t ON o.province = t.province AND o.year = t.year
  WHERE (area IS NULL OR area = 0 OR a / area BETWEEN 0.8 AND 1.2) AND o.production_ton / nullif(p, 0) IS NOT NULL),
calibrated AS (SELECT p.*, k, CASE WHEN k IS NOT NULL THEN proxy_production_ton * k END AS calibrated_production_ton,
  CASE WHEN k IS NOT NULL AND proxy_production_ton IS NOT NULL THEN coalesce(raw_proxy_yield * k,
    CASE WHEN rice_area_proxy > 0 THEN proxy_production_ton * k * 1000 / rice_area_proxy END) END AS calibrated_yield,
  CASE WHEN k IS NOT NULL AND proxy_production_ton IS NOT NULL THEN 'calibrated' ELSE 'missing_official_or_proxy' END AS calibration_status
  FROM panel p LEFT JOIN coef c ON p.province = c.province AND p.year = c.year)"""


def calibrated_panel(spark, d):
    collapsed = P.collapse_proxy(proxy_rows(spark, d), PROXY_KEYS)
    areas = I.table(spark, d, "customer").select(
        F.col("c_custkey").alias("admin_id"),
        F.when(F.col("c_custkey") % 11 > 0, F.lit(1.0) + (F.col("c_custkey") % 3) * 0.5).alias("crop_area_ha"))
    panel = J.attach_area(collapsed, areas, "admin_id", "crop_area_ha", "rice_area_proxy")
    official = I.yields(spark, d).where("crop = 'BUILDING'").withColumn(
        "sown_area_hectare", F.col("area_hectare") * (F.lit(4) + F.col("province").cast("int") % 3))
    return P.province_calibration(panel, official, "sown_area_hectare", "crop")


CAL_FLOATS = ("proxy_production_ton", "calibrated_production_ton", "calibrated_yield")


@query("province_calibration", with_sql(I.YIELDS, PROXY, CALIBRATED) + f"""
SELECT admin_id, province, year, calibration_status, {R('k')} AS calibration_coefficient, {show_sql(CAL_FLOATS)} FROM calibrated""")
def province_calibration(spark, d):
    return show(calibrated_panel(spark, d), ["admin_id", "province", "year", "calibration_status"],
                ["calibration_coefficient", *CAL_FLOATS])


@query("proxy_panel", with_sql(I.YIELDS, PROXY, CALIBRATED) + f"""
SELECT u.admin_id, y.year, CAST(count(c.admin_id) AS BIGINT) AS proxy_observation_count,
  CASE WHEN count(c.admin_id) > 0 THEN 'available' ELSE 'missing' END AS status,
  max(c.calibration_status) AS calibration_status, {R('avg(c.calibrated_yield)')} AS calibrated_yield
FROM (SELECT c_custkey AS admin_id FROM customer) u CROSS JOIN (SELECT CAST(y AS INTEGER) AS year FROM range(1995, 2002) t(y)) y
LEFT JOIN calibrated c ON c.admin_id = u.admin_id AND c.year = y.year GROUP BY u.admin_id, y.year""")
def proxy_panel(spark, d):
    """Proxy rows to collapsed, area-weighted, calibrated panel with its availability grid."""
    panel = materialize(calibrated_panel(spark, d), "proxy-panel")
    units = I.table(spark, d, "customer").select(F.col("c_custkey").alias("admin_id"))
    grid = J.coverage_grid(units, *I.YEARS, panel, "admin_id")
    values = panel.groupBy("admin_id", "year").agg(
        F.max("calibration_status").alias("calibration_status"), rounded(F.avg("calibrated_yield")).alias("calibrated_yield"))
    return grid.join(values, ["admin_id", "year"], "left")


@query("proxy_bias", with_sql(I.YIELDS, PROXY, """pairs AS (SELECT p, o FROM
  (SELECT province, year, avg(raw_proxy_yield) AS p FROM proxy WHERE raw_proxy_yield IS NOT NULL GROUP BY province, year) a
  JOIN (SELECT province, year, avg(yield_kg_per_hectare) AS o FROM yields GROUP BY province, year) b ON a.province = b.province AND a.year = b.year WHERE o <> 0)""") + f"""
SELECT count(*) AS pairs, {R('avg((p - o) / o * 100)')} AS mean_bias_pct, {R('max(abs((p - o) / o * 100))')} AS max_abs_bias_pct,
  count(*) FILTER (abs((p - o) / o * 100) > 5) AS large_bias_count FROM pairs""")
def proxy_bias(spark, d):
    proxy = P.collapse_proxy(proxy_rows(spark, d), PROXY_KEYS)
    out = P.proxy_bias(proxy, I.yields(spark, d), ["province", "year"], "raw_proxy_yield", "yield_kg_per_hectare")
    return show(out, ["pairs", "large_bias_count"], ["mean_bias_pct", "max_abs_bias_pct"])


# --- trends, scores, indices ----------------------------------------------------------------

FITTED = """fitted AS (
  SELECT province, crop, count(*) AS n, coalesce(regr_slope(yield_kg_per_hectare, year - 1995), 0) AS slope,
    coalesce(regr_intercept(yield_kg_per_hectare, year - 1995), avg(yield_kg_per_hectare)) AS intercept,
    avg(yield_kg_per_hectare) AS baseline_mean, stddev_samp(yield_kg_per_hectare) AS baseline_std
  FROM yields WHERE year BETWEEN 1995 AND 1999 GROUP BY province, crop HAVING count(*) >= 3),
trended AS (SELECT y.*, baseline_mean, baseline_std, intercept + slope * (year - 1995) AS trend_yield
  FROM yields y LEFT JOIN fitted f ON y.province = f.province AND y.crop = f.crop)"""


def trended(spark, d):
    return X.baseline_trend(I.yields(spark, d), ["province", "crop"], "yield_kg_per_hectare", I.BASELINE, 3)


@query("baseline_trend", with_sql(I.YIELDS, FITTED) + f"""
SELECT province, crop, year, {show_sql(('trend_yield', 'baseline_mean', 'baseline_std'))} FROM trended""")
def baseline_trend(spark, d):
    return show(trended(spark, d), ["province", "crop", "year"], ["trend_yield", "baseline_mean", "baseline_std"])


OUTCOME = """ofit AS (
  SELECT province, count(*) FILTER (year BETWEEN 1995 AND 1999) AS n, coalesce(regr_slope(yield_kg_per_hectare, year - 1995), 0) AS slope,
    coalesce(regr_intercept(yield_kg_per_hectare, year - 1995), avg(yield_kg_per_hectare)) AS intercept,
    avg(yield_kg_per_hectare) FILTER (year BETWEEN 1995 AND 1999) AS baseline_mean FROM unit_yields GROUP BY province),
outcome AS (SELECT u.*, baseline_mean, CASE WHEN n >= 3 THEN intercept + slope * (year - 1995) ELSE baseline_mean END AS trend_yield
  FROM unit_yields u JOIN ofit f ON u.province = f.province),
anomalies AS (SELECT *, yield_kg_per_hectare - trend_yield AS yield_anomaly_abs, (yield_kg_per_hectare - trend_yield) / nullif(trend_yield, 0) * 100 AS yield_anomaly_pct FROM outcome)"""


def outcome_panel(spark, d):
    return X.outcome_trend(I.unit_yields(spark, d), "province", "yield_kg_per_hectare", I.BASELINE, 3)


@query("outcome_trend", with_sql(I.YIELDS, I.UNIT_YIELDS, OUTCOME) + f"""
SELECT province, year, {show_sql(('trend_yield', 'baseline_mean', 'yield_anomaly_abs', 'yield_anomaly_pct'))} FROM anomalies""")
def outcome_trend(spark, d):
    return show(outcome_panel(spark, d), ["province", "year"], ["trend_yield", "baseline_mean", "yield_anomaly_abs", "yield_anomaly_pct"])


CV_INPUT = """cv AS (SELECT province, crop, year, CASE WHEN (year + CAST(province AS INTEGER)) % 4 > 0 THEN yield_kg_per_hectare END AS v FROM yields)"""


@query("rolling_cv", with_sql(I.YIELDS, CV_INPUT, """idx AS (SELECT *, count(v) OVER (PARTITION BY province, crop ORDER BY year ROWS UNBOUNDED PRECEDING) AS i FROM cv)""") + f"""
SELECT province, crop, year, {R('CASE WHEN i >= 3 THEN (SELECT stddev_samp(b.v) / abs(avg(b.v)) FROM idx b WHERE b.province = a.province AND b.crop = a.crop AND b.v IS NOT NULL AND b.i BETWEEN a.i - 2 AND a.i) END')} AS yield_cv_3yr FROM idx a""")
def rolling_cv(spark, d):
    kept = F.when((F.col("year") + F.col("province").cast("int")) % 4 > 0, F.col("yield_kg_per_hectare"))
    rows = I.yields(spark, d).select("province", "crop", "year", kept.alias("v"))
    return show(X.rolling_cv(rows, ["province", "crop"], "v", 3, "yield_cv_3yr"), ["province", "crop", "year"], ["yield_cv_3yr"])


DOWN = f"""down AS (SELECT *, CASE WHEN trend_yield IS NOT NULL THEN greatest(0, trend_yield - yield_kg_per_hectare) END AS downside_risk,
  CASE WHEN trend_yield IS NOT NULL AND year = 2000 THEN greatest(0, trend_yield - yield_kg_per_hectare) END AS event_loss,
  CASE WHEN year = 2001 THEN yield_kg_per_hectare / nullif(trend_yield, 0) END AS recovery_2001 FROM trended)"""


@query("downside_recovery", with_sql(I.YIELDS, FITTED, DOWN) + f"""
SELECT province, crop, year, {show_sql(('downside_risk', 'event_loss', 'recovery_2001'))} FROM down""")
def downside_recovery(spark, d):
    out = X.downside_and_recovery(trended(spark, d), "yield_kg_per_hectare", "trend_yield", I.EVENT_YEAR, [2001])
    return show(out, ["province", "crop", "year"], ["downside_risk", "event_loss", "recovery_2001"])


@query("max_duration", """
WITH t AS (SELECT user_id, ts, event_id, value > 20 AS f FROM events),
g AS (SELECT user_id, f, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM t),
r AS (SELECT user_id, b, count(*) FILTER (f) AS n FROM g GROUP BY user_id, b)
SELECT user_id, max(n) AS max_duration FROM r GROUP BY user_id""")
def max_duration(spark, d):
    events = I.table(spark, d, "events").select("user_id", "ts", "event_id", "value")
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    return X.max_duration(events, "user_id", [F.col("ts"), F.col("event_id")], F.col("value") > 20, hour, "max_duration")


@query("zscore_within_unit", with_sql(I.CLIMATE) + f"""
SELECT c.province, c.year, {R('(tmax - m) / nullif(s, 0)')} AS tmax_anomaly FROM climate c
JOIN (SELECT province, avg(tmax) AS m, stddev_samp(tmax) AS s FROM climate GROUP BY province) g ON c.province = g.province""")
def zscore_within_unit(spark, d):
    out = X.zscore_within_unit(I.climate_source(spark, d), "province", "tmax", "tmax_anomaly")
    return show(out, ["province", "year"], ["tmax_anomaly"])


@query("exposure_index", with_sql(I.YIELDS, I.CLIMATE, I.REMOTE, MERGED, """st AS (SELECT avg(tmax) AS tm, stddev_samp(tmax) AS ts,
  avg(precipitation) AS pm, stddev_samp(precipitation) AS ps, avg(precipitation_remote) AS rm, stddev_samp(precipitation_remote) AS rs FROM merged)""",
  """z AS (SELECT province, year, (tmax - tm) / ts AS h, -(precipitation - pm) / ps AS d1, -(precipitation_remote - rm) / rs AS d2 FROM merged, st)""",
  """c AS (SELECT *, CASE WHEN d1 IS NULL THEN d2 WHEN d2 IS NULL THEN d1 ELSE (d1 + d2) / 2 END AS dr FROM z)""") + f"""
SELECT province, year, {R('h')} AS heat_component, {R('dr')} AS drought_component,
  {R('CASE WHEN h IS NULL THEN dr WHEN dr IS NULL THEN h ELSE h + dr END')} AS exposure_index FROM c""")
def exposure_index(spark, d):
    out = X.exposure_index(merged_sources(spark, d), ["tmax"], ["precipitation", "precipitation_remote"])
    return show(out, ["province", "year"], ["heat_component", "drought_component", "exposure_index"])


@query("zscore_outliers", """
WITH s AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS sd FROM events GROUP BY event_type)
SELECT event_id, CAST(abs((value - m) / sd) > 3 AS BIGINT) AS outlier FROM events JOIN s ON events.event_type = s.event_type""")
def zscore_outliers(spark, d):
    rows = I.table(spark, d, "events").select("event_id", "event_type", "value")
    return X.zscore_outliers(rows, "event_type", "value", "outlier").select("event_id", "outlier")


CHD_THRESHOLD = """base AS (SELECT * FROM {src} WHERE year BETWEEN 1995 AND 1999),
marks AS (SELECT province, quantile_cont(tmax, 0.9) AS h, quantile_cont(precipitation, 0.1) AS p FROM base GROUP BY province),
whole AS (SELECT quantile_cont(tmax, 0.9) AS h, quantile_cont(precipitation, 0.1) AS p FROM base),
chd AS (SELECT c.*, CAST(coalesce(tmax > coalesce(m.h, w.h) AND precipitation < coalesce(m.p, w.p), false) AS BIGINT) AS chd_annual
  FROM {src} c LEFT JOIN marks m ON c.province = m.province CROSS JOIN whole w)"""


@query("chd_annual", with_sql(I.CLIMATE, CHD_THRESHOLD.format(src="climate")) + "SELECT province, year, chd_annual FROM chd")
def chd_annual(spark, d):
    return X.add_chd_annual(I.climate_source(spark, d), "province", I.BASELINE).select("province", "year", "chd_annual")


# --- unions and outcome choice --------------------------------------------------------------

@query("union_dedupe", with_sql(I.YIELDS) + f"""
, u AS (SELECT province, year, crop, yield_kg_per_hectare AS y, 0 AS s FROM yields UNION ALL
  SELECT province, year, CASE WHEN year > 1998 THEN crop ELSE lower(crop) END, production_ton, 1 FROM yields)
SELECT province, year, crop, {R('y')} AS yield_kg_per_hectare, s AS source_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY province, year, crop ORDER BY s DESC) AS r FROM u) WHERE r = 1""")
def union_dedupe(spark, d):
    y = I.yields(spark, d)
    first = y.select("province", "year", "crop", "yield_kg_per_hectare", F.lit(0).alias("source_rank"))
    second = y.select(
        "province", "year", F.when(F.col("year") > 1998, F.col("crop")).otherwise(F.lower("crop")).alias("crop"), F.col("production_ton").alias("yield_kg_per_hectare"), F.lit(1).alias("source_rank"))
    out = P.union_dedupe([first, second], ["province", "year", "crop"], [F.col("yield_kg_per_hectare").desc()])
    return show(out, ["province", "year", "crop", "source_rank"], ["yield_kg_per_hectare"])


BACKFILLED = """filled AS (
  SELECT province, province AS province_code, year, crop, CASE WHEN year % 4 = 0 THEN NULL ELSE yield_kg_per_hectare END AS y, false AS b FROM yields WHERE year < 2001
  UNION ALL SELECT province, province, year, crop, production_ton, true FROM yields WHERE year > 1997),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY province, year, crop ORDER BY y IS NULL, b, y) AS r FROM filled) WHERE r = 1)"""


@query("append_backfill", with_sql(I.YIELDS, BACKFILLED) + f"""
SELECT province, year, crop, {R('y')} AS yield_kg_per_hectare, b AS is_backfill FROM kept""")
def append_backfill(spark, d):
    y = I.yields(spark, d)
    primary = y.where("year < 2001").select(
        "province", F.col("province").alias("province_code"), "year", "crop",
        F.when(F.col("year") % 4 != 0, F.col("yield_kg_per_hectare")).alias("yield_kg_per_hectare"))
    late = y.where("year > 1997").select(
        F.concat("province", F.lit("省")).alias("province"), F.col("province").alias("province_code"), "year", "crop",
        F.col("production_ton").alias("yield_kg_per_hectare"))
    out = P.append_backfill(primary, late, N.normalize_province_name, [F.col("province")], [F.col("yield_kg_per_hectare")])
    return show(out, ["province", "year", "crop", "is_backfill"], ["yield_kg_per_hectare"])


RICE, GRAIN = ("building", "rice"), ("furniture", "grain")


@query("select_outcome", with_sql(I.YIELDS) + f"""
SELECT province, year, crop, {R('yield_kg_per_hectare')} AS yield_kg_per_hectare, 'province_rice_yield_anomaly' AS outcome_type FROM yields
WHERE crop = 'BUILDING'""")
def select_outcome(spark, d):
    """Rice has the event year; tests cover the choice of grain."""
    y = I.yields(spark, d)
    chosen, name = P.select_outcome(y, RICE, GRAIN, I.EVENT_YEAR)
    return show(chosen.withColumn("outcome_type", F.lit(name)), ["province", "year", "crop", "outcome_type"], ["yield_kg_per_hectare"])


# --- compositions ---------------------------------------------------------------------------

@query("annual_exposure_panel", with_sql(I.YIELDS, I.CLIMATE, I.REMOTE, MERGED, "m AS (SELECT * FROM merged WHERE year BETWEEN 1995 AND 2001)",
  """g AS (SELECT province, avg(tmax) AS tm, stddev_samp(tmax) AS ts, avg(precipitation) AS pm, stddev_samp(precipitation) AS ps,
     avg(ndvi) AS nm, stddev_samp(ndvi) AS ns FROM m GROUP BY province)""",
  """an AS (SELECT m.*, (tmax - tm) / nullif(ts, 0) AS tmax_anomaly, (precipitation - pm) / nullif(ps, 0) AS precip_anomaly,
     (ndvi - nm) / nullif(ns, 0) AS ndvi_anomaly FROM m JOIN g ON m.province = g.province)""",
  CHD_THRESHOLD.format(src="an"), """ev AS (SELECT c.*, e.v FROM chd c LEFT JOIN (SELECT province, avg(chd_annual) AS v FROM chd WHERE year = 2000 GROUP BY province) e
     ON c.province = e.province)""") + f"""
SELECT province, year, {show_sql(('tmax_anomaly', 'precip_anomaly', 'ndvi_anomaly'))}, chd_annual, CAST(year - 2000 AS BIGINT) AS event_time,
  CAST(year >= 2000 AS BIGINT) AS post, {R('v')} AS chd_event_intensity,
  CAST(coalesce(v >= (SELECT quantile_cont(v, 0.75) FROM ev), false) AS BIGINT) AS chd_event_treated_p75 FROM ev""")
def annual_exposure_panel(spark, d):
    """Source panels to wide annual exposure: merge, anomalies, annual index, event fields.

    The annual index is 0 or 1, so its event-year means have few values and one aggregate cuts them.
    """
    merged = merged_sources(spark, d).where(F.col("year").between(*I.YEARS))
    merged = materialize(merged, "annual-sources")
    panel = X.add_chd_annual(X.add_anomalies(merged, "province"), "province", I.BASELINE)
    out = C.add_event_columns(materialize(panel, "annual-exposure"), I.EVENT_YEAR, day_counts=True)
    return show(out, ["province", "year", "chd_annual", "event_time", "post", "chd_event_treated_p75"],
                ["tmax_anomaly", "precip_anomaly", "ndvi_anomaly", "chd_event_intensity"])


PROVINCE_CHD = """unit AS (SELECT CAST(c_nationkey AS VARCHAR) AS province, o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS chd,
    CASE WHEN c_nationkey % 4 = 0 THEN -1.0 ELSE CAST(round(any_value(c_acctbal) * 100) AS BIGINT) / 100000.0 END AS w
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, o_custkey, year(o_orderdate)),
zone AS (SELECT province, year, count(*) AS source_rows, coalesce(sum(chd * w) FILTER (w > 0) / nullif(sum(w) FILTER (w > 0), 0), avg(chd)) AS chd_annual
  FROM unit WHERE year BETWEEN 1995 AND 2001 GROUP BY province, year),
zev AS (SELECT z.*, e.v FROM zone z LEFT JOIN (SELECT province, avg(chd_annual) AS v FROM zone WHERE year = 2000 GROUP BY province) e ON z.province = e.province)"""


def province_chd(spark, d):
    customers = I.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_acctbal")
    weight = F.when(F.col("c_nationkey") % 4 == 0, -1.0).otherwise(F.round(F.col("c_acctbal") * 100).cast("bigint") / F.lit(100000.0))
    units = (
        I.table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("chd_annual"))
        .join(customers, "o_custkey")
        .select(F.col("c_nationkey").cast("string").alias("province"), "year", "chd_annual", weight.alias("rice_area_ha"),
                F.col("c_nationkey").cast("string").alias("province_code"), "o_custkey")
        .where(F.col("year").between(*I.YEARS)))
    zones = P.weighted_zone_mean(units, ["province", "year"], ["chd_annual"], ["rice_area_ha"], ["province_code"], "o_custkey")
    return C.add_event_columns(materialize(zones, "province-chd"), I.EVENT_YEAR)


@query("province_chd_panel", with_sql(PROVINCE_CHD) + f"""
SELECT province, year, source_rows, {R('chd_annual')} AS chd_annual, {R('v')} AS chd_event_intensity, CAST(year >= 2000 AS BIGINT) AS post,
  CAST(coalesce(v >= (SELECT quantile_cont(v, 0.75) FROM zev), false) AS BIGINT) AS chd_event_treated_p75 FROM zev""")
def province_chd_panel(spark, d):
    """Unit exposure to weighted province exposure with event fields."""
    return show(province_chd(spark, d), ["province", "year", "source_rows", "post", "chd_event_treated_p75"], ["chd_annual", "chd_event_intensity"])


def model_panel_frame(spark, d):
    """Outcome choice, trend anomaly and joined exposure; the input of the models."""
    y = I.yields(spark, d).withColumn("province_code", F.col("province"))
    chosen, name = P.select_outcome(y, RICE, GRAIN, I.EVENT_YEAR)
    outcome = X.outcome_trend(chosen, "province", "yield_kg_per_hectare", I.BASELINE, 3)
    exposure = C.add_event_columns(annual_panel(spark, d), I.EVENT_YEAR, day_counts=True).select(
        "province", "province_code", "year", "chd_annual", "tmax_anomaly", "precip_anomaly", "event_time", "post",
        "chd_event_intensity", "chd_event_treated_p75")
    joined = J.code_or_name_join(outcome, exposure, "province_code", "province", N.normalize_admin_code,
                                 N.normalize_province_name, [F.col("chd_annual")])
    return joined.withColumn("outcome_type", F.lit(name))


MODEL = """rice AS (SELECT * FROM yields WHERE crop = 'BUILDING'),
mfit AS (SELECT province, count(*) FILTER (year BETWEEN 1995 AND 1999) AS n, coalesce(regr_slope(yield_kg_per_hectare, year - 1995), 0) AS slope,
    coalesce(regr_intercept(yield_kg_per_hectare, year - 1995), avg(yield_kg_per_hectare)) AS intercept,
    avg(yield_kg_per_hectare) FILTER (year BETWEEN 1995 AND 1999) AS baseline_mean FROM rice GROUP BY province),
mtrend AS (SELECT r.*, CASE WHEN n >= 3 THEN intercept + slope * (year - 1995) ELSE baseline_mean END AS trend_yield FROM rice r JOIN mfit f ON r.province = f.province),
model AS (SELECT r.province, r.year, r.yield_kg_per_hectare, r.area_hectare, r.production_ton, trend_yield,
    (r.yield_kg_per_hectare - trend_yield) / nullif(trend_yield, 0) * 100 AS yield_anomaly_pct,
    t.chd_annual, t.tmax_anomaly, t.precip_anomaly, t.event_time, t.post, t.chd_event_intensity, t.chd_event_treated_p75
  FROM mtrend r LEFT JOIN treated t ON r.province = t.province AND r.year = t.year)"""
MODEL_CHAIN = (*I.CHD_CHAIN, I.YIELDS, MODEL)


@query("model_panel", with_sql(*MODEL_CHAIN) + f"""
SELECT province, year, {show_sql(('yield_kg_per_hectare', 'trend_yield', 'yield_anomaly_pct', 'tmax_anomaly', 'precip_anomaly', 'chd_event_intensity'))},
  chd_annual, event_time, post, chd_event_treated_p75, 'province_rice_yield_anomaly' AS outcome_type FROM model""")
def model_panel(spark, d):
    """Yield and exposure joined into the province model panel."""
    return show(model_panel_frame(spark, d), ["province", "year", "chd_annual", "event_time", "post", "chd_event_treated_p75", "outcome_type"],
                ["yield_kg_per_hectare", "trend_yield", "yield_anomaly_pct", "tmax_anomaly", "precip_anomaly", "chd_event_intensity"])


@query("index_panel", with_sql(I.YIELDS, FITTED, DOWN, I.CLIMATE, "j AS (SELECT d.*, c.tmax AS climate_tmax, c.precipitation AS climate_precipitation FROM down d LEFT JOIN climate c ON d.province = c.province AND d.year = c.year)",
  "st AS (SELECT avg(climate_tmax) AS tm, stddev_samp(climate_tmax) AS ts, avg(climate_precipitation) AS pm, stddev_samp(climate_precipitation) AS ps FROM j)",
  "i AS (SELECT j.*, (climate_tmax - tm) / ts AS h, -(climate_precipitation - pm) / ps AS dr FROM j, st)") + f"""
SELECT province, crop, year, {R('yield_kg_per_hectare - trend_yield')} AS yield_anomaly_abs, {R('(yield_kg_per_hectare - trend_yield) / nullif(trend_yield, 0) * 100')} AS yield_anomaly_pct,
  {R('CASE WHEN baseline_std > 0 THEN (yield_kg_per_hectare - baseline_mean) / baseline_std END')} AS yield_anomaly_zscore, {show_sql(('downside_risk', 'event_loss', 'recovery_2001'))},
  {R('CASE WHEN h IS NULL THEN dr WHEN dr IS NULL THEN h ELSE h + dr END')} AS exposure_index
FROM i WHERE CAST(province AS INTEGER) < 15""")
def index_panel(spark, d):
    """Yield, climate and index columns per unit, crop and year, for the study region."""
    c = F.col
    base = X.downside_and_recovery(trended(spark, d), "yield_kg_per_hectare", "trend_yield", I.EVENT_YEAR, [2001])
    joined = J.prefixed_left_join(base, I.climate_source(spark, d), ["admin_id", "province", "year"], "climate", [c("tmax").desc()])
    joined = materialize(joined, "index-join").withColumns(
        yield_anomaly(c("yield_kg_per_hectare"), c("trend_yield"), c("baseline_mean"), c("baseline_std")))
    out = X.exposure_index(joined, ["climate_tmax"], ["climate_precipitation"]).where(c("province").isin(*[str(i) for i in range(15)]))
    return show(out, ["province", "crop", "year"], ["yield_anomaly_abs", "yield_anomaly_pct", "yield_anomaly_zscore",
                                                     "downside_risk", "event_loss", "recovery_2001", "exposure_index"])
