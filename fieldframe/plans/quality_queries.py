"""Coverage, quality, gate and summary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldframe.functions.numbers import rounded
from fieldframe.operators import climate as C
from fieldframe.operators import joins as J
from fieldframe.operators import models as M
from fieldframe.operators import quality as Q
from fieldframe.operators import treatment as T
from fieldframe.plans import inputs as I
from fieldframe.plans import panel_queries as P
from fieldframe.plans.clean_queries import choose, choose_sql
from fieldframe.plans.inputs import R, with_sql
from fieldframe.plans.panel_queries import MERGED, show, show_sql
from fieldframe.plans.registry import query

MODEL_SQL = (I.YIELDS, I.CLIMATE, I.REMOTE, MERGED)


def model(spark, d):
    """Merged annual sources: ndvi as the (partly missing) outcome, tmax as the exposure."""
    return P.merged_sources(spark, d)


def metric_sql(pairs, source):
    return " UNION ALL ".join(f"SELECT '{m}' AS metric, CAST({e} AS DOUBLE) AS value FROM {source}" for m, e in pairs)


# --- yield coverage and tier ----------------------------------------------------------------

Y_LEVELS, Y_CROPS = ("county", "prefecture", "province"), ("rice", "grain", "unknown")
COVERAGE_IN = f"""y AS (SELECT o_orderpriority AS source_file, {choose_sql(Y_LEVELS, 'c_custkey')} AS admin_level, {choose_sql(Y_CROPS, 'c_custkey // 3')} AS crop_type,
  CASE WHEN c_custkey % 17 = 0 THEN '' ELSE CAST(c_nationkey AS VARCHAR) END AS admin_key, CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE year(o_orderdate) END AS year,
  o_totalprice / 20 AS yv, CAST(o_orderkey % 40 - 1 AS DOUBLE) AS av FROM orders JOIN customer ON o_custkey = c_custkey)"""


def coverage_rows(spark, d):
    k = F.col("c_custkey")
    customers = I.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_custkey", "c_nationkey")
    return I.table(spark, d, "orders").join(customers, "o_custkey").select(
        F.col("o_orderpriority").alias("source_file"), choose(Y_LEVELS, k).alias("admin_level"), choose(Y_CROPS, F.floor(k / 3)).alias("crop_type"),
        F.when(k % 17 == 0, "").otherwise(F.col("c_nationkey").cast("string")).alias("admin_key"),
        F.when(F.col("o_orderkey") % 23 != 0, F.year("o_orderdate")).alias("year"),
        (F.col("o_totalprice") / 20).alias("yield_kg_per_hectare"), (F.col("o_orderkey") % 40 - 1).cast("double").alias("sown_area_hectare"))


@query("yield_coverage", with_sql(COVERAGE_IN, "s AS (SELECT min(year) AS lo, max(year) AS hi FROM y)",
  """u AS (SELECT source_file, admin_level, crop_type, admin_key, count(DISTINCT year) AS n, count(DISTINCT year) FILTER (year BETWEEN lo AND hi) AS inn FROM y, s GROUP BY ALL)""",
  """g AS (SELECT source_file, admin_level, crop_type, count(*) FILTER (admin_key <> '') AS units, count(*) FILTER (inn = (SELECT hi - lo + 1 FROM s)) AS bal, sum(n) FILTER (admin_key <> '') AS pairs FROM u GROUP BY ALL)""",
  """r AS (SELECT source_file, admin_level, crop_type, min(year) AS a, max(year) AS b, count(DISTINCT year) AS obs, (SELECT hi - lo + 1 FROM s) AS e,
     sum(CAST(yv < 500 OR yv > 15000 AS INTEGER) + CAST(av <= 0 AS INTEGER)) AS odd, count(*) - count(DISTINCT (admin_key, coalesce(year, -1))) AS dup FROM y GROUP BY ALL)""") + """
SELECT r.source_file, r.admin_level, r.crop_type, CAST(a AS INTEGER) AS coverage_year_start, CAST(b AS INTEGER) AS coverage_year_end, CAST(e AS BIGINT) AS expected_years, obs AS observed_years,
  round(obs / e, 4) AS year_coverage_rate, units AS admin_unit_count, bal AS balanced_panel_unit_count, round(1 - obs / e, 4) AS missing_rate_by_year,
  round(CASE WHEN units = 0 THEN 1.0 ELSE 1 - pairs / (units * e) END, 4) AS missing_rate_by_admin, 'kg/ha_standardized' AS yield_unit_detected,
  'hectare_standardized' AS area_unit_detected, 'missing' AS production_unit_detected, CAST(odd AS BIGINT) AS suspicious_value_count, dup AS duplicate_record_count,
  CASE WHEN r.admin_level = 'county' AND r.crop_type = 'rice' AND obs / e >= 0.75 THEN 'use_county_rice_main_model'
    WHEN r.admin_level = 'prefecture' AND r.crop_type = 'rice' AND obs / e >= 0.75 THEN 'use_prefecture_rice_main_model'
    WHEN r.crop_type = 'grain' AND r.admin_level IN ('county', 'prefecture') AND obs / e >= 0.75 THEN 'downgrade_main_model_to_grain_yield'
    WHEN obs / e >= 0.5 AND r.admin_level IN ('county', 'prefecture') THEN 'run_fixed_effects_and_exploratory_event_study_with_caution'
    ELSE 'official_yield_coverage_insufficient_use_remote_sensing_growth_analysis' END AS recommendation
FROM r JOIN g ON r.source_file = g.source_file AND r.admin_level = g.admin_level AND r.crop_type = g.crop_type""")
def yield_coverage(spark, d):
    return Q.yield_coverage(coverage_rows(spark, d)).withColumn("expected_years", F.col("expected_years").cast("bigint"))


TIER_SCHEMA = ("tier string, admin_level string, crop_type string, observed_years bigint, year_coverage_rate double, conclusion_strength string, "
               "downgrade_reason string, recommended_scope string, forbidden_claim string")


@query("data_tier", f"""
WITH t AS (SELECT {choose_sql(Y_LEVELS, 'c_custkey')} AS lv, {choose_sql(Y_CROPS, 'c_custkey // 3')} AS cr, year(o_orderdate) AS year,
  o_orderpriority LIKE '%URGENT%' AS proxy FROM orders JOIN customer ON o_custkey = c_custkey),
c AS (SELECT * FROM t WHERE NOT proxy AND lv IN ('county', 'prefecture') AND cr = 'grain'),
m AS (SELECT (SELECT lv FROM c GROUP BY lv ORDER BY count(*) DESC, lv LIMIT 1) AS lv, 'grain' AS cr, count(DISTINCT year) AS n, max(year) - min(year) + 1 AS e FROM t)
SELECT 'tier_2' AS tier, lv AS admin_level, cr AS crop_type, n AS observed_years, {R('n / e')} AS year_coverage_rate, 'impact_assessment' AS conclusion_strength,
  'rice_panel_missing_use_grain_panel' AS downgrade_reason, lv || '_grain_yield_anomaly' AS recommended_scope,
  'strong_causal_claim_without_parallel_trends_and_coverage_checks' AS forbidden_claim FROM m""")
def data_tier(spark, d):
    """Rice rows exist only as proxies here, so grain rows decide."""
    rows = coverage_rows(spark, d)
    proxy = Q.is_proxy([F.when(F.col("source_file").contains("URGENT") | (F.col("crop_type") == "rice"), F.lit("ggcp proxy")).otherwise(F.col("source_file"))])
    flags = rows.select("admin_level", "crop_type", "year", proxy.alias("is_proxy"), (F.col("yield_kg_per_hectare") > 0).alias("usable"))
    return show(spark.createDataFrame([tuple(Q.data_tier(flags).values())], TIER_SCHEMA),
                ["tier", "admin_level", "crop_type", "observed_years", "conclusion_strength", "downgrade_reason", "recommended_scope", "forbidden_claim"],
                ["year_coverage_rate"])


# --- missing values, correlation ------------------------------------------------------------

@query("missing_rates", with_sql(*MODEL_SQL) + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, {R(f'avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)')} AS missing_rate FROM merged" for c in ("tmax", "ndvi", "precipitation_remote")))
def missing_rates(spark, d):
    return show(Q.missing_rates(model(spark, d), ["tmax", "ndvi", "precipitation_remote"]), ["variable"], ["missing_rate"])


@query("valid_observations", with_sql(*MODEL_SQL) + "SELECT province, count(ndvi) AS valid_observations FROM merged GROUP BY province")
def valid_observations(spark, d):
    return Q.valid_observations(model(spark, d), "province", "ndvi")


FIELDS = ("l_quantity", "l_extendedprice", "l_discount", "tax")
CORR_IN = "li AS (SELECT l_quantity, l_extendedprice, l_discount, CASE WHEN l_linenumber <> 2 THEN l_tax END AS tax FROM lineitem)"


def corr_rows(spark, d):
    return I.table(spark, d, "lineitem").select(*FIELDS[:3], F.when(F.col("l_linenumber") != 2, F.col("l_tax")).alias("tax"))


@query("correlation_matrix", with_sql(CORR_IN) + " UNION ALL ".join(
    f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", {R(f'corr({a}, {b})')} AS correlation FROM li" for a in FIELDS for b in FIELDS))
def correlation_matrix(spark, d):
    return show(Q.correlation_matrix(corr_rows(spark, d), FIELDS), ["left", "right"], ["correlation"])


@query("pairwise_vif", with_sql(CORR_IN) + " UNION ALL ".join(
    f"SELECT '{a}' AS variable, {R('1 / (1 - greatest(' + ', '.join(f'corr({a}, {b}) * corr({a}, {b})' for b in FIELDS if b != a) + '))')} AS vif FROM li" for a in FIELDS))
def pairwise_vif(spark, d):
    return show(Q.pairwise_vif(corr_rows(spark, d), FIELDS), ["variable"], ["vif"])


# --- coverage and gates ---------------------------------------------------------------------

RATES = with_sql(*MODEL_SQL, "n AS (SELECT count(*) AS r, count(DISTINCT province) AS u, count(tmax) AS tmax, count(ndvi) AS ndvi FROM merged)")


def rates(spark, d):
    return Q.coverage_rates(model(spark, d), ["tmax", "ndvi"], "province", *I.YEARS)


@query("coverage_rate", RATES + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {c} AS nonmissing, {R(f'{c} / r')} AS row_rate, {R(f'{c} / (u * 7)')} AS target_rate FROM n" for c in ("tmax", "ndvi")))
def coverage_rate(spark, d):
    return show(rates(spark, d), ["column", "nonmissing"], ["row_rate", "target_rate"])


@query("highlight_coverage", with_sql(*MODEL_SQL) + f"""
SELECT {R('count(ndvi) / (4 * 7.0)')} AS coverage FROM merged WHERE province IN ('1', '2', '3', '99')""")
def highlight_coverage(spark, d):
    return show(Q.highlight_coverage(model(spark, d), "province", ["1", "2", "3市", "99"], "ndvi", *I.YEARS), [], ["coverage"])


@query("claim_gate", RATES + f"""
SELECT {R('tmax / (u * 7)')} AS exposure_rate, {R('ndvi / (u * 7)')} AS outcome_rate,
  CASE WHEN tmax / (u * 7) >= 0.75 AND ndvi / (u * 7) >= 0.75 THEN 'impact_assessment' ELSE 'association' END AS claim_strength,
  CASE WHEN tmax / (u * 7) >= 0.75 THEN 'ok' WHEN tmax > 0 THEN 'partial' ELSE 'empty' END AS status,
  CASE WHEN tmax / (u * 7) >= 0.75 THEN 'ok_for_province_fixed_effects' ELSE 'not_usable_until_fixed' END AS exposure_status FROM n""")
def claim_gate(spark, d):
    return show(Q.claim_gate(rates(spark, d), "tmax", "ndvi"), ["claim_strength", "status", "exposure_status"], ["exposure_rate", "outcome_rate"])


@query("exposure_diagnosis", with_sql(*MODEL_SQL, "m AS (SELECT province, year, CASE WHEN year = 2000 AND CAST(province AS INTEGER) < 20 THEN ndvi END AS e FROM merged)",
  "f AS (SELECT count(*) AS r, count(e) AS k, count(DISTINCT province) AS u, count(DISTINCT province) FILTER (e IS NOT NULL) AS eu, count(*) FILTER (CAST(province AS INTEGER) >= 22) AS outside FROM m)",
  "cl AS (SELECT count(*) AS n, min(year) AS a, max(year) AS b FROM climate)") + """
SELECT 'summary' AS section, 'model_panel_rows' AS metric, CAST(r AS VARCHAR) AS value FROM f
UNION ALL SELECT 'summary', 'exposure_field', 'exposure_index'
UNION ALL SELECT 'summary', 'exposure_nonmissing', CAST(k AS VARCHAR) FROM f
UNION ALL SELECT 'summary', 'exposure_nonmissing_rate', CAST(CAST(round(k / r, 6) AS DECIMAL(20,6)) AS VARCHAR) FROM f
UNION ALL SELECT 'summary', 'exposure_coverage_status', 'ok_only_for_2000_cross_section'
UNION ALL SELECT 'summary', 'likely_causes', 'no_annual_exposure_panel;only_2000_event_exposure' || CASE WHEN outside > 0 THEN ';study_region_mismatch' ELSE '' END
  || CASE WHEN u > eu THEN ';national_yield_but_regional_exposure' ELSE '' END || CASE WHEN k < r * 0.25 THEN ';admin_join_mismatch' ELSE '' END FROM f
UNION ALL SELECT 'join_loss', 'missing_admin_year_count', CAST(r - k AS VARCHAR) FROM f
UNION ALL SELECT 'join_loss', 'main_event_year', '2000'
UNION ALL SELECT 'climate', 'rows', CAST(n AS VARCHAR) FROM cl UNION ALL SELECT 'climate', 'year_range', a || '-' || b FROM cl
UNION ALL SELECT 'model_panel', 'year_distribution:' || year, CAST(count(*) AS VARCHAR) FROM m GROUP BY year
UNION ALL SELECT 'exposure', 'nonmissing_by_year:' || year, CAST(count(e) AS VARCHAR) FROM m WHERE e IS NOT NULL GROUP BY year
UNION ALL SELECT 'model_panel', 'province_distribution:' || province, CAST(count(*) AS VARCHAR) FROM m GROUP BY province
UNION ALL SELECT 'exposure', 'nonmissing_by_province:' || province, CAST(count(e) AS VARCHAR) FROM m WHERE e IS NOT NULL GROUP BY province""")
def exposure_diagnosis(spark, d):
    kept = (F.col("year") == 2000) & (F.col("province").cast("int") < 20)
    panel = model(spark, d).select("province", "year", F.col("province").alias("admin_code"), F.when(kept, F.col("ndvi")).alias("exposure_index"))
    return Q.exposure_diagnosis(panel, "chd_annual", {"climate": I.climate_source(spark, d)}, I.EVENT_YEAR, [str(i) for i in range(22)])


SCOPE_IN = """parts AS (SELECT 'tier_3' AS tier, 'province' AS admin_level, CASE WHEN p_size % 2 = 0 THEN 'grain' ELSE 'rice' END AS crop_type, p_partkey,
  CASE WHEN p_size % 3 = 0 THEN 'province_grain_yield_anomaly' ELSE '' END AS outcome_type, (p_partkey % 11) / 10.0 AS coverage_rate, (p_partkey % 7) / 6.0 AS exposure_rate,
  (p_partkey % 5) / 4.0 AS outcome_rate, p_partkey % 3 = 0 AS has_event FROM part)"""


@query("model_scope", f"""
WITH t AS (SELECT p_partkey, {choose_sql(('tier_1', 'tier_2', 'tier_3', 'tier_4', 'unknown'), 'p_partkey')} AS tier, {choose_sql(('province', 'county'), 'p_partkey // 5')} AS lv,
  {choose_sql(('grain', 'rice'), 'p_partkey // 10')} AS cr, {choose_sql(('province_grain_yield_anomaly', ''), 'p_partkey // 20')} AS ot, (p_partkey % 11) / 10.0 AS c,
  (p_partkey % 7) / 6.0 AS x, (p_partkey % 13) / 12.0 AS o, p_partkey % 3 = 0 AS ev FROM part),
s AS (SELECT *, c >= 0.75 AND x >= 0.75 AND o >= 0.75 AS fullc, ev AND x < 0.75 AS eo, lv = 'province' AND ot <> '' AS prov FROM t),
q AS (SELECT *, CASE WHEN prov AND fullc THEN 'province_fixed_effects_and_event_study_candidate' WHEN prov AND eo THEN 'province_event_cross_section_intensity'
  WHEN prov THEN 'province_descriptive_correlation_only' WHEN tier = 'tier_4' THEN 'remote_sensing_growth_anomaly_analysis'
  WHEN tier IN ('tier_1', 'tier_2') AND fullc THEN 'fixed_effects_and_event_study' WHEN eo THEN 'cross_section_event_intensity'
  WHEN tier IN ('tier_1', 'tier_2') AND c >= 0.5 THEN 'fixed_effects_with_exploratory_event_study' WHEN tier IN ('tier_1', 'tier_2', 'tier_3') THEN 'descriptive_correlation_only'
  ELSE 'legacy_or_unclassified_descriptive' END AS model_scope FROM s)
SELECT p_partkey, model_scope, model_scope IN ('province_fixed_effects_and_event_study_candidate', 'fixed_effects_and_event_study', 'fixed_effects_with_exploratory_event_study', 'legacy_or_unclassified_descriptive') AS run_event_study,
  CASE WHEN model_scope IN ('province_fixed_effects_and_event_study_candidate', 'fixed_effects_and_event_study', 'fixed_effects_with_exploratory_event_study', 'legacy_or_unclassified_descriptive')
    THEN 'impact_assessment' WHEN model_scope = 'remote_sensing_growth_anomaly_analysis' THEN 'descriptive' ELSE 'association' END AS conclusion_strength,
  CASE WHEN model_scope = 'province_event_cross_section_intensity' AND cr = 'grain' OR model_scope = 'cross_section_event_intensity' AND lv = 'province' AND cr = 'grain' THEN 'province_grain_event_cross_section'
    WHEN model_scope LIKE '%cross_section%' THEN 'chd_event_cross_section' WHEN model_scope = 'province_fixed_effects_and_event_study_candidate' THEN 'province_two_way_fixed_effects'
    WHEN model_scope = 'fixed_effects_and_event_study' THEN 'two_way_fixed_effects_candidate' ELSE 'descriptive_ols' END AS primary_model,
  CAST(2 AS BIGINT) AS gates_missing FROM q""")
def model_scope(spark, d):
    """Scope of many fact combinations (one per part) under the same gates."""
    k = F.col("p_partkey")
    facts = I.table(spark, d, "part").select(
        "p_partkey", choose(("tier_1", "tier_2", "tier_3", "tier_4", "unknown"), k).alias("tier"), choose(("province", "county"), F.floor(k / 5)).alias("admin_level"),
        choose(("grain", "rice"), F.floor(k / 10)).alias("crop_type"), choose(("province_grain_yield_anomaly", ""), F.floor(k / 20)).alias("outcome_type"),
        ((k % 11) / 10.0).alias("coverage_rate"), ((k % 7) / 6.0).alias("exposure_rate"), ((k % 13) / 12.0).alias("outcome_rate"), (k % 3 == 0).alias("has_event"))
    one = I.table(spark, d, "part").agg(F.lit(0.8).alias("c"), F.lit(0.95).alias("w"), F.count(F.lit(1)).alias("n"))
    overrides = I.table(spark, d, "region").select(
        choose(("pretrend_test_passed", "placebo_tests_passed", "", "extra_gate", "yield_panel_coverage_gte_0_75"), F.col("r_regionkey")).alias("gate"),
        choose(("passed", "yes", "no", "1", "TRUE"), F.col("r_regionkey")).alias("passed"))
    gates = Q.causal_gate(F.col("c"), F.col("w"), overrides, one)
    return Q.model_scope(facts, gates).select("p_partkey", "model_scope", "run_event_study", "conclusion_strength", "primary_model", "gates_missing")


# --- summaries ------------------------------------------------------------------------------

@query("crosswalk_rate", f"""
SELECT count(*) AS rows, count(*) FILTER (l_discount * 10 >= 0.85) AS high_confidence_rows, count(*) FILTER (l_discount * 10 < 0.85) AS low_confidence_rows,
  {R('count(*) FILTER (l_discount * 10 >= 0.85) / count(*)')} AS high_confidence_rate FROM lineitem""")
def crosswalk_rate(spark, d):
    rows = I.table(spark, d, "lineitem").select((F.col("l_discount") * 10).alias("match_confidence"))
    return show(Q.crosswalk_rate(rows), ["rows", "high_confidence_rows", "low_confidence_rows"], ["high_confidence_rate"])


@query("status_counts", "SELECT coalesce(CASE WHEN o_orderkey % 9 > 0 THEN o_orderstatus END, 'missing') AS status, count(*) AS rows FROM orders GROUP BY 1")
def status_counts(spark, d):
    rows = I.table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 9 > 0, F.col("o_orderstatus")).alias("s"))
    return Q.status_counts(rows, "s")


@query("duplicate_keys", """
WITH k AS (SELECT user_id, ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS analysis_rows, count(*) AS unique_key_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_key_rows FROM k""")
def duplicate_keys(spark, d):
    rows = I.table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_type")
    return Q.duplicate_keys(rows, ["user_id", "day", "event_type"])


@query("calibration_summary", with_sql(I.YIELDS, P.PROXY, P.CALIBRATED) + """
SELECT source, calibration_status, count(*) AS row_count, count(calibrated_yield) AS calibrated_yield_nonmissing FROM calibrated GROUP BY source, calibration_status""")
def calibration_summary(spark, d):
    return Q.calibration_summary(P.calibrated_panel(spark, d))


GRID_SQL = """grid AS (SELECT u.admin_id, y.year, CASE WHEN n > 0 THEN 'available' ELSE 'missing' END AS status FROM (SELECT c_custkey AS admin_id FROM customer) u
  CROSS JOIN (SELECT y AS year FROM range(1995, 2002) t(y)) y LEFT JOIN (SELECT o_custkey, year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY ALL) p ON p.o_custkey = u.admin_id AND p.year = y.year)"""


@query("proxy_coverage", with_sql(GRID_SQL) + """
SELECT count(*) FILTER (status = 'available') AS available_admin_year_cells, count(*) FILTER (status = 'missing') AS missing_admin_year_cells, count(DISTINCT admin_id) * 4 AS target_admin_year_cells,
  greatest(count(DISTINCT admin_id) * 4 - count(*) FILTER (status = 'available' AND year BETWEEN 1996 AND 1999), 0) AS missing_admin_year_cells_target FROM grid""")
def proxy_coverage(spark, d):
    units = I.table(spark, d, "customer").select(F.col("c_custkey").alias("admin_id"))
    panel = I.table(spark, d, "orders").select(F.col("o_custkey").alias("admin_id"), F.year("o_orderdate").alias("year"))
    return Q.proxy_coverage(J.coverage_grid(units, *I.YEARS, panel, "admin_id"), 1996, 1999)


AVAIL = [("rows", "count(*)"), ("main_rows", "count(*) FILTER (year BETWEEN 1996 AND 1999)"), ("year_min", "min(year)"), ("year_max", "max(year)"), ("outcome_nonmissing", "count(ndvi)"),
         ("exposure_nonmissing", "count(tmax)"), ("main_outcome_nonmissing", "count(ndvi) FILTER (year BETWEEN 1996 AND 1999)"), ("main_exposure_nonmissing", "count(tmax) FILTER (year BETWEEN 1996 AND 1999)")]


@query("panel_availability", with_sql(*MODEL_SQL) + metric_sql(AVAIL, "merged") + """
UNION ALL SELECT 'exposed_rows:' || year, CAST(count(*) AS DOUBLE) FROM merged WHERE tmax IS NOT NULL GROUP BY year""")
def panel_availability(spark, d):
    return Q.panel_availability(model(spark, d), "ndvi", "tmax", 1996, 1999)


@query("assignment_summary", """
WITH t AS (SELECT CASE CAST(c_custkey % 5 AS INTEGER) WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN '河北' ELSE 'Zone ' || c_nationkey END AS p FROM customer)
SELECT count(*) AS admin_units, count(*) FILTER (trim(p) <> '') AS province_matched, count(*) - count(*) FILTER (trim(p) <> '') AS province_unmatched,
  count(DISTINCT p) FILTER (regexp_matches(p, '[A-Za-z]')) AS non_chinese_province_names FROM t""")
def assignment_summary(spark, d):
    k = F.col("c_custkey") % 5
    name = F.when(k == 0, None).when(k == 1, " ").when(k == 2, "河北").otherwise(F.concat(F.lit("Zone "), F.col("c_nationkey").cast("string")))
    return Q.assignment_summary(I.table(spark, d, "customer").select(name.alias("province_name")), "province_name")


@query("coverage_summary", with_sql(GRID_SQL, *MODEL_SQL) + metric_sql([("admin_units", "count(*)"), ("admin_positive_balance", "count(*) FILTER (c_acctbal > 0)")], "customer")
       + " UNION ALL SELECT 'order_status:' || o_orderstatus, CAST(count(*) AS DOUBLE) FROM orders GROUP BY o_orderstatus UNION ALL "
       + metric_sql(AVAIL[:2], "merged").replace("'rows'", "'model_panel_rows'").replace("'main_rows'", "'model_panel_main_rows'") + " UNION ALL "
       + metric_sql([("available_admin_year_cells", "count(*) FILTER (status = 'available')"), ("missing_admin_year_cells", "count(*) FILTER (status = 'missing')")], "grid") + " UNION ALL "
       + metric_sql([("high_confidence_rate", R("count(*) FILTER (l_discount * 10 >= 0.85) / count(*)"))], "lineitem"))
def coverage_summary(spark, d):
    """One metric/value row per count, status and rate over the panels."""
    units = I.table(spark, d, "customer").agg(F.count(F.lit(1)).alias("admin_units"), F.count_if(F.col("c_acctbal") > 0).alias("admin_positive_balance"))
    status = Q.status_counts(I.table(spark, d, "orders"), "o_orderstatus").select(
        F.concat(F.lit("order_status:"), "status").alias("metric"), F.col("rows").cast("double").alias("value"))
    panel = model(spark, d).agg(F.count(F.lit(1)).alias("model_panel_rows"), F.count_if(F.col("year").between(1996, 1999)).alias("model_panel_main_rows"))
    cells = proxy_coverage(spark, d).select("available_admin_year_cells", "missing_admin_year_cells")
    rate = crosswalk_rate(spark, d).select("high_confidence_rate")
    out = Q.tall(units).unionByName(status)
    for part in (panel, cells, rate):
        out = out.unionByName(Q.tall(part))
    return out


@query("event_year_summary", f"""
SELECT event_type, 2024 AS year, count(*) AS row_count, count(DISTINCT user_id) AS admin_unit_count, {R('avg(value)')} AS mean, {R('min(value)')} AS "min", {R('max(value)')} AS "max" FROM events GROUP BY event_type""")
def event_year_summary(spark, d):
    rows = I.table(spark, d, "events").withColumn("year", F.year("ts"))
    return show(Q.event_year_summary(rows, 2024, "event_type", "user_id", "value"), ["event_type", "year", "row_count", "admin_unit_count"], ["mean", "min", "max"])


@query("sample_flow", with_sql(*MODEL_SQL) + metric_sql([("model_panel_rows", "count(*)"), ("year_min", "min(year)"), ("year_max", "max(year)"), ("province_count", "count(DISTINCT province)"),
  ("yield_anomaly_nonmissing", "count(ndvi)"), ("exposure_nonmissing", "count(coalesce(tmax, precipitation_remote))"), ("complete_model_rows", "count(coalesce(tmax, precipitation_remote)) FILTER (ndvi IS NOT NULL)")], "merged")
  + " UNION ALL " + metric_sql([("annual_exposure_rows", "count(*)"), ("annual_exposure_nonmissing", "count(tmax)")], "climate"))
def sample_flow(spark, d):
    return Q.sample_flow(model(spark, d), "ndvi", ["tmax", "precipitation_remote"], I.climate_source(spark, d), "tmax")


@query("artifact_summary", with_sql(*MODEL_SQL) + "SELECT 'climate' AS artifact, * FROM ("
  + metric_sql([("rows", "count(*)"), ("columns", "max(4)"), ("year_min", "min(year)"), ("year_max", "max(year)"), ("province_count", "count(DISTINCT province)"), ("nonmissing:tmax", "count(tmax)")], "climate")
  + ") UNION ALL SELECT 'model', * FROM (" + metric_sql([("rows", "count(*)"), ("columns", "max(6)"), ("year_min", "min(year)"), ("year_max", "max(year)"), ("province_count", "count(DISTINCT province)"), ("nonmissing:ndvi", "count(ndvi)")], "merged")
  + ") UNION ALL SELECT 'orders', * FROM (" + metric_sql([("rows", "count(*)"), ("columns", "max(6)"), ("nonmissing:o_totalprice", "count(o_totalprice)")], "orders") + ")")
def artifact_summary(spark, d):
    tables = {"climate": I.climate_source(spark, d), "model": model(spark, d), "orders": I.table(spark, d, "orders")}
    return Q.artifact_summary(tables, {"climate": ["tmax"], "model": ["ndvi"], "orders": ["o_totalprice"]})


@query("value_counts", "SELECT trim(p_type) AS value, count(*) AS rows FROM part GROUP BY 1 ORDER BY rows DESC, value LIMIT 30")
def value_counts(spark, d):
    return Q.value_counts(I.table(spark, d, "part"), "p_type", 30)


@query("numeric_summary", f"SELECT count(value) AS count, {R('avg(value)')} AS mean, {R('min(value)')} AS \"min\", {R('max(value)')} AS \"max\" FROM events")
def numeric_summary(spark, d):
    return show(Q.numeric_summary(I.table(spark, d, "events"), "value"), ["count"], ["mean", "min", "max"])


TREAT_IN = "tt AS (SELECT o_custkey, avg(CAST(round(o_totalprice * 100) AS BIGINT)) AS s, bool_or(o_orderpriority = '1-URGENT') AS f FROM orders WHERE year(o_orderdate) = 2000 GROUP BY o_custkey)"


@query("treatment_counts", with_sql(TREAT_IN) + """
SELECT 'flag' AS basis, count(*) FILTER (f) AS treated, count(*) FILTER (NOT f) AS control FROM tt
UNION ALL SELECT 'score', count(*) FILTER (s >= (SELECT quantile_cont(s, 0.75) FROM tt)), count(*) FILTER (s < (SELECT quantile_cont(s, 0.75) FROM tt)) FROM tt""")
def treatment_counts(spark, d):
    rows = I.table(spark, d, "orders").select(
        "o_custkey", F.year("o_orderdate").alias("year"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("score"), (F.col("o_orderpriority") == "1-URGENT").alias("f"))
    by_flag = T.treatment_counts(rows, "o_custkey", I.EVENT_YEAR, "f").select(F.lit("flag").alias("basis"), "treated", "control")
    return by_flag.unionByName(T.treatment_counts(rows, "o_custkey", I.EVENT_YEAR, score="score").select(F.lit("score").alias("basis"), "treated", "control"))


@query("missing_year_share", f"""
WITH a AS (SELECT y FROM range(1990, 2006) t(y) WHERE y NOT IN (SELECT DISTINCT year(o_orderdate) FROM orders))
SELECT count(*) AS missing_years, {R('count(*) FILTER (y IN (1991, 1998, 2000)) / count(*)')} AS share FROM a""")
def missing_year_share(spark, d):
    rows = I.table(spark, d, "orders").select(F.year("o_orderdate").alias("year"))
    return show(Q.missing_year_share(rows, 1990, 2005, [1991, 1998, 2000]), ["missing_years"], ["share"])


@query("pretrend_test", """
SELECT bool_and(CASE WHEN s > 0 THEN abs(b) <= 1.96 * s ELSE abs(b) <= 0.1 END) AS passed FROM (
  SELECT l_discount AS b, CASE WHEN l_linenumber % 2 = 0 THEN 0.06 ELSE 0 END AS s FROM lineitem WHERE l_linenumber <= 3)""")
def pretrend_test(spark, d):
    n = F.col("l_linenumber")
    terms = I.table(spark, d, "lineitem").select(
        F.when(n <= 3, F.concat(F.lit("event_time_m"), n.cast("string"))).otherwise("event_time_p1").alias("term"),
        F.col("l_discount").alias("estimate"), F.when(n % 2 == 0, 0.06).otherwise(0.0).alias("standard_error"))
    return Q.pretrend_test(terms)


@query("top_exposure", with_sql(I.CLIMATE) + f"SELECT province, year, {R('tmax')} AS tmax FROM climate ORDER BY climate.tmax DESC NULLS LAST, province, year LIMIT 5")
def top_exposure(spark, d):
    return show(Q.top_rows(I.climate_source(spark, d), "tmax", 5, ["province", "year"]), ["province", "year"], ["tmax"])


@query("bottom_anomaly", with_sql(*MODEL_SQL) + "SELECT province, year, ndvi FROM merged ORDER BY ndvi ASC NULLS LAST, province, year LIMIT 7")
def bottom_anomaly(spark, d):
    return Q.top_rows(model(spark, d), "ndvi", 7, ["province", "year"], largest=False).select("province", "year", "ndvi")


COEF_TERMS, COEF_MODELS = ("x", "exposure_index", "chd_event_intensity", "chd_annual"), ("other", "descriptive_ols", "province_two_way_fixed_effects")


@query("main_coefficient", f"""
WITH t AS (SELECT p_partkey, {choose_sql(COEF_MODELS, 'p_partkey')} AS model, {choose_sql(COEF_TERMS, 'p_size')} AS term, p_retailprice AS estimate FROM part)
SELECT p_partkey, model, term, estimate FROM t WHERE term <> 'x' ORDER BY CASE model WHEN 'province_two_way_fixed_effects' THEN 0 WHEN 'descriptive_ols' THEN 1 ELSE 99 END,
  CASE term WHEN 'chd_annual' THEN 0 WHEN 'chd_event_intensity' THEN 1 ELSE 2 END, p_partkey LIMIT 1""")
def main_coefficient(spark, d):
    rows = I.table(spark, d, "part").select(
        "p_partkey", choose(COEF_MODELS, F.col("p_partkey")).alias("model"), choose(COEF_TERMS, F.col("p_size")).alias("term"), F.col("p_retailprice").alias("estimate"))
    return Q.main_coefficient(rows, ["p_partkey"])


@query("project_summary", with_sql(*MODEL_SQL, GRID_SQL) + "SELECT 'admin' AS section, * FROM (" + metric_sql([("rows", "count(*)"), ("positive_rows", "count(*) FILTER (c_acctbal > 0)")], "customer")
  + ") UNION ALL SELECT 'yield', * FROM (" + metric_sql([("rows", "count(*)"), ("year_min", "min(year)"), ("year_max", "max(year)"), ("area_sum", "sum(area_hectare)"), ("unit_count", "count(DISTINCT province)")], "yields")
  + ") UNION ALL SELECT 'yield', 'crop:' || crop, CAST(count(*) AS DOUBLE) FROM yields GROUP BY crop UNION ALL SELECT 'model', * FROM ("
  + metric_sql([("rows", "count(*)"), ("outcome_nonmissing", "count(ndvi)"), ("exposure_nonmissing", "count(tmax)"), ("exposure_target_rate", R("count(tmax) / (count(DISTINCT province) * 7)")),
                ("event_rows", "count(*) FILTER (year = 2000)"), ("event_exposure_mean", R("avg(tmax) FILTER (year = 2000)")), ("event_exposure_max", R("max(tmax) FILTER (year = 2000)"))], "merged")
  + ") UNION ALL SELECT 'proxy', * FROM (" + metric_sql([("available_cells", "count(*) FILTER (status = 'available')"), ("missing_cells", "count(*) FILTER (status <> 'available')")], "grid") + ")")
def project_summary(spark, d):
    """Project-wide metric table: one aggregate per table, union of small results."""
    y, m = I.yields(spark, d), model(spark, d)
    event = F.col("year") == I.EVENT_YEAR
    parts = [
        Q.tall(I.table(spark, d, "customer").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("c_acctbal") > 0).alias("positive_rows")), "admin"),
        Q.tall(y.agg(F.count(F.lit(1)).alias("rows"), F.min("year").alias("year_min"), F.max("year").alias("year_max"),
                     F.sum("area_hectare").alias("area_sum"), F.count_distinct("province").alias("unit_count")), "yield"),
        Q.value_counts(y, "crop", None).select(F.lit("yield").alias("section"), F.concat(F.lit("crop:"), "value").alias("metric"), F.col("rows").cast("double").alias("value")),
        Q.tall(m.agg(
            F.count(F.lit(1)).alias("rows"), F.count("ndvi").alias("outcome_nonmissing"), F.count("tmax").alias("exposure_nonmissing"),
            rounded(F.count("tmax") / (F.count_distinct("province") * 7)).alias("exposure_target_rate"), F.count_if(event).alias("event_rows"),
            rounded(F.avg(F.when(event, F.col("tmax")))).alias("event_exposure_mean"), rounded(F.max(F.when(event, F.col("tmax")))).alias("event_exposure_max")), "model"),
        Q.tall(proxy_coverage(spark, d).select(F.col("available_admin_year_cells").alias("available_cells"), F.col("missing_admin_year_cells").alias("missing_cells")), "proxy"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("model_audit", with_sql(I.YIELDS, I.UNIT_YIELDS, P.OUTCOME, I.CLIMATE, """p AS (SELECT a.province, a.year, yield_anomaly_pct AS y, tmax AS x FROM anomalies a JOIN climate c ON a.province = c.province AND a.year = c.year)""",
  "o AS (SELECT regr_slope(y, x) AS b, count(*) AS n, regr_r2(y, x) AS r2 FROM p)", "s AS (SELECT province, avg(x) AS s FROM p WHERE year = 2000 GROUP BY province)",
  "cut AS (SELECT quantile_cont(s, 0.75) AS c FROM s)") + """
SELECT 'has_descriptive_ols' AS "check", 'passed' AS status, 'True' AS value, '' AS notes
UNION ALL SELECT 'has_province_two_way_fixed_effects', 'failed', 'False', ''
UNION ALL SELECT 'has_event_study_candidate', 'failed', 'False', ''
UNION ALL SELECT 'chd_annual_coefficient', 'info', '', 'unavailable' UNION ALL SELECT 'chd_annual_p_value', 'info', '', 'unavailable'
UNION ALL SELECT 'sample_size', 'info', '', '' UNION ALL SELECT 'r2', 'info', '', '' UNION ALL SELECT 'adjusted_r2', 'info', '', ''
UNION ALL SELECT 'contains_province_fe', 'failed', 'False', '' UNION ALL SELECT 'contains_year_fe', 'failed', 'False', ''
UNION ALL SELECT 'pretrend_test_passed', 'failed', 'False', ''
UNION ALL SELECT 'treated_province_count', 'info', CAST(count(*) FILTER (s >= c) AS VARCHAR), '' FROM s, cut
UNION ALL SELECT 'control_province_count', 'info', CAST(count(*) FILTER (s < c) AS VARCHAR), '' FROM s, cut
UNION ALL SELECT 'missing_rows_concentrated_in_watched_years', 'info', CAST(CAST(round((SELECT count(*) FILTER (y IN (1994, 2002)) / count(*) FROM range(1990, 2006) t(y)
   WHERE y NOT IN (SELECT DISTINCT year FROM p)), 6) AS DECIMAL(20,6)) AS VARCHAR), ''""")
def model_audit(spark, d):
    """Audit of a run that stopped at plain least squares; tests cover a full run."""
    climate = I.climate_source(spark, d).select("province", "year", F.col("tmax").alias("x"))
    outcome = P.outcome_panel(spark, d).select("province", "year", F.col("yield_anomaly_pct").alias("y"))
    panel = C.event_intensity(outcome.join(climate, ["province", "year"]), "province", "x", I.EVENT_YEAR, "score")
    treated = T.assign_treatment(panel, "x", "province", I.EVENT_YEAR, 0.75, "treated")
    coefficients = spark.createDataFrame(M.coefficient_rows("descriptive_ols", M.fit_ols(panel, "y", ["x"])), M.COEFFICIENT_SCHEMA)
    return Q.model_audit(coefficients, coefficients, treated, "province", I.EVENT_YEAR, "treated", (1990, 2005), (1994, 2002))
