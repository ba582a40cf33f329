"""Treatment, least squares, fixed effects, event study and robustness queries.

The fixed-effects oracles use the closed forms of a balanced panel (double demeaning,
differences of group means); unbalanced panels are checked against dense dummies in tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldframe.functions.numbers import rounded
from fieldframe.operators import models as M
from fieldframe.operators import projection as J
from fieldframe.operators import quality as Q
from fieldframe.operators import robustness as B
from fieldframe.operators import treatment as T
from fieldframe.plans import inputs as I
from fieldframe.plans.climate_queries import annual_panel
from fieldframe.plans.inputs import R, with_sql
from fieldframe.plans.panel_queries import OUTCOME, model_panel_frame, outcome_panel, show, show_sql
from fieldframe.plans.registry import query
from fieldframe.session import materialize

PANEL = """fe AS (SELECT a.province, a.year, yield_anomaly_pct AS y, CAST(t.chd_annual AS DOUBLE) AS x, CAST(t.hot_days AS DOUBLE) AS h FROM anomalies a
  JOIN treated t ON a.province = t.province AND a.year = t.year)"""
FE_CHAIN = (*I.CHD_CHAIN, I.YIELDS, I.UNIT_YIELDS, OUTCOME, PANEL)


def fe_panel(spark, d, daily=None):
    """All-crop yield anomaly and annual exposure per unit and year."""
    exposure = annual_panel(spark, d, daily).select("province", "year", F.col("chd_annual").cast("double").alias("x"),
                                              F.col("hot_days").cast("double").alias("h"))
    outcome = outcome_panel(spark, d).select("province", "year", F.col("yield_anomaly_pct").alias("y"))
    return materialize(outcome.join(exposure, ["province", "year"]), "fe-panel")


@query("assign_treatment", with_sql(*FE_CHAIN) + """,
sc AS (SELECT province, avg(h) AS s FROM fe WHERE year = 2000 GROUP BY province)
SELECT fe.province, fe.year, CAST(coalesce(s >= (SELECT quantile_cont(s, 0.5) FROM sc), false) AS BIGINT) AS treatment
FROM fe LEFT JOIN sc ON fe.province = sc.province""")
def assign_treatment(spark, d):
    return T.assign_treatment(fe_panel(spark, d), "h", "province", I.EVENT_YEAR, 0.5).select("province", "year", "treatment")


TERMS = [T.term_name(o) for o in range(-2, 3)]


@query("event_study_terms", f"""
SELECT o_orderkey, CAST(year(o_orderdate) - 2000 AS BIGINT) AS event_time,
  {', '.join(f"CAST(o_orderpriority = '1-URGENT' AND year(o_orderdate) - 2000 = {o} AS BIGINT) AS {T.term_name(o)}" for o in range(-2, 3))} FROM orders""")
def event_study_terms(spark, d):
    rows = I.table(spark, d, "orders").select(
        "o_orderkey", F.year("o_orderdate").alias("year"), (F.col("o_orderpriority") == "1-URGENT").alias("treatment"))
    return T.event_study_terms(rows, "treatment", I.EVENT_YEAR, 2).select("o_orderkey", "event_time", *TERMS)


OLS_SQL = with_sql("t AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, round(l_discount * 100) + l_quantity % 7 AS y FROM lineitem WHERE l_linenumber <> 3)",
                   "f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2, count(*) AS n FROM t)")


def _ols_rows(spark, d):
    return I.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("x"),
        (F.round(F.col("l_discount") * 100) + F.col("l_quantity") % 7).alias("y"))


@query("ols_simple", OLS_SQL + f"""
SELECT 'intercept' AS term, {R('a')} AS estimate, n AS n_obs, {R('r2')} AS r2, {R('1 - (1 - r2) * (n - 1) / (n - 2)')} AS adjusted_r2 FROM f
UNION ALL SELECT 'x', {R('b')}, n, {R('r2')}, {R('1 - (1 - r2) * (n - 1) / (n - 2)')} FROM f""")
def ols_simple(spark, d):
    fit = M.fit_ols(_ols_rows(spark, d), "y", ["x"])
    rows = spark.createDataFrame(M.coefficient_rows("ols", fit), M.COEFFICIENT_SCHEMA)
    return show(rows, ["term", "n_obs"], ["estimate", "r2", "adjusted_r2"])


@query("ols_predictions", OLS_SQL + f"""
SELECT l_orderkey, l_linenumber, y AS observed, {R('a + b * x')} AS prediction, {R('y - (a + b * x)')} AS residual FROM t, f""")
def ols_predictions(spark, d):
    rows = _ols_rows(spark, d)
    out = M.ols_predictions(rows, "y", M.fit_ols(rows, "y", ["x"]))
    return show(out, ["l_orderkey", "l_linenumber", "observed"], ["prediction", "residual"])


def balanced_fe_sql(source: str, tag: str) -> list[str]:
    """Closed form of the two-way model on a balanced panel: double demeaning."""
    return [
        f"dm{tag} AS (SELECT y, x - avg(x) OVER (PARTITION BY province) - avg(x) OVER (PARTITION BY year) + avg(x) OVER () AS xd,"
        f" y - avg(y) OVER (PARTITION BY province) - avg(y) OVER (PARTITION BY year) + avg(y) OVER () AS yd,"
        f" province, year FROM {source})",
        f"fit{tag} AS (SELECT count(*) AS n, sum(xd * yd) / sum(xd * xd) AS b, sum(yd * yd) - sum(xd * yd) * sum(xd * yd) / sum(xd * xd) AS ssr,"
        f" sum(xd * xd) AS sxx, var_pop(y) * count(*) AS tss, count(*) - count(DISTINCT province) - count(DISTINCT year) AS df FROM dm{tag})",
    ]


@query("two_way_fe", with_sql(*FE_CHAIN, *balanced_fe_sql("fe", "0")) + f"""
SELECT 'x' AS term, {R('b')} AS estimate, {R('sqrt(ssr / df / sxx)')} AS standard_error, n AS n_obs, df, {R('1 - ssr / tss')} AS r2,
  {R('1 - ssr / tss * (n - 1) / df')} AS adjusted_r2 FROM fit0""")
def two_way_fe(spark, d):
    fit = M.fit_two_way(fe_panel(spark, d), "y", ["x"])
    rows = spark.createDataFrame(M.coefficient_rows("two_way_fixed_effects", fit), M.COEFFICIENT_SCHEMA)
    return show(rows, ["term", "n_obs", "df"], ["estimate", "standard_error", "r2", "adjusted_r2"])


@query("two_way_fe_alternating", with_sql(*FE_CHAIN, *balanced_fe_sql("fe", "0")) + f"""
SELECT 'x' AS term, {R('b')} AS estimate, {R('sqrt(ssr / df / sxx)')} AS standard_error, n AS n_obs, df, {R('1 - ssr / tss')} AS r2,
  {R('1 - ssr / tss * (n - 1) / df')} AS adjusted_r2 FROM fit0""")
def two_way_fe_alternating(spark, d):
    """The same model by means taken out in turn; tests compare both ways on unbalanced panels."""
    fit = J.fit_two_way_alternating(fe_panel(spark, d), "y", ["x"])
    rows = spark.createDataFrame(M.coefficient_rows("two_way_fixed_effects", fit), M.COEFFICIENT_SCHEMA)
    return show(rows, ["term", "n_obs", "df"], ["estimate", "standard_error", "r2", "adjusted_r2"])


DID = """sc AS (SELECT province, avg(h) AS s FROM fe WHERE year = 2000 GROUP BY province),
tr AS (SELECT fe.*, CAST(s >= (SELECT quantile_cont(s, 0.5) FROM sc) AS BIGINT) AS t FROM fe JOIN sc ON fe.province = sc.province),
mean AS (SELECT year, avg(y) FILTER (t = 1) AS m1, avg(y) FILTER (t = 0) AS m0 FROM tr GROUP BY year)"""
_TERM_SQL = "CASE WHEN year < 2000 THEN 'event_time_m' || (2000 - year) WHEN year = 2000 THEN 'event_time_0' ELSE 'event_time_p' || (year - 2000) END"


@query("event_study_fe", with_sql(*FE_CHAIN, DID) + f"""
SELECT {_TERM_SQL} AS term, {R('m1 - m0 - (SELECT m1 - m0 FROM mean WHERE year = 1999)')} AS estimate, (SELECT count(*) FROM fe) AS n_obs
FROM mean WHERE year <> 1999""")
def event_study_fe(spark, d):
    fit = M.event_study_fe(fe_panel(spark, d), "y", "h", "province", I.EVENT_YEAR, 0.5, 5)
    return show(spark.createDataFrame(M.coefficient_rows("event_study", fit), M.COEFFICIENT_SCHEMA), ["term", "n_obs"], ["estimate"])


@query("event_study_ols", with_sql(*FE_CHAIN, DID) + f"""
SELECT 'intercept' AS term, {R('avg(y) FILTER (t = 0 OR abs(year - 2000) > 2)')} AS estimate, count(*) AS n_obs FROM tr
UNION ALL SELECT {_TERM_SQL}, {R('m1 - (SELECT avg(y) FROM tr WHERE t = 0 OR abs(year - 2000) > 2)')}, (SELECT count(*) FROM fe)
FROM mean WHERE abs(year - 2000) <= 2""")
def event_study_ols(spark, d):
    fit = M.event_study_ols(fe_panel(spark, d), "y", "h", "province", I.EVENT_YEAR, 0.5, 2)
    return show(spark.createDataFrame(M.coefficient_rows("event_study_ols", fit), M.COEFFICIENT_SCHEMA), ["term", "n_obs"], ["estimate"])


HIGHLIGHTED = [str(i) for i in range(12)]


def _variant_sql(tag, heat, dry, months):
    return [
        f"th{tag} AS (SELECT province, month, quantile_cont(tmax_c, {heat}) AS h, quantile_cont(rolling30_precip_mm, {dry}) AS p FROM rolled"
        f" WHERE year BETWEEN 1995 AND 1999 GROUP BY province, month)",
        f"va{tag} AS (SELECT r.province, r.year, CAST(count(*) FILTER (coalesce(tmax_c > h AND rolling30_precip_mm < p, false)) AS DOUBLE) AS x"
        f" FROM rolled r LEFT JOIN th{tag} t ON r.province = t.province AND r.month = t.month WHERE r.month IN {months} GROUP BY r.province, r.year)",
        f"vp{tag} AS (SELECT a.province, a.year, yield_anomaly_pct AS y, v.x FROM anomalies a JOIN va{tag} v ON a.province = v.province AND a.year = v.year)",
        *balanced_fe_sql(f"vp{tag}", tag),
    ]


def _robustness_sql():
    variants = [
        ("heat_p90_drought_p10", 0.9, 0.1, "(6, 7, 8, 9)"), ("heat_p95_drought_p10", 0.95, 0.1, "(6, 7, 8, 9)"),
        ("heat_p90_drought_p20", 0.9, 0.2, "(6, 7, 8, 9)"), ("growth_months_6_9", 0.9, 0.1, "(6, 7, 8, 9)"),
        ("growth_months_7_9", 0.9, 0.1, "(7, 8, 9)"), ("growth_months_6_8", 0.9, 0.1, "(6, 7, 8)"),
    ]
    samples = [("exclude_backfill", "fe WHERE year <> 1996"), ("highlighted_region_only", "fe WHERE CAST(province AS INTEGER) < 12"), ("national_control", "fe")]
    ctes, names = [*FE_CHAIN], []
    for i, (name, heat, dry, months) in enumerate(variants, start=1):
        ctes += _variant_sql(str(i), heat, dry, months)
        names.append((name, i))
    for i, (name, source) in enumerate(samples, start=len(variants) + 1):
        ctes += balanced_fe_sql(f"(SELECT * FROM {source})", str(i))
        names.append((name, i))
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS spec_id, n AS sample_size, {R('b')} AS chd_coefficient, {R('sqrt(ssr / df / sxx)')} AS standard_error,"
        f" CASE WHEN b < 0 THEN 'negative' WHEN b > 0 THEN 'positive' ELSE 'zero' END AS direction FROM fit{i}" for name, i in names)
    return with_sql(*ctes) + rows


def robustness_frame(spark, d):
    """All variants as result rows; coverage is the share of unit-year cells that have a value."""
    daily = materialize(I.daily(spark, d), "daily")  # read by the panel and by the variants
    panel = fe_panel(spark, d, daily).withColumnRenamed("x", "chd_annual").withColumn("is_backfill", F.col("year") == 1996)
    specs = B.standard_specs(I.SETTINGS)
    fits = B.robustness_fits(panel, daily, I.SETTINGS, HIGHLIGHTED, "y", specs=specs)
    units = panel.agg(F.count_distinct("province")).first()[0]
    years = I.YEARS[1] - I.YEARS[0] + 1
    covered = {s.name: fits[s.name].n >= 0.75 * years * (len(HIGHLIGHTED) if s.highlighted else units) for s in specs if s.name in fits}
    return spark.createDataFrame(B.spec_rows(fits, specs, covered), B.SPEC_SCHEMA)


@query("robustness_suite", _robustness_sql())
def robustness_suite(spark, d):
    return show(robustness_frame(spark, d), ["spec_id", "sample_size", "direction"], ["chd_coefficient", "standard_error"])


@query("event_cross_section", with_sql(*FE_CHAIN) + f"""
SELECT province, {R('y')} AS yield_anomaly_pct, x AS chd_annual FROM fe WHERE year = 2000""")
def event_cross_section(spark, d):
    rows = M.rows_for_scope(fe_panel(spark, d), "province_event_cross_section_intensity", I.EVENT_YEAR)
    return M.complete_cases(rows, ["y", "x"]).select("province", rounded("y").alias("yield_anomaly_pct"), F.col("x").alias("chd_annual"))


@query("model_coefficients")
def model_coefficients(spark, d):
    """Model panel to the coefficient table of all models (p values have no SQL form)."""
    panel = materialize(model_panel_frame(spark, d), "model-panel")
    y, x = "yield_anomaly_pct", "chd_annual"
    rows = M.coefficient_rows("descriptive_ols", M.fit_ols(panel, y, [x]))
    rows += M.coefficient_rows("province_two_way_fixed_effects", M.fit_two_way(panel, y, [x]))
    rows += M.coefficient_rows("event_study_candidate", M.event_study_fe(panel, y, "tmax_anomaly", "province", I.EVENT_YEAR, 0.5, 3))
    return spark.createDataFrame(rows, M.COEFFICIENT_SCHEMA)


_SHOWN = "CAST(CAST(round({0}, 6) AS DECIMAL(20,6)) AS VARCHAR)"
#: Student's t by Simpson's rule from 0 to |t|, and the saturated event study's errors on a balanced panel.
AUDIT = """tt AS (SELECT abs(b / sqrt(ssr / df / sxx)) AS t, df FROM fit0),
pv AS (SELECT 1 - 2 * max(t) / 12000 * max(exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(df * pi()))
  * sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(1 + pow(t * i / 4000, 2) / df, -(df + 1) / 2.0)) AS p FROM tt, range(0, 4001) r(i)),
left_over AS (SELECT y - avg(y) OVER (PARTITION BY province) - avg(y) OVER (PARTITION BY t, year) + avg(y) OVER (PARTITION BY t) AS e, province, year, t FROM tr),
noise AS (SELECT sqrt(sum(e * e) / (count(*) - count(DISTINCT province) - 2 * (count(DISTINCT year) - 1))
  * 2 * (1.0 / count(DISTINCT province) FILTER (t = 1) + 1.0 / count(DISTINCT province) FILTER (t = 0))) AS se FROM left_over),
trend AS (SELECT bool_and(abs(m1 - m0 - (SELECT m1 - m0 FROM mean WHERE year = 1999)) <= 1.96 * se) AS ok FROM mean, noise WHERE year < 1999),
sides AS (SELECT count(*) FILTER (t = 1) AS treated, count(*) FILTER (t = 0) AS control FROM tr WHERE year = 2000)"""


@query("model_audit_full", with_sql(*FE_CHAIN, *balanced_fe_sql("fe", "0"), DID, AUDIT) + f"""
SELECT 'has_descriptive_ols' AS "check", 'passed' AS status, 'True' AS value, '' AS notes
UNION ALL SELECT 'has_province_two_way_fixed_effects', CASE WHEN n > 0 THEN 'passed' ELSE 'failed' END, CASE WHEN n > 0 THEN 'True' ELSE 'False' END, '' FROM fit0
UNION ALL SELECT 'has_event_study_candidate', CASE WHEN treated > 0 AND control > 0 THEN 'passed' ELSE 'failed' END, CASE WHEN treated > 0 AND control > 0 THEN 'True' ELSE 'False' END, '' FROM sides
UNION ALL SELECT 'chd_annual_coefficient', 'info', {_SHOWN.format('b')}, CASE WHEN b < 0 THEN 'negative' WHEN b > 0 THEN 'positive' ELSE 'zero' END FROM fit0
UNION ALL SELECT 'chd_annual_p_value', 'info', {_SHOWN.format('p')}, CASE WHEN p < 0.05 THEN 'significant_at_5pct' WHEN p < 0.1 THEN 'significant_at_10pct' ELSE 'not_significant' END FROM pv
UNION ALL SELECT 'sample_size', 'info', CAST(n AS VARCHAR), '' FROM fit0
UNION ALL SELECT 'r2', 'info', {_SHOWN.format('1 - ssr / tss')}, '' FROM fit0
UNION ALL SELECT 'adjusted_r2', 'info', {_SHOWN.format('1 - ssr / tss * (n - 1) / df')}, '' FROM fit0
UNION ALL SELECT 'contains_province_fe', CASE WHEN count(DISTINCT province) > 1 THEN 'passed' ELSE 'failed' END, CASE WHEN count(DISTINCT province) > 1 THEN 'True' ELSE 'False' END, '' FROM fe
UNION ALL SELECT 'contains_year_fe', CASE WHEN count(DISTINCT year) > 1 THEN 'passed' ELSE 'failed' END, CASE WHEN count(DISTINCT year) > 1 THEN 'True' ELSE 'False' END, '' FROM fe
UNION ALL SELECT 'pretrend_test_passed', CASE WHEN ok THEN 'passed' ELSE 'failed' END, CASE WHEN ok THEN 'True' ELSE 'False' END, '' FROM trend
UNION ALL SELECT 'treated_province_count', 'info', CAST(treated AS VARCHAR), '' FROM sides
UNION ALL SELECT 'control_province_count', 'info', CAST(control AS VARCHAR), '' FROM sides
UNION ALL SELECT 'missing_rows_concentrated_in_watched_years', 'info', (SELECT {_SHOWN.format('count(*) FILTER (y IN (1994, 2002)) / count(*)')} FROM range(1990, 2006) t(y)
   WHERE y NOT IN (SELECT DISTINCT year FROM fe)), ''""")
def model_audit_full(spark, d):
    """Audit of a whole run: least squares, fixed effects with p value, event study with its pre-trend."""
    panel = materialize(T.assign_treatment(fe_panel(spark, d).withColumnRenamed("x", "chd_annual"), "h", "province", I.EVENT_YEAR, 0.5, "treated"), "audit-panel")
    rows = M.coefficient_rows("descriptive_ols", M.fit_ols(panel, "y", ["chd_annual"]))
    rows += M.coefficient_rows("province_two_way_fixed_effects", M.fit_two_way(panel, "y", ["chd_annual"]))
    events = M.coefficient_rows("event_study_candidate", M.event_study_fe(panel, "y", "h", "province", I.EVENT_YEAR, 0.5, 5))
    tables = [spark.createDataFrame(r, M.COEFFICIENT_SCHEMA) for r in (rows, events)]
    return Q.model_audit(*tables, panel, "province", I.EVENT_YEAR, "treated", (1990, 2005), (1994, 2002))
