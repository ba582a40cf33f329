"""Code validity, succession and crosswalk queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldframe.functions.numbers import rounded
from fieldframe.functions.text import code_list
from fieldframe.operators import crosswalk as K
from fieldframe.plans import inputs as I
from fieldframe.plans.clean_queries import choose, choose_sql
from fieldframe.plans.inputs import R, with_sql
from fieldframe.plans.registry import query

TARGET = 2000
RECORDS = """records AS (SELECT p_partkey AS code, CAST(1981 + p_partkey % 40 AS INTEGER) AS start_year,
  CASE WHEN p_partkey % 25 > 0 THEN CAST(1981 + p_partkey % 40 + p_partkey % 25 AS INTEGER) END AS end_year,
  CASE WHEN p_partkey % 20 = 4 THEN [p_partkey // 3, p_partkey // 5] WHEN p_partkey % 4 = 0 THEN [p_partkey // 3] ELSE CAST([] AS BIGINT[]) END AS new_codes FROM part)"""
ACTIVE = "start_year <= {y} AND (end_year IS NULL OR {y} < end_year)"


def records(spark, d):
    """One validity record per part; parts divisible by four have successors."""
    k = F.col("p_partkey")
    none = F.array().cast("array<bigint>")
    start = (k % 40 + 1981).cast("int")
    third, fifth = F.floor(k / 3).cast("bigint"), F.floor(k / 5).cast("bigint")
    successors = F.when(k % 20 == 4, F.array(third, fifth)).when(k % 4 == 0, F.array(third)).otherwise(none)
    return I.table(spark, d, "part").select(
        k.alias("code"), start.alias("start_year"), F.when(k % 25 > 0, start + (k % 25).cast("int")).alias("end_year"), successors.alias("new_codes"))


WALK = f"""st AS (SELECT code, new_codes, {ACTIVE.format(y=TARGET)} AS act FROM records),
walk AS (WITH RECURSIVE w AS (
    SELECT code, code AS cur, [code] AS path, CAST([] AS INTEGER[]) AS ord, act OR len(new_codes) = 0 AS done, new_codes FROM st
    UNION ALL
    SELECT w.code, s.code, list_append(path, s.code), list_append(ord, CAST(i AS INTEGER)), s.act OR len(s.new_codes) = 0 OR list_contains(path, s.code), s.new_codes
    FROM w, range(0, 2) t(i), st s WHERE NOT done AND i < len(w.new_codes) AND s.code = w.new_codes[i + 1])
  SELECT code, cur, min(ord) AS ord FROM w WHERE done GROUP BY code, cur),
standard AS (SELECT code, list(cur ORDER BY ord) AS codes FROM walk GROUP BY code)"""


@query("resolve_succession", with_sql(RECORDS, WALK) + "SELECT code, array_to_string(codes, ';') AS admin_code_standard FROM standard")
def resolve_succession(spark, d):
    return K.standard_codes(K.resolve_succession(records(spark, d), TARGET)).select("code", "admin_code_standard")


METHOD = f"""CASE WHEN len(codes) = 1 AND codes[1] = r.code AND r.start_year <= {TARGET} AND (r.end_year IS NULL OR {TARGET} < r.end_year) THEN {{0}} WHEN len(codes) = 1 AND codes[1] <> r.code THEN {{1}}
  WHEN len(codes) > 1 THEN {{2}} WHEN r.start_year > {TARGET} THEN {{3}} ELSE {{4}} END"""
METHODS = METHOD.format("'target_boundary_exact_code'", "'target_boundary_explicit_new_code_chain'", "'target_boundary_many_to_many_new_code_chain'",
                        "'future_record_after_target_boundary'", "'unresolved_to_target_boundary'")
VALUES = METHOD.format("1.0", "0.95", "0.75", "0.7", "0.6")


@query("succession_confidence", with_sql(RECORDS, WALK) + f"""
SELECT r.code, {METHODS} AS match_method, {R(VALUES)} AS match_confidence FROM records r JOIN standard s ON r.code = s.code""")
def succession_confidence(spark, d):
    rows = records(spark, d)
    joined = rows.join(K.standard_codes(K.resolve_succession(rows, TARGET)), "code")
    method, confidence = K.succession_confidence(F.col("code"), F.col("standard_codes"), K.is_active(TARGET), F.col("start_year"), TARGET)
    return joined.select("code", method.alias("match_method"), rounded(confidence).alias("match_confidence"))


EXPANDED = """expanded AS (SELECT code, start_year, end_year, CAST(unnest(range(greatest(start_year, 1995), least(coalesce(end_year - 1, 2001), 2001) + 1)) AS INTEGER) AS year FROM records)"""


@query("expand_validity_years", with_sql(RECORDS, EXPANDED) + "SELECT code, year FROM expanded")
def expand_validity_years(spark, d):
    return K.expand_validity(records(spark, d), *I.YEARS).select("code", "year")


@query("crosswalk_build", with_sql(RECORDS, WALK, EXPANDED) + f"""
SELECT DISTINCT e.year, e.code AS admin_code_original, array_to_string(codes, ';') AS admin_code_standard, {METHODS} AS match_method, {R(VALUES)} AS match_confidence
FROM expanded e JOIN records r ON e.code = r.code JOIN standard s ON e.code = s.code""")
def crosswalk_build(spark, d):
    rows = K.succession_crosswalk(records(spark, d), *I.YEARS, TARGET)
    rows = rows.withColumns({"admin_name_original": F.lit(""), "admin_name_standard": F.lit("")})
    out = K.distinct_crosswalk(rows, [F.col("match_confidence").desc(), F.col("match_method")])
    return out.select("year", "admin_code_original", "admin_code_standard", "match_method", rounded("match_confidence").alias("match_confidence"))


@query("active_in_year", with_sql(RECORDS, "uses AS (SELECT DISTINCT l_partkey, CAST(year(l_shipdate) AS INTEGER) AS year FROM lineitem)") + f"""
SELECT l_partkey, year, start_year, end_year FROM uses LEFT JOIN records ON code = l_partkey AND {ACTIVE.format(y='year')}""")
def active_in_year(spark, d):
    uses = I.table(spark, d, "lineitem").select("l_partkey", F.year("l_shipdate").alias("year")).distinct()
    return K.active_records(uses, records(spark, d).drop("new_codes"), "l_partkey", "year")


SRC_NAMES = ("codes_1998.csv", "codes.csv", "list_2010.xlsx")


@query("standardize_crosswalk", f"""
WITH t AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE CAST(1990 + c_custkey % 15 AS VARCHAR) || '年' END AS y, {choose_sql(SRC_NAMES, 'c_custkey')} AS src,
  CASE WHEN c_custkey % 3 = 0 THEN 'nan' ELSE CAST(110000 + c_custkey AS VARCHAR) END AS oldc, CASE WHEN c_custkey % 4 = 0 THEN CAST(120000 + c_custkey AS VARCHAR) ELSE '' END AS newc,
  CAST(130000 + c_custkey AS VARCHAR) AS code, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE ' ' END AS name, 'P' || c_nationkey AS prov, CASE WHEN c_custkey % 7 = 0 THEN 'C' || c_custkey ELSE 'NA' END AS coun,
  CASE WHEN c_custkey % 6 = 0 THEN 'in use' ELSE '' END AS st FROM customer),
u AS (SELECT *, coalesce(TRY_CAST(regexp_extract(y, '(?:19|20)\\d{{2}}', 0) AS INTEGER), TRY_CAST(regexp_extract(src, '(?:19|20)\\d{{2}}', 0) AS INTEGER)) AS year, oldc <> 'nan' AS ho, newc <> '' AS hn, trim(name) <> '' AS hname, coun <> 'NA' AS hc FROM t)
SELECT k, year, CASE WHEN ho THEN oldc ELSE code END AS admin_code_original, CASE WHEN hn THEN newc ELSE code END AS admin_code_standard,
  CASE WHEN hname THEN name WHEN hc THEN coun ELSE prov END AS admin_name_original, CASE WHEN hc THEN coun ELSE prov END AS admin_name_standard, hn AS has_new_code,
  CASE WHEN st <> '' THEN 'status=' || st ELSE '' END AS notes FROM u WHERE year IS NULL OR year BETWEEN 1995 AND 2001""")
def standardize_crosswalk(spark, d):
    k = F.col("c_custkey")
    text = lambda n: (k + n).cast("string")
    rows = I.table(spark, d, "customer").select(
        k.alias("k"), F.when(k % 5 == 0, "").otherwise(F.concat((k % 15 + 1990).cast("string"), F.lit("年"))).alias("year"), choose(SRC_NAMES, k).alias("src"),
        F.when(k % 3 == 0, "nan").otherwise(text(110000)).alias("old_code"), F.when(k % 4 == 0, text(120000)).otherwise("").alias("new_code"), text(130000).alias("code"),
        F.when(k % 2 == 0, F.col("c_name")).otherwise(" ").alias("name"), F.concat(F.lit("P"), F.col("c_nationkey").cast("string")).alias("province"),
        F.when(k % 7 == 0, F.concat(F.lit("C"), k.cast("string"))).otherwise("NA").alias("county"), F.when(k % 6 == 0, "in use").otherwise("").alias("status"))
    out = K.standardize_crosswalk(rows.withColumn("county", F.nullif("county", F.lit("NA"))), F.col("src"), *I.YEARS)
    return out.select("k", "year", "admin_code_original", "admin_code_standard", "admin_name_original", "admin_name_standard", "has_new_code", "notes")


@query("match_method")
def match_method(spark, d):
    """Similarity has no SQL twin; tests compare with a plain loop."""
    k = F.col("p_partkey")
    code = (k % 50 + 110000).cast("string")
    rows = I.table(spark, d, "part").select(
        k.alias("row_id"), F.when(k % 6 == 0, "").otherwise(code).alias("admin_code_original"),
        F.when(k % 4 == 0, code).otherwise((k % 60 + 120000).cast("string")).alias("admin_code_standard"),
        F.concat("p_name", F.lit("县")).alias("admin_name_original"),
        F.when(k % 5 == 0, F.concat("p_name", F.lit("县"))).otherwise(F.concat("p_brand", F.lit("市"))).alias("admin_name_standard"),
        (k % 3 == 0).alias("has_new_code"))
    out = K.match_method(rows)
    return out.select("row_id", "match_method", "match_confidence")


def match_inputs(spark, d):
    """Template rows with misspelt names and a crosswalk, both from parts."""
    k = F.col("p_partkey")
    year = (k % 4 + 1998).cast("int")
    crosswalk = I.table(spark, d, "part").select(
        F.when(year < 2001, year).alias("year"), F.lpad(k.cast("string"), 12, "0").alias("admin_code_standard"),
        F.concat("p_brand", F.lit("省")).alias("province_standard"), F.concat("p_type", F.lit("市")).alias("prefecture_standard"),
        F.concat("p_name", F.lit("县")).alias("county_standard"), F.col("p_name").alias("admin_name_standard"))
    odd = F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, F.translate("p_name", "aei", "oxa")).otherwise(F.substring("p_name", 3, 100))
    rows = I.table(spark, d, "part").select(
        k.alias("row_id"), F.when(k % 13 == 0, "").otherwise(F.concat(F.lit("Brand#"), (k % 28).cast("string"))).alias("province"),
        F.when(k % 4 == 0, F.col("p_type")).when(k % 4 == 1, F.lit("nowhere")).otherwise("").alias("prefecture"),
        F.when(k % 5 == 0, "").otherwise(odd).alias("county"), (k % 6 + 1997).cast("int").alias("year"))
    return rows, crosswalk


@query("crosswalk_match")
def crosswalk_match(spark, d):
    """Similarity has no SQL twin; tests compare with a plain loop over all candidates."""
    rows, crosswalk = match_inputs(spark, d)
    matched = K.crosswalk_match(rows, crosswalk)
    return rows.join(matched, ["province", "prefecture", "county", "year"], "left").select(
        "row_id", "admin_code", "match_confidence", "match_method")


MATCH_INPUTS = """cand AS (SELECT CASE WHEN p_partkey % 4 < 3 THEN CAST(p_partkey % 4 + 1998 AS INTEGER) END AS year, lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS code,
  p_brand AS p, p_type AS f, p_name AS c FROM part),
ask AS (SELECT p_partkey AS row_id, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE 'Brand#' || (p_partkey % 28) END AS prov,
  CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN 'nowhere' ELSE '' END AS pref,
  CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN translate(p_name, 'aei', 'oxa') ELSE substr(p_name, 3) END AS county,
  CAST(p_partkey % 6 + 1997 AS INTEGER) AS year FROM part)"""


@query("crosswalk_exact", with_sql(MATCH_INPUTS) + """
, met AS (SELECT row_id, prov, pref, county, code, p, f, c, pref <> '' AND (f = pref OR c = pref) AS hp, county <> '' AND c = county AS hc, p = prov OR c = prov AS hv
  FROM ask r JOIN cand x ON (x.year = r.year OR r.year NOT IN (SELECT year FROM cand WHERE year IS NOT NULL)) AND (prov = '' OR p = prov OR c = prov)),
best AS (SELECT row_id, bool_or(hp) AS any_pref, min(code) FILTER (hp AND hc) AS both_code, min(code) FILTER (hc) AS county_code, min(code) FILTER (hp) AS pref_code,
  min(code) FILTER (hv) AS prov_code FROM met GROUP BY row_id)
SELECT r.row_id, CASE WHEN county <> '' THEN CASE WHEN any_pref THEN both_code ELSE county_code END WHEN pref <> '' THEN pref_code WHEN prov <> '' THEN prov_code END AS admin_code
FROM ask r LEFT JOIN best b ON b.row_id = r.row_id""")
def crosswalk_exact(spark, d):
    """Rows whose names a candidate carries exactly; the others stay without a code."""
    rows, crosswalk = match_inputs(spark, d)
    return rows.join(K.exact_match(rows, crosswalk), list(K.MATCH_KEY), "left").select("row_id", "admin_code")
