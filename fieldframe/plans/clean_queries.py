"""Cleaning, unit and parsing queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from fieldframe.functions import names as N
from fieldframe.functions import numbers as X
from fieldframe.functions import roles as L
from fieldframe.functions import text as T
from fieldframe.functions import units as U
from fieldframe.operators import grid as G
from fieldframe.operators import records as O
from fieldframe.plans import inputs as I
from fieldframe.plans.inputs import R, with_sql
from fieldframe.plans.registry import query


def choose(values, index):
    """The entry of a fixed list at a row's position number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values)).cast("int") + 1)


def choose_sql(values, index):
    literal = ", ".join("'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else repr(v) for v in values)
    return f"([{literal}])[CAST(({index}) % {len(values)} AS INTEGER) + 1]"


# --- numbers, years, text -------------------------------------------------------------------

NUMBER_SHAPES = ("{}", "{},5", "about {} t", "n/a", "--", "", "-{}", "x", "{}.25 kg", " {} ")
NUMBER_SQL = "CASE CAST(o_orderkey % 10 AS INTEGER) " + " ".join(
    f"WHEN {i} THEN " + "'" + shape.replace("{}", "' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || '") + "'"
    for i, shape in enumerate(NUMBER_SHAPES)) + " END"


def _number_text():
    n = F.floor("o_totalprice").cast("bigint").cast("string")
    shape = choose(NUMBER_SHAPES, F.col("o_orderkey"))
    return F.replace(shape, F.lit("{}"), n)


@query("parse_number", f"""
WITH t AS (SELECT o_orderkey, trim({NUMBER_SQL}) AS raw FROM orders),
u AS (SELECT *, regexp_replace(raw, '[,，]', '', 'g') AS bare FROM t)
SELECT o_orderkey, CASE WHEN lower(raw) NOT IN ('', 'nan', 'none', 'na', 'n/a', '--', '—', '-')
  THEN coalesce(TRY_CAST(bare AS DOUBLE), TRY_CAST(regexp_extract(bare, '-?\\d+(?:\\.\\d+)?', 0) AS DOUBLE)) END AS number
FROM u""")
def parse_number(spark, d):
    orders = I.table(spark, d, "orders")
    return orders.select("o_orderkey", X.parse_number(_number_text()).alias("number"))


@query("parse_year", """
WITH t AS (SELECT o_orderkey, CASE CAST(o_orderkey % 4 AS INTEGER) WHEN 0 THEN 'panel_' || year(o_orderdate) || '_v2.csv'
  WHEN 1 THEN CAST(year(o_orderdate) AS VARCHAR) || '年' WHEN 2 THEN 'no year 18' ELSE '3' || CAST(o_orderdate AS DATE) END AS raw FROM orders)
SELECT o_orderkey, TRY_CAST(regexp_extract(raw, '(?:19|20)\\d{2}', 0) AS INTEGER) AS year FROM t""")
def parse_year(spark, d):
    y = F.year("o_orderdate").cast("string")
    k = F.col("o_orderkey") % 4
    raw = (F.when(k == 0, F.concat(F.lit("panel_"), y, F.lit("_v2.csv"))).when(k == 1, F.concat(y, F.lit("年")))
           .when(k == 2, F.lit("no year 18")).otherwise(F.concat(F.lit("3"), F.to_date("o_orderdate").cast("string"))))
    return I.table(spark, d, "orders").select("o_orderkey", X.parse_year(raw).alias("year"))


SUFFIXES = ("", "省", "市", "壮族自治区", "自治区", "县", "自治县", "市辖区", "区", "地区", "维吾尔自治区", "盟", "市县", " 县 ")
BASES = ("河北", "广西", "甲", "", "宁夏", "区", "县市")
NAME_SQL = f"{choose_sql(BASES, 'c_custkey // 14')} || {choose_sql(SUFFIXES, 'c_custkey')}"


def _name():
    k = F.col("c_custkey")
    return F.concat(choose(BASES, F.floor(k / 14)), choose(SUFFIXES, k))


def _one_suffix_sql(raw, suffixes):
    kept = f"regexp_extract({raw}, '^(.+?)(?:{'|'.join(suffixes)})$', 1)"
    return f"CASE WHEN {kept} <> '' THEN trim({kept}) ELSE {raw} END"


def _nested_sql(raw):
    for suffix in N.PROVINCE_SUFFIXES:
        raw = f"regexp_replace({raw}, '{suffix}$', '')"
    return raw


@query("normalize_admin_name", f"""
WITH t AS (SELECT c_custkey, trim({NAME_SQL}) AS raw FROM customer)
SELECT c_custkey, {_one_suffix_sql('raw', N.STATISTICS_SUFFIXES)} AS statistics_name,
  {_one_suffix_sql('raw', N.CODE_TABLE_SUFFIXES)} AS code_table_name,
  regexp_replace(raw, '(?:{'|'.join(N.PLACE_SUFFIXES)})+$', '') AS place_name,
  {_nested_sql('raw')} AS province_name FROM t""")
def normalize_admin_name(spark, d):
    raw = _name()
    return I.table(spark, d, "customer").select(
        "c_custkey", N.clean_admin_name(raw).alias("statistics_name"),
        N.normalize_admin_name(raw).alias("code_table_name"),
        N.normalize_place_name(raw).alias("place_name"), N.normalize_province_name(raw).alias("province_name"))


ENGLISH = tuple(k.title() for k in N.PROVINCE_NAMES) + ("Atlantis",)
ENGLISH_ENDS = ("", " Province", " Municipality", "  autonomous region", " Zhuang Autonomous Region")
ENGLISH_SQL = f"{choose_sql(ENGLISH, 'c_custkey')} || {choose_sql(ENGLISH_ENDS, 'c_custkey // 36')}"


def _replace_all_sql(raw):
    for suffix in N.ENGLISH_SUFFIXES:
        raw = f"replace({raw}, '{suffix}', '')"
    return raw


@query("map_province_name", f"""
WITH t AS (SELECT c_custkey, trim({ENGLISH_SQL}) AS raw FROM customer),
m AS (SELECT * FROM (VALUES {', '.join(f"('{k}', '{v}')" for k, v in N.PROVINCE_NAMES.items())}) v(k, v))
SELECT c_custkey, coalesce(m.v, raw) AS province
FROM t LEFT JOIN m ON m.k = trim(regexp_replace({_replace_all_sql('lower(raw)')}, '\\s+', ' ', 'g'))""")
def map_province_name(spark, d):
    k = F.col("c_custkey")
    raw = F.concat(choose(ENGLISH, k), choose(ENGLISH_ENDS, F.floor(k / 36)))
    return I.table(spark, d, "customer").select("c_custkey", N.map_province_name(raw).alias("province"))


CODE_SQL = """CASE CAST(c_custkey % 6 AS INTEGER) WHEN 0 THEN '' WHEN 1 THEN CAST(c_custkey AS VARCHAR) || '.0'
  WHEN 2 THEN 'nan' WHEN 3 THEN ' ' || c_custkey || ' ' WHEN 4 THEN 'A' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END"""


def _code():
    k = F.col("c_custkey").cast("string")
    m = F.col("c_custkey") % 6
    return (F.when(m == 0, F.lit("")).when(m == 1, F.concat(k, F.lit(".0"))).when(m == 2, F.lit("nan"))
            .when(m == 3, F.concat(F.lit(" "), k, F.lit(" "))).when(m == 4, F.concat(F.lit("A"), k)).otherwise(k))


@query("normalize_admin_code", f"""
SELECT c_custkey, regexp_extract(trim({CODE_SQL}), '^(\\d+)(\\.0)?$', 1) AS code FROM customer""")
def normalize_admin_code(spark, d):
    return I.table(spark, d, "customer").select("c_custkey", N.normalize_admin_code(_code()).alias("code"))


@query("fill_code_from_group", f"""
WITH t AS (SELECT c_custkey, n_name AS province, regexp_extract(trim({CODE_SQL}), '^(\\d+)(\\.0)?$', 1) AS code
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
f AS (SELECT province, arg_min(code, c_custkey) AS first_code FROM t WHERE code <> '' GROUP BY province)
SELECT c_custkey, t.province, CASE WHEN code <> '' THEN code ELSE coalesce(first_code, '') END AS code
FROM t LEFT JOIN f ON t.province = f.province""")
def fill_code_from_group(spark, d):
    nation = I.table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("province"))
    rows = I.table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select("c_custkey", "province", _code().alias("code"))
    return O.fill_code_from_group(rows, "province", "code", "c_custkey").select("c_custkey", "province", "code")


LEVELS = ("", "County", "nan", "city", "province")
LABELS = ("早稻", "single rice", "late rice", "Rice total", "粮食", "wheat", "")


@query("infer_level_crop", f"""
WITH t AS (SELECT c_custkey, {choose_sql(LEVELS, 'c_custkey')} AS level,
  CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE '' END AS county, CASE WHEN c_custkey % 4 = 0 THEN 'P' || c_custkey ELSE 'nan' END AS prefecture,
  CASE WHEN c_custkey % 7 = 0 THEN '' ELSE CAST(c_nationkey AS VARCHAR) END AS province,
  lower({choose_sql(LABELS, 'c_custkey // 5')}) AS crop,
  CASE WHEN c_custkey % 13 = 0 THEN '5000' ELSE '' END AS rice_value,
  CASE WHEN c_custkey % 11 = 0 THEN '4000' ELSE '' END AS grain_value,
  CASE WHEN c_custkey % 9 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE '' END AS code FROM customer),
n AS (SELECT *, CASE WHEN prefecture = 'nan' THEN '' ELSE prefecture END AS pref FROM t)
SELECT c_custkey,
  CASE WHEN lower(level) IN ('county', 'prefecture', 'province') THEN lower(level) WHEN county <> '' THEN 'county'
    WHEN pref <> '' THEN 'prefecture' WHEN province <> '' THEN 'province' ELSE 'unknown' END AS admin_level,
  CASE WHEN crop LIKE '%早稻%' OR crop LIKE '%early rice%' THEN 'early_rice' WHEN crop LIKE '%single rice%' THEN 'single_rice'
    WHEN crop LIKE '%late rice%' THEN 'late_rice' WHEN crop LIKE '%rice%' OR rice_value <> '' THEN 'rice'
    WHEN crop LIKE '%粮食%' OR grain_value <> '' THEN 'grain' ELSE 'unknown' END AS crop_type,
  CASE WHEN code <> '' THEN code ELSE concat_ws('|', nullif(province, ''), nullif(pref, ''), nullif(county, '')) END AS admin_key
FROM n""")
def infer_level_crop(spark, d):
    k = F.col("c_custkey")
    ks = k.cast("string")
    rows = I.table(spark, d, "customer").select(
        "c_custkey", choose(LEVELS, k).alias("level"),
        F.when(k % 3 == 0, F.col("c_name")).otherwise("").alias("county"),
        F.when(k % 4 == 0, F.concat(F.lit("P"), ks)).otherwise("nan").alias("prefecture"),
        F.when(k % 7 == 0, "").otherwise(F.col("c_nationkey").cast("string")).alias("province"),
        choose(LABELS, F.floor(k / 5)).alias("crop"),
        F.when(k % 13 == 0, "5000").otherwise("").alias("rice_value"),
        F.when(k % 11 == 0, "4000").otherwise("").alias("grain_value"),
        F.when(k % 9 == 0, ks).otherwise("").alias("code"))
    c = F.col
    return rows.select(
        "c_custkey",
        N.infer_admin_level(c("level"), c("county"), c("prefecture"), c("province")).alias("admin_level"),
        N.infer_crop([c("crop")], c("rice_value"), c("grain_value")).alias("crop_type"),
        N.admin_key(c("code"), [c("province"), c("prefecture"), c("county")], F.lit("")).alias("admin_key"))


SOURCE_TYPES = ("Official bureau", "yearbook", "CNKI", "third party", "blog", "")
SOURCE_NAMES = ("省统计局", "年鉴 2001", "eps data", "yougis", "notes", "Government")


@query("source_priority", f"""
WITH t AS (SELECT c_custkey, lower({choose_sql(SOURCE_TYPES, 'c_custkey')} || ' ' || {choose_sql(SOURCE_NAMES, 'c_custkey // 6')}) AS s FROM customer)
SELECT c_custkey, CASE WHEN s LIKE '%official%' OR s LIKE '%统计局%' OR s LIKE '%government%' THEN 100
  WHEN s LIKE '%yearbook%' OR s LIKE '%年鉴%' THEN 90 WHEN s LIKE '%cnki%' OR s LIKE '%csyd%' OR s LIKE '%eps%' THEN 80
  WHEN s LIKE '%third%' OR s LIKE '%yougis%' THEN 30 ELSE 50 END AS source_priority FROM t""")
def source_priority(spark, d):
    k = F.col("c_custkey")
    value = N.source_priority(choose(SOURCE_TYPES, k), choose(SOURCE_NAMES, F.floor(k / 6)))
    return I.table(spark, d, "customer").select("c_custkey", value.alias("source_priority"))


@query("effect_labels", """
WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 19 = 0 THEN 0 ELSE c_acctbal END AS e,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE (c_custkey % 40) / 200.0 END AS p FROM customer)
SELECT c_custkey, CASE WHEN e < 0 THEN 'negative' WHEN e > 0 THEN 'positive' WHEN e = 0 THEN 'zero' ELSE 'unavailable' END AS direction,
  CASE WHEN p < 0.05 THEN 'significant_at_5pct' WHEN p < 0.10 THEN 'significant_at_10pct' WHEN p IS NOT NULL THEN 'not_significant'
    ELSE 'unavailable' END AS significance FROM t""")
def effect_labels(spark, d):
    k = F.col("c_custkey")
    e = F.when(k % 17 == 0, None).when(k % 19 == 0, 0.0).otherwise(F.col("c_acctbal"))
    p = F.when(k % 5 == 0, None).otherwise((k % 40) / 200.0)
    return I.table(spark, d, "customer").select(
        "c_custkey", N.direction(e).alias("direction"), N.significance(p).alias("significance"))


@query("parse_code_list", """
WITH t AS (SELECT doc_id, text || ' ' || CAST(110000 + doc_id AS VARCHAR) || '[2013];' || CAST(42010000000 + doc_id AS VARCHAR) AS raw FROM documents)
SELECT doc_id, array_to_string(regexp_extract_all(raw, '(\\d{6,12})', 1), ';') AS codes FROM t""")
def parse_code_list(spark, d):
    key = F.col("doc_id")
    raw = F.concat(F.col("text"), F.lit(" "), (key + 110000).cast("string"), F.lit("[2013];"),
                   (key + 42010000000).cast("string"))
    return I.table(spark, d, "documents").select("doc_id", F.array_join(T.code_list(raw), ";").alias("codes"))


# --- units ----------------------------------------------------------------------------------

TEMPERATURE_UNITS = ("K", "kelvin", "degC", " k ")


@query("convert_temperature", f"""
WITH t AS (SELECT event_id, value, {choose_sql(TEMPERATURE_UNITS, 'event_id')} AS unit FROM events)
SELECT event_id, {R("CASE WHEN lower(trim(unit)) IN ('k', 'kelvin') THEN value - 273.15 ELSE value END")} AS celsius FROM t""")
def convert_temperature(spark, d):
    events = I.table(spark, d, "events").withColumn("unit", choose(TEMPERATURE_UNITS, F.col("event_id")))
    return events.select("event_id", X.rounded(U.temperature_to_celsius("value", "unit")).alias("celsius"))


PRECIPITATION_UNITS = {"click": "kg m-2 s-1", "view": "m", "error": "mm", "purchase": "kg/m2/s", "signup": "metres"}
_UNIT_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PRECIPITATION_UNITS.items()) + " ELSE 'mm' END"


@query("convert_precipitation", f"""
WITH s AS (SELECT event_type, max(epoch_us(ts)) - min(epoch_us(ts)) AS micros FROM (
    SELECT event_type, ts, dense_rank() OVER (PARTITION BY event_type ORDER BY ts) AS r FROM events) WHERE r <= 2 GROUP BY event_type),
t AS (SELECT e.event_id, value, micros / 1e6 AS step, lower({_UNIT_CASE.replace('event_type', 'e.event_type')}) AS u
  FROM events e JOIN s ON e.event_type = s.event_type)
SELECT event_id, {R('''CASE WHEN replace(u, ' ', '') LIKE '%kgm-2s-1%' OR u LIKE '%kg/m2/s%' THEN value * step
  WHEN u IN ('m', 'metres') THEN value * 1000 ELSE value END''', 8)} AS mm FROM t""")
def convert_precipitation(spark, d):
    events = I.table(spark, d, "events").select("event_id", "event_type", "ts", "value")
    steps = O.infer_time_step(events, "event_type", "ts", "step")
    unit = T.first_rule([(F.col("event_type") == k, F.lit(v)) for k, v in PRECIPITATION_UNITS.items()], F.lit("mm"))
    out = events.join(steps, "event_type").withColumn("unit", unit)
    return out.select("event_id", X.rounded(U.precipitation_to_mm("value", "unit", "step"), 8).alias("mm"))


RAW_SQL = "CASE WHEN l_linenumber = 7 THEN -32768 WHEN l_linenumber = 6 THEN -9999 ELSE floor(l_extendedprice) - 3500 END"


@query("scale_modis", f"""
WITH t AS (SELECT l_orderkey, l_linenumber, {RAW_SQL} AS raw FROM lineitem)
SELECT l_orderkey, l_linenumber,
  {R('CASE WHEN raw BETWEEN -3000 AND 10000 AND raw NOT IN (-32768, -9999) THEN raw * 0.0001 END')} AS ndvi,
  {R('CASE WHEN raw BETWEEN -3000 AND 10000 AND raw NOT IN (-32768, -9999) THEN raw * 0.0001 END')} AS evi,
  {R('CASE WHEN raw BETWEEN 7501 AND 65535 THEN raw * 0.02 - 273.15 END')} AS lst FROM t""")
def scale_modis(spark, d):
    n = F.col("l_linenumber")
    raw = F.when(n == 7, -32768.0).when(n == 6, -9999.0).otherwise(F.floor("l_extendedprice") - 3500.0)
    return I.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber",
        *[X.rounded(U.scale_raster(raw, role)).alias(role) for role in ("ndvi", "evi", "lst")])


STAT_PRODUCTION = ("万吨", "公斤", "斤", "克", "吨", " 10000 t ", "kg", "")
STAT_AREA = ("千公顷", "平方公里", "m2", "亩", "公顷", "mu", "1000 ha")
STAT_YIELD = ("公斤/亩", "斤/亩", "吨/公顷", "kg/ha", "kg per mu", "千克每亩", "t/ha")
_unit_sql = lambda u: f"regexp_replace(lower(trim({u})), '[ _·]', '', 'g')"


@query("convert_stat_units", f"""
WITH t AS (SELECT p_partkey, p_retailprice AS v, {_unit_sql(choose_sql(STAT_PRODUCTION, 'p_partkey'))} AS pu,
  {_unit_sql(choose_sql(STAT_AREA, 'p_partkey'))} AS au,
  replace(replace({_unit_sql(choose_sql(STAT_YIELD, 'p_partkey'))}, 'per', '/'), '每', '/') AS yu FROM part)
SELECT p_partkey, {R('''v * CASE WHEN pu LIKE '%万吨%' OR pu LIKE '%10000t%' THEN 10000.0 WHEN pu LIKE '%公斤%' OR pu LIKE '%kg%' THEN 0.001
    WHEN pu LIKE '%斤%' THEN 0.0005 WHEN pu LIKE '%克%' OR pu LIKE '%g%' THEN 0.000001 ELSE 1.0 END''', 9)} AS production_ton,
  {R('''v * CASE WHEN au LIKE '%1000ha%' OR au LIKE '%千公顷%' THEN 1000.0 WHEN au LIKE '%平方公里%' THEN 100.0 WHEN au LIKE '%m2%' THEN 0.0001
    WHEN au LIKE '%亩%' OR au LIKE '%mu%' THEN CAST(1 AS DOUBLE) / 15 ELSE 1.0 END''', 9)} AS area_hectare,
  {R('''v * CASE WHEN yu LIKE '%公斤/亩%' OR yu LIKE '%千克/亩%' OR yu LIKE '%kg/mu%' THEN 15.0 WHEN yu LIKE '%斤/亩%' THEN 7.5
    WHEN yu LIKE '%吨/公顷%' OR yu LIKE '%t/ha%' THEN 1000.0 ELSE 1.0 END''')} AS yield_kg_per_hectare FROM t""")
def convert_stat_units(spark, d):
    k, v = F.col("p_partkey"), F.col("p_retailprice")
    return I.table(spark, d, "part").select(
        "p_partkey", X.rounded(U.production_to_ton(v, choose(STAT_PRODUCTION, k)), 9).alias("production_ton"),
        X.rounded(U.area_to_hectare(v, choose(STAT_AREA, k)), 9).alias("area_hectare"),
        X.rounded(U.yield_to_kg_ha(v, choose(STAT_YIELD, k))).alias("yield_kg_per_hectare"))


# --- entry templates ------------------------------------------------------------------------

T_CROPS = ("rice", "Grain", "wheat", "cotton")
T_YEARS = ("2008", "2009.0", "20x0", "2011")
T_AREA_UNITS = ("hectare", "mu", "thousand_hectare", "ten_thousand_mu", "acre", "")
T_MASS_UNITS = ("ton", "kg", "jin", "ten_thousand_ton", "ten_thousand_jin")
T_RATE_UNITS = ("kg_per_hectare", "kg_per_mu", "jin_per_mu", "ton_per_hectare")
T_LEVELS = ("province", "county", "", "village")


def template_rows(spark, d):
    """Entry-template rows, one per order, with blanks, bad numbers and unknown units."""
    k = F.col("o_orderkey")
    part = lambda n: F.floor(k / n)
    text = lambda c: c.cast("string")
    return I.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("P"), text(k % 25))).alias("province"),
        F.lit("").alias("prefecture"), F.when(k % 2 == 0, F.concat(F.lit("c"), text(k % 3))).otherwise("").alias("county"),
        F.when(k % 5 == 0, "").otherwise(text(k % 25 + 110000)).alias("admin_code"),
        choose(T_LEVELS, part(2)).alias("admin_level"), choose(T_CROPS, k).alias("crop"),
        choose(T_YEARS, part(4)).alias("content_year"), F.lit("").alias("yearbook_year"),
        F.when(k % 6 == 0, "").when(k % 6 == 1, "abc").otherwise(F.concat(F.lit("1,"), text(k % 50 + 100))).alias("area_value"),
        F.when(k % 6 == 0, "").otherwise(choose(T_AREA_UNITS, part(6))).alias("area_unit"),
        F.when(k % 7 == 0, "").otherwise(text(k % 30 + 10)).alias("production_value"),
        F.when(k % 7 == 0, "").otherwise(choose(T_MASS_UNITS, part(7))).alias("production_unit"),
        F.when(k % 3 == 0, "").otherwise(text(k % 900 + 1)).alias("yield_value"),
        F.when(k % 3 == 0, "").otherwise(choose(T_RATE_UNITS, part(3))).alias("yield_unit"),
        choose(SOURCE_TYPES, k).alias("source_type"), choose(SOURCE_NAMES, part(6)).alias("source_name"))


TEMPLATE = f"""tpl AS (SELECT o_orderkey AS row_id, o_orderkey AS k,
  CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'P' || (o_orderkey % 25) END AS province,
  CASE WHEN o_orderkey % 2 = 0 THEN 'c' || (o_orderkey % 3) ELSE '' END AS county,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE CAST(o_orderkey % 25 + 110000 AS VARCHAR) END AS admin_code,
  {choose_sql(T_LEVELS, 'o_orderkey // 2')} AS admin_level, lower({choose_sql(T_CROPS, 'o_orderkey')}) AS crop,
  CASE CAST((o_orderkey // 4) % 4 AS INTEGER) WHEN 0 THEN 2008 WHEN 1 THEN 2009 WHEN 3 THEN 2011 END AS year,
  CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE {choose_sql(T_AREA_UNITS, 'o_orderkey // 6')} END AS area_unit,
  CASE WHEN o_orderkey % 6 > 1 THEN 1000.0 + o_orderkey % 50 + 100 END AS area_number,
  CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderkey % 30 + 10 AS DOUBLE) * {choose_sql((1.0, 0.001, 0.0005, 10000.0, 5.0), 'o_orderkey // 7')} END AS production_ton,
  CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey % 900 + 1 AS DOUBLE) * {choose_sql((1.0, 15.0, 7.5, 1000.0), 'o_orderkey // 3')} END AS reported,
  lower({choose_sql(SOURCE_TYPES, 'o_orderkey')} || ' ' || {choose_sql(SOURCE_NAMES, 'o_orderkey // 6')}) AS s FROM orders)"""

CHECKED = """tpl2 AS (SELECT *, area_number * CASE area_unit WHEN 'hectare' THEN CAST(1 AS DOUBLE) WHEN 'mu' THEN CAST(1 AS DOUBLE) / 15
    WHEN 'thousand_hectare' THEN 1000 WHEN 'ten_thousand_mu' THEN CAST(10000 AS DOUBLE) / 15 END AS area_hectare FROM tpl),
checked AS (SELECT *, coalesce(reported, production_ton * 1000 / area_hectare) AS yield_kg_per_hectare,
  CASE WHEN reported IS NOT NULL THEN 'reported' WHEN production_ton * 1000 / area_hectare IS NOT NULL
    THEN 'derived_from_area_and_production' ELSE '' END AS yield_source,
  CASE WHEN crop = 'cotton' THEN 'unsupported crop ''cotton''' WHEN year IS NULL THEN 'content_year is required and must be an integer'
    WHEN province = '' AND admin_code = '' THEN 'province or admin_code is required'
    WHEN coalesce(area_hectare, production_ton, reported) IS NULL THEN 'at least one area, production, or yield metric is required' END AS reject_reason,
  CASE WHEN admin_code <> '' THEN admin_code ELSE trim(concat(province, '||', county), '|') END AS admin_id,
  CASE WHEN s LIKE '%official%' OR s LIKE '%统计局%' OR s LIKE '%government%' THEN 100
    WHEN s LIKE '%yearbook%' OR s LIKE '%年鉴%' THEN 90 WHEN s LIKE '%cnki%' OR s LIKE '%eps%' THEN 80
    WHEN s LIKE '%third%' OR s LIKE '%yougis%' THEN 30 ELSE 50 END AS source_priority,
  concat_ws('; ', CASE WHEN admin_level = 'village' THEN 'unrecognized admin_level ''village''' END,
    CASE WHEN k % 6 = 1 THEN 'area_value is not numeric' WHEN k % 6 > 1 AND area_unit IN ('acre', '')
      THEN 'unsupported area_unit ''' || area_unit || '''' END) AS validation_notes FROM tpl2)"""


@query("validate_rows", with_sql(TEMPLATE, CHECKED) + f"""
SELECT row_id, reject_reason, admin_id, crop, year, {R('area_hectare')} AS area_hectare, {R('production_ton')} AS production_ton,
  {R('yield_kg_per_hectare')} AS yield_kg_per_hectare, yield_source, source_priority, validation_notes FROM checked""")
def validate_rows(spark, d):
    out = O.validate_template(template_rows(spark, d))
    return out.select("row_id", "reject_reason", "admin_id", "crop", "year",
                      *[X.rounded(c).alias(c) for c in ("area_hectare", "production_ton", "yield_kg_per_hectare")],
                      "yield_source", "source_priority", "validation_notes")


@query("validate_backfill", f"""
WITH b AS (SELECT o_orderkey AS row_id, o_orderkey AS k, 2005 + o_orderkey % 13 AS y,
    CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 9 = 0 THEN 2005 + o_orderkey % 13 ELSE 2006 + o_orderkey % 13 END AS book,
    {choose_sql(('', 'Grain', 'rice'), 'o_orderkey // 3')} AS crop, {choose_sql(('province', '', 'county'), 'o_orderkey // 5')} AS level,
    CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 900 + 1 AS DOUBLE) END AS rate,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 30 + 10 AS DOUBLE) END AS mass FROM orders)
SELECT row_id, CASE WHEN y NOT BETWEEN 2008 AND 2015 THEN 'content_year must be in 2008-2015'
  WHEN book <> y + 1 THEN 'yearbook_year must equal content_year + 1 (' || (y + 1) || ')'
  WHEN level = 'county' THEN 'admin_level must be province' WHEN crop = 'rice' THEN 'crop must be grain for this backfill template'
  WHEN coalesce(rate, mass) IS NULL THEN 'yield_value or production_value plus area_value is required' END AS reject_reason,
  CAST(coalesce(book, y + 1) AS INTEGER) AS yearbook_year, {R('coalesce(rate, mass * 1000 / 50)')} AS yield_kg_per_hectare FROM b""")
def validate_backfill(spark, d):
    k = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    rows = I.table(spark, d, "orders").select(
        k.alias("row_id"), F.lit("P").alias("province"), F.lit("").alias("admin_code"),
        text(k % 13 + 2005).alias("content_year"),
        F.when(k % 4 == 0, "").when(k % 9 == 0, text(k % 13 + 2005)).otherwise(text(k % 13 + 2006)).alias("yearbook_year"),
        choose(("", "Grain", "rice"), F.floor(k / 3)).alias("crop"),
        choose(("province", "", "county"), F.floor(k / 5)).alias("admin_level"),
        F.when(k % 3 == 0, "").otherwise(text(k % 900 + 1)).alias("yield_value"),
        F.when(k % 3 == 0, "").otherwise("kg_per_hectare").alias("yield_unit"),
        F.when(k % 7 == 0, "").otherwise(text(k % 30 + 10)).alias("production_value"),
        F.when(k % 7 == 0, "").otherwise("ton").alias("production_unit"),
        F.lit("50").alias("area_value"), F.lit("hectare").alias("area_unit"))
    out = O.validate_backfill(rows)
    return out.select("row_id", "reject_reason", "yearbook_year", X.rounded("yield_kg_per_hectare").alias("yield_kg_per_hectare"))


@query("convert_coded_units", with_sql(TEMPLATE, CHECKED) + f"""
SELECT row_id, {R('area_hectare')} AS area_hectare,
  CASE WHEN k % 6 = 1 THEN 'area_value is not numeric' WHEN k % 6 > 1 AND area_unit IN ('acre', '')
      THEN 'unsupported area_unit ''' || area_unit || '''' END AS note FROM checked""")
def convert_coded_units(spark, d):
    value, note = U.convert_coded("area_value", "area_unit", U.CODED_AREA, "area")
    return template_rows(spark, d).select("row_id", X.rounded(value).alias("area_hectare"), note.alias("note"))


@query("derive_yield", f"""
WITH t AS (SELECT o_orderkey, o_totalprice AS p, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey % 50 END AS a,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 100 AS DOUBLE) END AS y FROM orders)
SELECT o_orderkey, {R('coalesce(y, CASE WHEN a > 0 THEN p / 1000 * 1000 / a END)', 8)} AS yield_kg_per_hectare,
  CAST(y IS NULL AND a > 0 AS BIGINT) AS derived FROM t""")
def derive_yield(spark, d):
    k = F.col("o_orderkey")
    rows = I.table(spark, d, "orders").select(
        "o_orderkey", (F.col("o_totalprice") / 1000).alias("production"), F.lit("t").alias("production_unit"),
        F.when(k % 5 == 0, 0).otherwise(k % 50).alias("area"), F.lit("ha").alias("area_unit"),
        F.when(k % 3 == 0, (k % 100).cast("double")).alias("yield"), F.lit("kg/ha").alias("yield_unit"))
    out = O.statistics_row(rows)
    return out.select("o_orderkey", X.rounded("yield_kg_per_hectare", 8).alias("yield_kg_per_hectare"), "derived")


@query("dedupe_priority", with_sql(TEMPLATE, CHECKED) + f"""
SELECT admin_id, year, crop, row_id, source_priority FROM (
  SELECT *, row_number() OVER (PARTITION BY admin_id, year, crop ORDER BY source_priority DESC, row_id) AS r
  FROM checked WHERE reject_reason IS NULL) WHERE r = 1""")
def dedupe_priority(spark, d):
    rows = O.validate_template(template_rows(spark, d)).where("reject_reason is null")
    out = O.dedupe_priority(rows, ["admin_id", "year", "crop"], "source_priority", [F.col("row_id")])
    return out.select("admin_id", "year", "crop", "row_id", "source_priority")


@query("low_confidence_split", with_sql(TEMPLATE, CHECKED) + """
SELECT row_id, CASE WHEN admin_code = '' THEN 'review' ELSE 'cleaned' END AS target FROM checked WHERE reject_reason IS NULL""")
def low_confidence_split(spark, d):
    rows = O.validate_template(template_rows(spark, d)).where("reject_reason is null")
    low = rows.where("match_confidence < 0.85").select("row_id", F.lit("review").alias("target"))
    kept = rows.where("match_confidence is null or match_confidence >= 0.85").select("row_id", F.lit("cleaned").alias("target"))
    return kept.unionByName(low)


@query("stat_qc_rows", f"""
WITH t AS (SELECT o_orderkey, trim({NUMBER_SQL}) AS raw FROM orders)
SELECT 'orders.csv' AS source_file, o_orderkey + 2 AS source_row, 'missing_year' AS issue, 'Year field is empty or invalid.' AS message
FROM t WHERE lower(raw) IN ('n/a', '--', '', 'x')""")
def stat_qc_rows(spark, d):
    rows = I.table(spark, d, "orders").withColumn("raw_year", _number_text())
    return O.missing_year_events(rows, "raw_year", F.lit("orders.csv"), F.col("o_orderkey") + 2)


# --- zones, rows, phenology -----------------------------------------------------------------

@query("standard_zone_ids", """
SELECT c_custkey, 'admin_' || lpad(CAST(row_number() OVER (ORDER BY c_custkey) AS VARCHAR),
   CAST(greatest(6, length(CAST(row_number() OVER (ORDER BY c_custkey) AS VARCHAR))) AS INTEGER), '0') AS admin_id, trim(c_name) AS county_name FROM customer""")
def standard_zone_ids(spark, d):
    zones = I.table(spark, d, "customer").select("c_custkey", "c_name")
    return O.zone_ids(zones, "c_custkey", names={"c_name": "county_name"}).drop("c_name")


@query("row_stats", f"""
WITH t AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value END AS m, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value + 1 END AS v FROM events)
SELECT event_id, {R('coalesce(m, v)')} AS mean, {R('coalesce(m, v)')} AS median, {R('coalesce(m, v)')} AS "min", {R('coalesce(m, v) + 0.5')} AS "max",
  CAST(CASE WHEN coalesce(m, v) IS NOT NULL THEN 0.0 END AS DOUBLE) AS std,
  CAST(CASE WHEN coalesce(m, v) IS NULL THEN 0 ELSE 1 END AS BIGINT) AS valid_pixel_count FROM t""")
def row_stats(spark, d):
    k, v = F.col("event_id"), F.col("value")
    missing = F.lit(None).cast("double")
    rows = I.table(spark, d, "events").select(
        "event_id", F.when(k % 3 == 0, v).alias("mean"), F.when(k % 7 != 0, v + 1).alias("value"),
        missing.alias("median"), missing.alias("min"), missing.alias("std"), missing.alias("valid_pixel_count"))
    rows = rows.withColumn("max", F.coalesce("mean", "value") + 0.5)
    out = O.row_stats(rows)
    return out.select("event_id", *[X.rounded(c).alias(c) for c in ("mean", "median", "min", "max", "std")], "valid_pixel_count")


@query("row_mean", f"""
SELECT l_orderkey, l_linenumber,
  {R('''(coalesce(CASE WHEN l_linenumber > 2 THEN l_quantity END, 0) + coalesce(CASE WHEN l_linenumber < 5 AND l_linenumber > 1 THEN l_tax END, 0))
   / nullif(CAST(l_linenumber > 2 AS INTEGER) + CAST(l_linenumber < 5 AND l_linenumber > 1 AS INTEGER), 0)''')} AS row_mean,
  {R('''CASE WHEN l_linenumber > 1 THEN coalesce(CASE WHEN l_linenumber > 2 THEN l_quantity END, 0)
   + coalesce(CASE WHEN l_linenumber < 5 AND l_linenumber > 1 THEN l_tax END, 0) END''')} AS row_sum FROM lineitem""")
def row_mean(spark, d):
    n = F.col("l_linenumber")
    a, b = F.when(n > 2, F.col("l_quantity")), F.when((n < 5) & (n > 1), F.col("l_tax"))
    return I.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", X.rounded(X.row_mean(a, b)).alias("row_mean"), X.rounded(X.row_sum(a, b)).alias("row_sum"))


@query("fill_exposure", f"""
SELECT event_id, {R("coalesce(CASE WHEN event_id % 4 > 1 THEN value END, CAST(event_id % 9 AS DOUBLE))")} AS exposure_index FROM events""")
def fill_exposure(spark, d):
    k = F.col("event_id")
    text = F.when(k % 4 == 0, " ").when(k % 4 == 1, "nan").otherwise(F.col("value").cast("string"))
    rows = I.table(spark, d, "events").select("event_id", text.alias("exposure_index"), (k % 9).alias("chd_annual"))
    return O.fill_exposure(rows).select("event_id", X.rounded("exposure_index").alias("exposure_index"))


@query("yield_anomaly", with_sql(I.YIELDS, """base AS (
  SELECT province, crop, avg(yield_kg_per_hectare) AS m, stddev_samp(yield_kg_per_hectare) AS s FROM yields
  WHERE year BETWEEN 1995 AND 1999 GROUP BY province, crop)""") + f"""
SELECT y.province, y.crop, y.year, {R('yield_kg_per_hectare - m')} AS yield_anomaly_abs,
  {R('CASE WHEN m <> 0 THEN (yield_kg_per_hectare - m) / m * 100 END')} AS yield_anomaly_pct,
  {R('CASE WHEN s > 0 THEN (yield_kg_per_hectare - m) / s END')} AS yield_anomaly_zscore
FROM yields y LEFT JOIN base b ON y.province = b.province AND y.crop = b.crop""")
def yield_anomaly(spark, d):
    y = I.yields(spark, d)
    base = y.where(F.col("year").between(*I.BASELINE)).groupBy("province", "crop").agg(
        F.avg("yield_kg_per_hectare").alias("m"), F.stddev_samp("yield_kg_per_hectare").alias("s"))
    c = F.col
    out = y.join(base, ["province", "crop"], "left").withColumns(
        O.yield_anomaly(c("yield_kg_per_hectare"), c("m"), c("m"), c("s")))
    return out.select("province", "crop", "year", *[
        X.rounded(n).alias(n) for n in ("yield_anomaly_abs", "yield_anomaly_pct", "yield_anomaly_zscore")])


@query("vhi", f"""
WITH r AS (SELECT p_brand, min(p_size) AS a, max(p_size) AS b, min(p_retailprice) AS c, max(p_retailprice) AS e FROM part GROUP BY p_brand)
SELECT p_partkey, {R('CASE WHEN b > a AND e > c THEN ((p_size - a) / CAST(b - a AS DOUBLE) * 100 + (e - p_retailprice) / (e - c) * 100) / 2 END')} AS vhi
FROM part JOIN r ON part.p_brand = r.p_brand""")
def vhi(spark, d):
    part = I.table(spark, d, "part")
    ranges = part.groupBy("p_brand").agg(F.min("p_size").alias("a"), F.max("p_size").alias("b"),
                                         F.min("p_retailprice").alias("c"), F.max("p_retailprice").alias("e"))
    c = F.col
    value = O.vegetation_health(c("p_size"), c("a"), c("b"), c("p_retailprice"), c("c"), c("e"))
    return part.join(ranges, "p_brand").select("p_partkey", X.rounded(value).alias("vhi"))


@query("chd_intensity", f"""
SELECT l_suppkey, {R('''coalesce(sum(CASE WHEN l_returnflag IN ('A', 'R') AND l_linestatus = 'F'
    THEN (l_quantity - 25) * abs(round(l_discount * 100) - 5) END), 0)''')} AS chd_intensity FROM lineitem GROUP BY l_suppkey""")
def chd_intensity(spark, d):
    lines = I.table(spark, d, "lineitem").select("l_suppkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus")
    hot = T.truthy(F.when(F.col("l_returnflag").isin("A", "R"), "Yes").otherwise("no"))
    dry = T.truthy(F.when(F.col("l_linestatus") == "F", "1").otherwise("0"))
    value = O.chd_intensity(F.col("l_quantity") - 25, F.round(F.col("l_discount") * 100) - 5, hot, dry)
    return lines.groupBy("l_suppkey").agg(X.rounded(value).alias("chd_intensity"))


@query("doy_to_month", """
WITH t AS (SELECT o_orderkey, CAST(greatest(1, least(366, round_even(dayofyear(o_orderdate) + (o_orderkey % 3 - 1) * 1.5, 0))) AS INTEGER) AS doy FROM orders)
SELECT o_orderkey, CAST(month(DATE '2022-01-01' + (doy - 1)) AS INTEGER) AS month FROM t""")
def doy_to_month(spark, d):
    day = F.dayofyear("o_orderdate") + (F.col("o_orderkey") % 3 - 1) * 1.5
    return I.table(spark, d, "orders").select("o_orderkey", U.doy_to_month(day, 2022).alias("month"))


STAGE_SQL = """stages AS (SELECT o_custkey AS unit, CASE WHEN o_orderstatus = 'O' THEN 'transplanting' WHEN o_orderstatus = 'F' THEN 'maturity'
  ELSE 'heading' END AS stage, dayofyear(o_orderdate) AS doy FROM orders)"""


@query("phenology_window", with_sql(STAGE_SQL, """w AS (SELECT unit, min(doy) FILTER (stage = 'transplanting') AS f, max(doy) FILTER (stage = 'maturity') AS l
  FROM stages GROUP BY unit)""", """m AS (SELECT unit, month(DATE '2022-01-01' + CAST(f - 1 AS INTEGER)) AS s, month(DATE '2022-01-01' + CAST(l - 1 AS INTEGER)) AS e FROM w)""") + """
SELECT unit, CAST(CASE WHEN e >= s THEN s ELSE 6 END AS INTEGER) AS start_month, CAST(CASE WHEN e >= s THEN e ELSE 9 END AS INTEGER) AS end_month,
  CASE WHEN e >= s THEN array_to_string(range(s, e + 1), ',') ELSE '6,7,8,9' END AS months,
  CASE WHEN s IS NULL OR e IS NULL THEN 'default' ELSE 'zonal_stats' END AS status FROM m""")
def phenology_window(spark, d):
    stage = F.when(F.col("o_orderstatus") == "O", "transplanting").when(F.col("o_orderstatus") == "F", "maturity").otherwise("heading")
    stages = I.table(spark, d, "orders").select(
        F.col("o_custkey").alias("unit"), stage.alias("stage"), F.dayofyear("o_orderdate").alias("doy"))
    return O.phenology_window(stages, "unit", 2022, I.MONTHS)


@query("default_unit_rows", """
SELECT CAST(c_custkey AS VARCHAR) AS admin_id, c_name AS admin_name, 2022 AS target_year, '' AS crop_source, 'missing_mask' AS crop_status,
  6 AS start_month, 9 AS end_month, '6,7,8,9' AS months, 'default' AS source, 'default' AS phenology_status FROM customer""")
def default_unit_rows(spark, d):
    units = I.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("admin_id"), F.col("c_name").alias("admin_name"))
    return O.default_unit_rows(units, 2022, I.MONTHS, None)


@query("cell_area_ha", f"""
SELECT c_custkey, {R('abs(0.05 * 111320.0 * cos(radians(24 + (c_custkey * 7 % 1100) / 100.0)) * 0.05 * 111320.0) / 10000.0', 4)} AS geographic_ha,
  {R('abs((c_custkey % 100 + 1) * 30.0) / 10000.0')} AS projected_ha FROM customer""")
def cell_area_ha(spark, d):
    k = F.col("c_custkey")
    lat = F.lit(24.0) + (k * 7 % 1100) / 100.0
    return I.table(spark, d, "customer").select(
        "c_custkey", X.rounded(U.cell_area_ha(F.lit(0.05), F.lit(0.05), lat), 4).alias("geographic_ha"),
        X.rounded(U.cell_area_ha((k % 100 + 1).cast("double"), F.lit(30.0))).alias("projected_ha"))


@query("bbox_clip", """
SELECT c_custkey FROM customer WHERE 105 + (c_custkey % 1800) / 100.0 BETWEEN 108 AND 116.5 AND 24 + (c_custkey * 7 % 1100) / 100.0 BETWEEN 25 AND 31""")
def bbox_clip(spark, d):
    return G.clip_bbox(I.customer_points(I.table(spark, d, "customer")), "lon", "lat", (116.5, 25.0, 108.0, 31.0)).select("c_custkey")


@query("region_filter", """
SELECT n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')""")
def region_filter(spark, d):
    region = I.table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.concat("r_name", F.lit("省")).alias("province"))
    rows = I.table(spark, d, "nation").join(region, "n_regionkey")
    return G.filter_regions(rows, "province", ["ASIA", "EUROPE市"]).select("n_nationkey", "n_name")


# --- headers --------------------------------------------------------------------------------

HEADERS = ("统计年份", "Year", "地区", "Region", "省份", "州", "city_name", "区县(名)", "行政区划代码", "code", "作物名称", "播种面积（千公顷）", "收获面积", "总产量", "水稻单产(公斤/亩)", "平均单产", "grain yield", "备注")
_IGNORED = r"[\s_\-/\\()（）\[\]【】{}]"
_CANDIDATES = ", ".join(
    f"('{role}', '{re.sub(_IGNORED, '', name.lower())}', {i}, {len(names)})" for role, names in L.STATISTICS_FIELDS.items() for i, name in enumerate(names))
_SPECIAL = " OR ".join(f"contains(p, '{w}')" for w in L.SPECIAL_YIELD_WORDS)


@query("header_roles", f"""
WITH h AS (SELECT l_orderkey AS t, l_linenumber AS i, {choose_sql(HEADERS, 'l_partkey')} AS header FROM lineitem),
n AS (SELECT *, regexp_replace(lower(trim(header)), '{_IGNORED}', '', 'g') AS p FROM h),
c AS (SELECT * FROM (VALUES {_CANDIDATES}) v(role, name, rank, many)),
m AS (SELECT t, i, header, role, CASE WHEN p = name THEN rank ELSE many + rank END AS rank FROM n JOIN c ON contains(p, name) AND NOT (role = 'yield' AND ({_SPECIAL}))),
r AS (SELECT *, row_number() OVER (PARTITION BY t, role ORDER BY rank, i) AS k FROM m)
SELECT t, role, header FROM r WHERE k = 1""")
def header_roles(spark, d):
    """Orders as tables, their lines as headers."""
    headers = I.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("t"), F.col("l_linenumber").alias("i"), choose(HEADERS, F.col("l_partkey")).alias("header"))
    return L.header_roles(headers, "t", "i", "header")
