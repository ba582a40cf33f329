"""Grid, zone and zonal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldframe.functions import roles as L
from fieldframe.functions.numbers import rounded
from fieldframe.functions.units import cell_area_ha
from fieldframe.operators import grid as G
from fieldframe.operators import zones as Z
from fieldframe.plans import inputs as I
from fieldframe.plans.clean_queries import choose, choose_sql
from fieldframe.plans.inputs import R, with_sql
from fieldframe.plans.panel_queries import show, show_sql
from fieldframe.plans.registry import query


def polygons(spark, d):
    """One overlapping box with a cut corner per nation."""
    n = F.col("n_nationkey")
    x0, y0 = F.lit(105.003) + (n % 5) * 3.6, F.lit(24.003) + F.floor(n / 5) * 2.2
    at = lambda x, y: F.struct((x0 + x).alias("x"), (y0 + y).alias("y"))
    ring = F.array(at(0.0, 0.0), at(4.0, 0.0), at(4.0, 1.7), at(3.1, 2.4), at(0.0, 2.4), at(0.0, 0.0))
    zones = I.table(spark, d, "nation").select(n.alias("zone_id"), "n_name", ring.alias("ring"))
    return Z.zones_from_rings(zones, "ring")


POINTS = """points AS (SELECT c_custkey, c_acctbal, c_mktsegment, 105 + (c_custkey % 1800) / 100.0 AS lon, 24 + (c_custkey * 7 % 1100) / 100.0 AS lat FROM customer)"""
INSIDE = """polys AS (SELECT n_nationkey AS zone_id, n_name, 105.003 + (n_nationkey % 5) * 3.6 AS x0, 24.003 + (n_nationkey // 5) * 2.2 AS y0 FROM nation),
inside AS (SELECT p.*, zone_id, n_name FROM points p JOIN polys z ON lon > x0 AND lon < x0 + 4 AND lat > y0 AND lat < y0 + 2.4
  AND (lon - x0 - 3.1) / 0.9 + (lat - y0 - 1.7) / 0.7 <= 1)"""


def points(spark, d):
    return I.customer_points(I.table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"))


@query("point_in_zone_join", with_sql(POINTS, INSIDE) + """
SELECT p.c_custkey, min(zone_id) AS zone_id FROM points p LEFT JOIN inside i ON p.c_custkey = i.c_custkey GROUP BY p.c_custkey""")
def point_in_zone_join(spark, d):
    return Z.point_in_zone(points(spark, d), polygons(spark, d), "c_custkey", "zone_id").select("c_custkey", "zone_id")


@query("cell_zone_join", with_sql(POINTS, INSIDE) + f"""
SELECT zone_id, count(*) AS cells, {R('avg(lon)')} AS mean_lon, {R('avg(lat)')} AS mean_lat FROM inside GROUP BY zone_id""")
def cell_zone_join(spark, d):
    cells = Z.join_zones(points(spark, d), polygons(spark, d))
    return cells.groupBy("zone_id").agg(F.count(F.lit(1)).alias("cells"), rounded(F.avg("lon")).alias("mean_lon"),
                                        rounded(F.avg("lat")).alias("mean_lat"))


@query("unit_zone_join", with_sql(POINTS, INSIDE.replace("FROM points p", "FROM (SELECT c_custkey, lon + 0.015 AS lon, lat + 0.025 AS lat FROM points) p")) + f"""
SELECT p.c_custkey, {R('p.lon + 0.015')} AS lon, {R('p.lat + 0.025')} AS lat, min(zone_id) AS zone_id
FROM points p LEFT JOIN inside i ON p.c_custkey = i.c_custkey GROUP BY p.c_custkey, p.lon, p.lat""")
def unit_zone_join(spark, d):
    """Units of two parts, a cup with a wide left side and a small island, by a point inside them."""
    at = lambda x, y: F.struct((F.col("lon") + x).alias("x"), (F.col("lat") + y).alias("y"))
    cup = [(0.0, 0.0), (0.06, 0.0), (0.06, 0.05), (0.05, 0.05), (0.05, 0.01), (0.03, 0.01), (0.03, 0.05), (0.0, 0.05), (0.0, 0.0)]
    island = [(0.2, 0.0), (0.22, 0.0), (0.22, 0.04), (0.2, 0.04), (0.2, 0.0)]
    rings = F.array(*[F.array(*[at(x, y) for x, y in ring]) for ring in (cup, island)])
    units = points(spark, d).select("c_custkey", rings.alias("rings"))
    out = Z.assign_units(units, "rings", polygons(spark, d), "c_custkey", "zone_id")
    return out.select("c_custkey", rounded("lon").alias("lon"), rounded("lat").alias("lat"), "zone_id")


THIN = """thin AS (SELECT n_nationkey AS zone_id, 105.003 + (n_nationkey % 5) * 3.6 AS x1, 105.043 + (n_nationkey % 5) * 3.6 + n_nationkey % 3 AS x2,
  24.003 + (n_nationkey // 5) * 2.2 AS y1, 24.013 + (n_nationkey // 5) * 2.2 + n_nationkey % 2 AS y2 FROM nation)"""


@query("cell_zone_touched", with_sql(POINTS, THIN) + f"""
SELECT zone_id, count(*) AS points, count(DISTINCT (ix, iy)) AS cells, {R('avg(lon)')} AS mean_lon FROM (SELECT *, floor(lon / 0.5) AS ix, floor(lat / 0.5) AS iy FROM points) p
JOIN thin ON x1 < (ix + 1) * 0.5 AND x2 > ix * 0.5 AND y1 < (iy + 1) * 0.5 AND y2 > iy * 0.5 GROUP BY zone_id""")
def cell_zone_touched(spark, d):
    """Cells of half a degree to zones down to a few hundredths wide; by centres most of these have none."""
    n = F.col("n_nationkey")
    x1, y1 = F.lit(105.003) + (n % 5) * 3.6, F.lit(24.003) + F.floor(n / 5) * 2.2
    x2, y2 = x1 + 0.04 + n % 3, y1 + 0.01 + n % 2
    ring = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1))])
    zones = Z.zones_from_rings(I.table(spark, d, "nation").select(n.alias("zone_id"), ring.alias("ring")), "ring")
    found = Z.cell_zones(points(spark, d), zones, "zone_id", 0.5, all_touched=True)
    cell = F.struct(F.floor(F.col("lon") / 0.5), F.floor(F.col("lat") / 0.5))
    return found.groupBy("zone_id").agg(F.count(F.lit(1)).alias("points"), F.count_distinct(cell).alias("cells"), rounded(F.avg("lon")).alias("mean_lon"))


EXTENTS = """boxes AS (SELECT s_nationkey AS zone_id, min(x1) AS x1, max(x1 + 1.5) AS x2, min(y1) AS y1, max(y1 + 1.2) AS y2 FROM (
  SELECT s_nationkey, 105.003 + (s_nationkey % 5) * 3.6 + (s_suppkey % 7) * 0.1 AS x1, 24.003 + (s_nationkey // 5) * 2.2 + (s_suppkey % 3) * 0.1 AS y1 FROM supplier) GROUP BY s_nationkey)"""


def boxes(spark, d):
    n, k = F.col("s_nationkey"), F.col("s_suppkey")
    x1 = F.lit(105.003) + (n % 5) * 3.6 + (k % 7) * 0.1
    y1 = F.lit(24.003) + F.floor(n / 5) * 2.2 + (k % 3) * 0.1
    extents = I.table(spark, d, "supplier").select(
        n.alias("zone_id"), x1.alias("x1"), (x1 + 1.5).alias("x2"), y1.alias("y1"), (y1 + 1.2).alias("y2"))
    return G.zone_boxes(extents, "zone_id")


@query("zone_bbox_range_join", with_sql(POINTS, EXTENTS) + """
SELECT c_custkey, zone_id FROM points JOIN boxes ON lon BETWEEN x1 AND x2 AND lat BETWEEN y1 AND y2""")
def zone_bbox_range_join(spark, d):
    return Z.join_zones(points(spark, d), boxes(spark, d), polygon=False).select("c_custkey", "zone_id")


ROLES = ("tmax", "precipitation", "temperature", "soil_moisture")
CELLS = f"""cells AS (SELECT l_returnflag AS source, {choose_sql(ROLES, 'l_linenumber')} AS variable, 24 + (l_suppkey * 11 % 110) / 10.0 AS lat,
  105 + (l_suppkey * 37 % 180) / 10.0 AS lon, CAST(l_shipdate AS DATE) AS time, l_quantity + (l_partkey % 97) / CAST(997.0 AS DOUBLE) AS value FROM lineitem)"""


def cells(spark, d):
    """Cell table from all line items."""
    k = F.col("l_suppkey")
    return I.table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("source"), choose(ROLES, F.col("l_linenumber")).alias("variable"),
        (F.lit(24.0) + (k * 11 % 110) / 10.0).alias("lat"), (F.lit(105.0) + (k * 37 % 180) / 10.0).alias("lon"),
        F.to_date("l_shipdate").alias("time"),
        (F.col("l_quantity") + (F.col("l_partkey") % 97) / F.lit(997.0)).alias("value"))


N_CELLS = "nc AS (SELECT source, count(DISTINCT (lat, lon)) AS n FROM {src} GROUP BY source)"
_HOW = "CASE variable WHEN 'tmax' THEN 'max' WHEN 'precipitation' THEN 'sum' ELSE 'mean' END"


@query("monthly_climate", with_sql(CELLS, N_CELLS.format(src="cells"),
  "pc AS (SELECT source, variable, lat, lon, CAST(date_trunc('month', time) AS DATE) AS m, avg(value) AS a, max(value) AS x, sum(value) AS s FROM cells GROUP BY ALL)",
  f"pm AS (SELECT pc.source, variable, m, CASE {_HOW} WHEN 'max' THEN avg(x) WHEN 'sum' THEN sum(s) / any_value(n) ELSE avg(a) END AS v FROM pc JOIN nc ON pc.source = nc.source GROUP BY pc.source, variable, m)",
  "spine AS (SELECT source, unnest(generate_series(min(date_trunc('month', time)), max(date_trunc('month', time)), INTERVAL 1 MONTH)) AS m FROM cells GROUP BY source)") + f"""
SELECT s.source, 'monthly' AS aggregation, CASE v.variable WHEN 'tmax' THEN 'monthly_max_temperature' WHEN 'precipitation' THEN 'monthly_precipitation_sum'
  WHEN 'temperature' THEN 'monthly_mean_temperature' ELSE 'monthly_mean_soil_moisture' END AS variable, CAST(year(s.m) AS INTEGER) AS year, CAST(month(s.m) AS INTEGER) AS month,
  {R("coalesce(p.v, CASE WHEN v.variable = 'precipitation' THEN 0 END)")} AS value
FROM spine s JOIN (SELECT DISTINCT source, variable FROM cells) v ON s.source = v.source
LEFT JOIN pm p ON p.source = s.source AND p.variable = v.variable AND p.m = CAST(s.m AS DATE)""")
def monthly_climate(spark, d):
    return show(G.monthly_climate(cells(spark, d)), ["source", "aggregation", "variable", "year", "month"], ["value"])


@query("growing_season_climate", with_sql(CELLS, "season AS (SELECT *, CAST(year(time) AS INTEGER) AS year FROM cells WHERE month(time) IN (6, 7, 8, 9))", N_CELLS.format(src="season"),
  "pc AS (SELECT source, variable, lat, lon, year, avg(value) AS a, max(value) AS x, sum(value) AS s FROM season GROUP BY ALL)") + f"""
SELECT pc.source, 'growing_season' AS aggregation, CASE variable WHEN 'tmax' THEN 'growing_season_max_temperature' WHEN 'precipitation' THEN 'growing_season_precipitation_sum'
  WHEN 'temperature' THEN 'growing_season_mean_temperature' ELSE 'growing_season_mean_soil_moisture' END AS variable, year,
  {R(f"CASE {_HOW} WHEN 'max' THEN avg(x) WHEN 'sum' THEN sum(s) / any_value(n) ELSE avg(a) END")} AS value
FROM pc JOIN nc ON pc.source = nc.source GROUP BY pc.source, pc.variable, year""")
def growing_season_climate(spark, d):
    return show(G.growing_season_climate(cells(spark, d), I.MONTHS), ["source", "aggregation", "variable", "year"], ["value"])


@query("grid_extremes", with_sql(CELLS, "season AS (SELECT * FROM cells WHERE month(time) IN (6, 7, 8, 9) AND variable IN ('tmax', 'soil_moisture'))",
  N_CELLS.format(src="season"), "days AS (SELECT source, lat, lon, time, max(value) FILTER (variable = 'tmax') AS t, max(value) FILTER (variable = 'soil_moisture') AS d FROM season GROUP BY ALL)",
  "marks AS (SELECT source, lat, lon, quantile_cont(t, 0.9) AS h, quantile_cont(t, 0.95) AS vh, quantile_cont(d, 0.1) AS dq FROM days WHERE year(time) BETWEEN 1995 AND 1999 GROUP BY ALL)",
  "fl AS (SELECT d.source, CAST(year(d.time) AS INTEGER) AS year, coalesce(t > h, false) AS hot, coalesce(t > vh, false) AS very, coalesce(d.d < dq, false) AS dry FROM days d LEFT JOIN marks m ON d.source = m.source AND d.lat = m.lat AND d.lon = m.lon)",
  "tot AS (SELECT source, year, count(*) FILTER (hot) AS hot_days, count(*) FILTER (very) AS very_hot_days, count(*) FILTER (dry) AS dry_days, count(*) FILTER (hot AND dry) AS compound_hot_dry_days FROM fl GROUP BY source, year)",
  "tall AS (UNPIVOT tot ON hot_days, very_hot_days, dry_days, compound_hot_dry_days INTO NAME variable VALUE k)") + f"""
SELECT t.source, 'extremes' AS aggregation, variable, year, {R('k / n')} AS value FROM tall t JOIN nc ON t.source = nc.source""")
def grid_extremes(spark, d):
    return show(G.grid_extremes(cells(spark, d), "tmax", "soil_moisture", I.BASELINE, I.MONTHS), ["source", "aggregation", "variable", "year"], ["value"])


@query("remote_season", with_sql(CELLS, "ser AS (SELECT source, variable, time, avg(value) AS v FROM cells WHERE month(time) IN (6, 7, 8, 9) GROUP BY ALL)") + f"""
SELECT source, variable, CAST(year(time) AS INTEGER) AS year, {R("CASE WHEN variable = 'precipitation' THEN sum(v) ELSE avg(v) END")} AS value FROM ser GROUP BY source, variable, year(time)""")
def remote_season(spark, d):
    return show(G.remote_season(cells(spark, d), I.MONTHS, summed=("precipitation",)), ["source", "variable", "year"], ["value"])


@query("zone_season_value", with_sql(CELLS, EXTENTS, "zc AS (SELECT zone_id, variable, time, value FROM cells JOIN boxes ON lon BETWEEN x1 AND x2 AND lat BETWEEN y1 AND y2 WHERE month(time) IN (6, 7, 8, 9))",
  "st AS (SELECT zone_id, variable, time, sum(value) AS s, count(*) AS n FROM zc GROUP BY ALL)") + f"""
SELECT zone_id, variable, CAST(year(time) AS INTEGER) AS year, {R("CASE WHEN variable = 'precipitation' THEN sum(s / n) ELSE sum(s) / sum(n) END")} AS value FROM st GROUP BY zone_id, variable, year(time)""")
def zone_season_value(spark, d):
    season = cells(spark, d).where(F.month("time").isin(*I.MONTHS))
    return show(G.zone_season(Z.join_zones(season, boxes(spark, d), polygon=False), "zone_id"), ["zone_id", "variable", "year"], ["value"])


STATS = ("mean", "median", "min", "max", "std")


@query("zone_stats", with_sql(POINTS, INSIDE) + f"""
SELECT zone_id, {R('avg(c_acctbal)')} AS mean, {R('median(c_acctbal)')} AS median, {R('min(c_acctbal)')} AS "min", {R('max(c_acctbal)')} AS "max",
  {R('stddev_pop(c_acctbal)')} AS std, count(*) AS valid_pixel_count FROM inside WHERE c_custkey % 7 > 0 GROUP BY zone_id""")
def zone_stats(spark, d):
    values = points(spark, d).withColumn("value", F.when(F.col("c_custkey") % 7 > 0, F.col("c_acctbal")))
    return show(G.zone_stats(Z.join_zones(values, polygons(spark, d)), "zone_id", "value"), ["zone_id", "valid_pixel_count"], STATS)


@query("zonal_proxy", with_sql(POINTS, INSIDE) + f"""
SELECT p.zone_id, count(value) AS valid_pixel_count, {R('sum(value)', 4)} AS raw_proxy_value, {R('sum(value) * 1000', 2)} AS raw_proxy_production_ton,
  CAST(NULL AS DOUBLE) AS raw_proxy_yield
FROM polys p LEFT JOIN (SELECT zone_id, CASE WHEN c_custkey % 7 > 0 THEN c_acctbal END AS value FROM inside) i ON p.zone_id = i.zone_id GROUP BY p.zone_id""")
def zonal_proxy(spark, d):
    values = points(spark, d).withColumn("value", F.when(F.col("c_custkey") % 7 > 0, F.col("c_acctbal")))
    cells_in = Z.join_zones(values, polygons(spark, d))
    zones = I.table(spark, d, "nation").select(F.col("n_nationkey").alias("zone_id"))
    out = G.zonal_proxy(zones, cells_in, "zone_id", production=True, factor=1000.0)
    return out.select("zone_id", "valid_pixel_count", rounded("raw_proxy_value", 4).alias("raw_proxy_value"),
                      rounded("raw_proxy_production_ton", 2).alias("raw_proxy_production_ton"), "raw_proxy_yield")


@query("zonal_crop_area", with_sql(POINTS, INSIDE, """m AS (SELECT zone_id, c_mktsegment AS source,
   sum(CASE WHEN c_custkey % 3 = 0 AND zone_id % 7 > 0 THEN abs(0.01 * 111320.0 * cos(radians(lat)) * 0.01 * 111320.0) / 10000.0 ELSE 0 END) AS a FROM inside GROUP BY ALL)""",
   "z AS (SELECT zone_id, sum(a) AS area, string_agg(source, ';' ORDER BY source) FILTER (a > 0) AS files FROM m GROUP BY zone_id)") + f"""
SELECT p.zone_id, {R('coalesce(area, 0)', 4)} AS crop_area_ha, {R('greatest(0, least(1, coalesce(area, 0) / (1000.0 * (p.zone_id + 1))))')} AS crop_fraction, coalesce(files, '') AS source_file,
  CASE WHEN area > 0 THEN 'zonal_stats' WHEN area IS NOT NULL THEN 'no_crop_observed' ELSE 'no_overlap' END AS status
FROM polys p LEFT JOIN z ON p.zone_id = z.zone_id""")
def zonal_crop_area(spark, d):
    masks = Z.join_zones(points(spark, d), polygons(spark, d)).select(
        "zone_id", F.col("c_mktsegment").alias("source"),
        F.when((F.col("c_custkey") % 3 == 0) & (F.col("zone_id") % 7 > 0), 1).otherwise(0).alias("mask"),
        cell_area_ha(F.lit(0.01), F.lit(0.01), F.col("lat")).alias("area_ha"))
    zones = I.table(spark, d, "nation").select(F.col("n_nationkey").alias("zone_id"), (F.lit(1000.0) * (F.col("n_nationkey") + 1)).alias("zone_ha"))
    out = G.zonal_crop_area(zones, masks, "zone_id", "zone_ha")
    return out.select("zone_id", rounded("crop_area_ha", 4).alias("crop_area_ha"), rounded("crop_fraction").alias("crop_fraction"), "source_file", "status")


@query("zonal_doy_mean", with_sql(POINTS, INSIDE) + f"""
SELECT zone_id, o_orderstatus AS stage, {R('avg(v)')} AS mean_doy FROM (
  SELECT zone_id, o_orderstatus, dayofyear(o_orderdate) + (o_orderkey % 5 - 2) * 100 AS v FROM orders JOIN inside ON o_custkey = c_custkey)
WHERE v > 0 AND v <= 366 GROUP BY zone_id, o_orderstatus""")
def zonal_doy_mean(spark, d):
    zoned = Z.join_zones(points(spark, d).select("c_custkey", "lon", "lat"), polygons(spark, d)).select("c_custkey", "zone_id")
    k = F.col("o_orderkey")
    stages = I.table(spark, d, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("stage"),
        (F.dayofyear("o_orderdate") + (k % 5 - 2) * 100).alias("value"))
    return show(G.zonal_doy_mean(stages.join(zoned, "c_custkey"), "zone_id"), ["zone_id", "stage"], ["mean_doy"])


@query("daily_zone_reduce", f"""
WITH t AS (SELECT s_nationkey AS zone, CAST(l_shipdate AS DATE) AS date, avg(l_quantity + 273.15 - 273.15) AS tmax_c FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
p AS (SELECT c_nationkey AS zone, CAST(o_orderdate AS DATE) AS date, sum(CAST(round(o_totalprice * 100) AS BIGINT)) / 9999.991 / count(*) AS precipitation_mm FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT coalesce(t.zone, p.zone) AS zone, CAST(coalesce(t.date, p.date) AS VARCHAR) AS date, CAST(year(coalesce(t.date, p.date)) AS INTEGER) AS year,
  CAST(month(coalesce(t.date, p.date)) AS INTEGER) AS month, {R('tmax_c')} AS tmax_c, {R('precipitation_mm')} AS precipitation_mm
FROM t FULL OUTER JOIN p ON t.zone = p.zone AND t.date = p.date""")
def daily_zone_reduce(spark, d):
    suppliers = I.table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("zone"))
    customers = I.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("zone"))
    heat = I.table(spark, d, "lineitem").join(suppliers, "l_suppkey").select(
        "zone", F.to_date("l_shipdate").alias("date"), (F.col("l_quantity") + 273.15).alias("value"))
    rain = I.table(spark, d, "orders").join(customers, "o_custkey").select(
        "zone", F.to_date("o_orderdate").alias("date"), (F.round(F.col("o_totalprice") * 100).cast("bigint") / F.lit(9999.991)).alias("value"))
    out = G.daily_zone_reduce(heat, rain, "zone").withColumn("date", F.col("date").cast("string"))
    return show(out, ["zone", "date", "year", "month"], ["tmax_c", "precipitation_mm"])


NAMES = ("T2M", "temp", "T_Max", "tasmax", "Precip", "tp", "swvl1", "SM", "pev", "SPEI", "u10", "et", "lat", "total precipitation")
_ROLE_ROWS = ", ".join(f"('{role}', '{n.replace('_', '')}', {i})" for role, ns in L.CLIMATE_VARIABLES.items() for i, n in enumerate(ns))


@query("variable_role_map", f"""
WITH v AS (SELECT DISTINCT l_suppkey AS source, {choose_sql(NAMES, 'l_partkey')} AS name FROM lineitem),
r AS (SELECT * FROM (VALUES {_ROLE_ROWS}) t(role, plain, rank)),
m AS (SELECT source, role, name, row_number() OVER (PARTITION BY source, role ORDER BY rank, name) AS k FROM v JOIN r ON plain = regexp_replace(lower(name), '[ _-]', '', 'g'))
SELECT source, role, name FROM m WHERE k = 1""")
def variable_role_map(spark, d):
    rows = I.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("source"), choose(NAMES, F.col("l_partkey")).alias("name"))
    return L.variable_roles(rows, "source", "name", L.CLIMATE_VARIABLES)
