"""Known answers of panel, zone and quality operators."""

import pytest
from pyspark.sql import functions as F

from fieldframe.operators import grid as G
from fieldframe.operators import zones as Z
from fieldframe.operators import indices as X
from fieldframe.operators import joins as J
from fieldframe.operators import panel as P
from fieldframe.operators import quality as Q
from fieldframe.operators import records as O


def test_weighted_mean(spark):
    rows = [("江苏省", "32", 2021, 1.0, 1, 1), ("江苏省", "32", 2021, 3.0, 3, 2), ("江苏省", None, 2022, 8.0, 0, 3), ("", "1", 2022, 9.0, 1, 4)]
    df = spark.createDataFrame(rows, "province string, province_code string, year int, chd_annual double, rice_area_ha int, i int")
    out = {r["year"]: r for r in P.weighted_zone_mean(df, ["province", "year"], ["chd_annual"], ["rice_area_ha"], ["province_code"], "i").collect()}
    assert out[2021]["chd_annual"] == 2.5 and out[2021]["aggregation_weight"] == "rice_area_ha"
    assert out[2022]["chd_annual"] == 8.0 and out[2022]["province_code"] == "" and len(out) == 2


def test_calibration(spark):
    proxy = spark.createDataFrame([("a", "P", 2000, 5000.0, None, 1.0), ("b", "P", 2000, 6000.0, None, 1.0)],
                                  "admin_id string, province string, year int, raw_proxy_yield double, raw_proxy_production_ton double, rice_area_proxy double")
    official = spark.createDataFrame([("P", 2000, "rice", 22.0)], "province string, year int, crop string, production_ton double")
    out = P.province_calibration(proxy, official, None, "crop").orderBy("admin_id").collect()
    assert [r["calibration_coefficient"] for r in out] == [2.0, 2.0]
    assert [r["calibrated_yield"] for r in out] == [10000.0, 12000.0]
    gated = P.province_calibration(proxy, official.withColumn("sown_area_hectare", F.lit(10.0)), "sown_area_hectare", "crop")
    assert {r["calibration_status"] for r in gated.collect()} == {"missing_official_or_proxy"}


def test_trend_and_anomaly(spark):
    df = spark.createDataFrame([("A", 2000, 100.0), ("A", 2001, 110.0), ("A", 2002, 90.0)], "u string, year int, y double")
    row = X.baseline_trend(df, ["u"], "y", (2000, 2001)).where("year = 2002").withColumns(
        O.yield_anomaly(F.col("y"), F.col("trend_yield"), F.col("baseline_mean"), F.col("baseline_std"))).first()
    assert (row["trend_yield"], row["yield_anomaly_abs"], row["yield_anomaly_pct"]) == (pytest.approx(120), pytest.approx(-30), pytest.approx(-25))


def test_regional_rows_reach_every_unit(spark):
    rows = spark.createDataFrame([(2000, "t", 29.0), (2000, "t", 30.0)], "year int, variable string, value double")
    units = spark.createDataFrame([("a",), ("b",)], "admin_id string")
    wide = J.broadcast_to_units(rows, units)
    assert wide.count() == 4
    none = F.lit(None).cast("double")
    stats = O.row_stats(wide.withColumns({c: none for c in ("mean", "median", "min", "max", "std", "valid_pixel_count")}))
    out = P.collapse_panel(stats.withColumns({"month": F.lit(None).cast("int"), "source_panel": F.lit("s")}), ["admin_id", "year", "month", "variable", "source_panel"])
    assert {(r["admin_id"], r["mean"], r["median"], r["valid_pixel_count"]) for r in out.collect()} == {("a", 29.5, 29.5, 2), ("b", 29.5, 29.5, 2)}


def test_crop_area_of_two_boxes(spark):
    ring = lambda x: [(x, 0.0), (x + 2, 0.0), (x + 2, 4.0), (x, 4.0), (x, 0.0)]
    zones = spark.createDataFrame([("w", ring(0.0), 0.0008), ("e", ring(2.0), 0.0008)], "zone_id string, ring array<struct<x:double,y:double>>, zone_ha double")
    mask = [(0, 0), (1, 1), (0, 3), (2, 0), (3, 2), (2, 3)]
    cells = spark.createDataFrame([(x + 0.5, y + 0.5, int((x, y) in mask)) for x in range(4) for y in range(4)], "lon double, lat double, mask int")
    zoned = Z.join_zones(cells, Z.zones_from_rings(zones, "ring")).withColumns({"area_ha": F.lit(0.0001), "source": F.lit("m.tif")})
    out = {r["zone_id"]: r for r in G.zonal_crop_area(zones, zoned, "zone_id", "zone_ha").collect()}
    for zone in ("w", "e"):
        assert out[zone]["crop_area_ha"] == pytest.approx(0.0003) and out[zone]["crop_fraction"] == pytest.approx(0.375)
        assert out[zone]["status"] == "zonal_stats" and out[zone]["source_file"] == "m.tif"


def test_zone_join_is_an_equality_join(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (0.0, 4.0), (0.0, 0.0)]
    zones = Z.zones_from_rings(spark.createDataFrame([(1, ring)], "zone_id int, ring array<struct<x:double,y:double>>"), "ring")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 3.0), (3, 9.0, 9.0)], "id int, lon double, lat double")
    out = Z.point_in_zone(points, zones, "id", "zone_id")
    assert {(r["id"], r["zone_id"]) for r in out.collect()} == {(1, 1), (2, None), (3, None)}
    for how in ("inner", "left"):
        plan = Z.join_zones(points, zones, how=how)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_calendar_months_are_filled(spark):
    rows = [("s", "precipitation", 1.0, 1.0, "2000-01-05", 4.0), ("s", "precipitation", 1.0, 2.0, "2000-03-05", 2.0), ("s", "tmax", 1.0, 1.0, "2000-01-05", 9.0)]
    cells = spark.createDataFrame(rows, "source string, variable string, lat double, lon double, time string, value double").withColumn("time", F.to_date("time"))
    out = {(r["variable"], r["month"]): r["value"] for r in G.monthly_climate(cells).collect()}
    assert out == {("monthly_precipitation_sum", 1): 2.0, ("monthly_precipitation_sum", 2): 0.0, ("monthly_precipitation_sum", 3): 1.0,
                   ("monthly_max_temperature", 1): 9.0, ("monthly_max_temperature", 2): None, ("monthly_max_temperature", 3): None}


@pytest.mark.parametrize("columns,expected", [
    ({"hot_days": 3, "dry_days": 2, "compound_hot_dry_days": 1}, 1), ({"hot_days": 3, "dry_days": 2}, 1),
    ({"exposure_index": 0.5}, 0.5), ({"tmax_anomaly": 1.0, "precip_anomaly": -2.0}, 3.0)])
def test_exposure_branches(spark, columns, expected):
    df = spark.createDataFrame([("a", 2020)], "province string, year int").withColumns({k: F.lit(float(v)) for k, v in columns.items()})
    assert X.add_chd_annual(df, "province", (2000, 2021)).first()["chd_annual"] == expected


def test_scores_fall_back_to_years(spark):
    df = spark.createDataFrame([("a", 2000, 1.0), ("b", 2000, 3.0), ("c", 2001, 5.0)], "u string, year int, v double")
    out = {r["u"]: r["z"] for r in X.zscore_within_unit(df, "u", "v", "z").collect()}
    assert out["a"] == pytest.approx(-0.70710678) and out["b"] == pytest.approx(0.70710678) and out["c"] is None


@pytest.mark.parametrize("level,crop,tier", [("county", "rice", "tier_1"), ("prefecture", "grain", "tier_2"), ("province", "grain", "tier_3")])
def test_tiers(spark, level, crop, tier):
    df = spark.createDataFrame([(level, crop, False, True, 2000)], "admin_level string, crop_type string, is_proxy boolean, usable boolean, year int")
    assert Q.data_tier(df)["tier"] == tier
    assert Q.data_tier(df.withColumn("is_proxy", F.lit(True)))["tier"] == "tier_4"


def test_gate_needs_every_check(spark):
    one = spark.range(1).withColumns({"c": F.lit(0.9), "w": F.lit(0.95)})
    given = spark.createDataFrame([("pretrend_test_passed", "1"), ("placebo_tests_passed", "True"), ("robustness_direction_stable", "yes"),
                                   ("mechanism_remote_sensing_consistent", "passed")], "gate string, passed string")
    facts = spark.createDataFrame([("tier_3", "province", "grain", "province_grain_yield_anomaly", 0.9, 0.9, 0.9, True)],
                                  "tier string, admin_level string, crop_type string, outcome_type string, coverage_rate double, exposure_rate double, outcome_rate double, has_event boolean")
    full = Q.model_scope(facts, Q.causal_gate(F.col("c"), F.col("w"), given, one)).first()
    assert full["conclusion_strength"] == "quasi_causal_evidence" and full["primary_model"] == "province_two_way_fixed_effects"
    partly = Q.model_scope(facts, Q.causal_gate(F.col("c"), F.col("w"), given.where("gate <> 'placebo_tests_passed'"), one)).first()
    assert partly["conclusion_strength"] == "impact_assessment" and partly["gates_missing"] == 1


def test_diagnosis_of_event_only_exposure(spark):
    df = spark.createDataFrame([("A", 2021, None), ("A", 2022, "1.0"), ("B", 2022, "2.0"), ("B", 2021, " ")], "province string, year int, exposure_index string")
    out = {(r["section"], r["metric"]): r["value"] for r in Q.exposure_diagnosis(df, "chd_annual", {}, 2022).collect()}
    assert out[("summary", "exposure_coverage_status")] == "ok_only_for_2022_cross_section"
    assert "only_2022_event_exposure" in out[("summary", "likely_causes")]
    assert out[("exposure", "nonmissing_by_year:2022")] == "2"


def test_pretrend(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "term string, estimate double, standard_error double")
    passed = lambda df: Q.pretrend_test(df).first()["passed"]
    assert passed(rows(("event_time_m2", 0.1, 0.1), ("event_time_p1", 9.0, 0.1)))
    assert not passed(rows(("event_time_m2", 0.3, 0.1))) and not passed(rows(("event_time_p1", 0.0, 0.1)))
    assert passed(rows(("event_time_m2", 0.05, None))) and not passed(rows(("event_time_m2", None, 0.1)))
