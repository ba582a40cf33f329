from fieldframe.operators import fields as R


def test_field_choices(spark):
    rows = [("nan", "A", 2000, None, "x", 1.0, 2.0), ("", "B", 2001, None, "y", 1.0, 3.0), ("7", "C", 2002, None, "z", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "admin_id string, province string, year int, yield_anomaly_pct double, crop string, chd_annual double, exposure_index double")
    assert R.unit_key(df) == "admin_id" and R.unit_key(df, share=0.5) == "province"
    assert R.unit_field(df.drop("admin_id"), "admin_id") == "province"
    assert R.outcome_field(df, "yield_anomaly_pct") == "yield_anomaly_pct"
    assert R.outcome_field(df.withColumnRenamed("chd_annual", "yield"), "missing") == "yield"
    assert R.varying_fields(df, ["crop", "chd_annual", "exposure_index", "none"]) == ["exposure_index"]
    assert R.exposure_field(df, "chd_annual", "any", 0.9) == "exposure_index"
    assert R.predictors(df, "yield_anomaly_pct", "chd_annual", "province") == ["exposure_index"]
    assert R.unit_key(df.select("year")) is None
