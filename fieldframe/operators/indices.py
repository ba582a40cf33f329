"""Trends, anomalies, standardised scores, stability and exposure indices.

Whole-group statistics are aggregated first (combined before the shuffle) and joined
back, so one very large group does not land in a single window task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldframe.operators.scalars import with_row
from fieldframe.functions.numbers import as_number, flag, row_mean, row_sum
from fieldframe.operators.quantiles import bounded_quantile, exact_quantiles


def _line(year: Column, value: Column, kept: Column) -> tuple[Column, Column]:
    """Slope and intercept over the kept points; one distinct year gives a flat line."""
    x, y = F.when(kept, year), F.when(kept, value)
    slope = F.coalesce(F.regr_slope(y, x), F.lit(0.0))
    return slope, F.coalesce(F.regr_intercept(y, x), F.avg(y))


def baseline_trend(df: DataFrame, keys: Sequence[str], value: str, baseline: tuple[int, int],
                   min_points: int = 2) -> DataFrame:
    """Linear trend per group fitted on baseline years; groups with too few points stay without one."""
    low, high = min(baseline), max(baseline)
    year = (F.col("year") - F.lit(low)).cast("double")
    kept = F.col("year").between(low, high) & F.col(value).isNotNull()
    slope, intercept = _line(year, F.col(value), kept)
    fitted = (
        df.where(kept)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("_n"), slope.alias("_slope"), intercept.alias("_intercept"),
            F.avg(value).alias("baseline_mean"), F.stddev_samp(value).alias("baseline_std"),
        )
        .where(F.col("_n") >= max(2, min_points))
    )
    joined = df.join(fitted, list(keys), "left")
    return joined.withColumn("trend_yield", F.col("_intercept") + F.col("_slope") * year).drop(
        "_n", "_slope", "_intercept"
    )


def outcome_trend(df: DataFrame, unit: str, value: str, baseline: tuple[int, int], min_points: int = 2) -> DataFrame:
    """Trend fitted on all years of the window, gated by the number of baseline points.

    A unit below the gate takes its baseline mean as the trend.
    """
    low, high = min(baseline), max(baseline)
    year = (F.col("year") - F.lit(low)).cast("double")
    inside = F.when(F.col("year").between(low, high), F.col(value))
    slope, intercept = _line(year, F.col(value), F.col(value).isNotNull())
    fitted = df.groupBy(unit).agg(
        F.count(inside).alias("_n"), slope.alias("_slope"), intercept.alias("_intercept"),
        F.avg(inside).alias("baseline_mean"), F.stddev_samp(inside).alias("baseline_std"),
    )
    line = F.col("_intercept") + F.col("_slope") * year
    trend = F.when(F.col("_n") >= max(2, min_points), line).otherwise(F.col("baseline_mean"))
    out = df.join(fitted, unit, "left").withColumn("trend_yield", trend)
    gap = F.col(value) - F.col("trend_yield")
    return out.withColumns({
        "yield_anomaly_abs": gap, "yield_anomaly_pct": F.try_divide(gap, F.col("trend_yield")) * 100.0,
    }).drop("_n", "_slope", "_intercept")


def rolling_cv(df: DataFrame, keys: Sequence[str], value: str, window: int, out: str) -> DataFrame:
    """Sample deviation over absolute mean of the last ``window`` valid values up to each row.

    Valid values are numbered, and a range frame over that number spans exactly the last
    ones, so no history array is built. A group holds one row per year.
    """
    running = Window.partitionBy(*keys).orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    last = Window.partitionBy(*keys).orderBy("_valid").rangeBetween(1 - window, 0)
    mean = F.avg(value).over(last)
    spread = F.lit(0.0) if window == 1 else F.stddev_samp(value).over(last)
    return (
        df.withColumn("_valid", F.count(value).over(running))
        .withColumn(out, F.when(F.col("_valid") >= window, F.try_divide(spread, F.abs(mean))))
        .drop("_valid")
    )


def downside_and_recovery(df: DataFrame, value: str, trend: str, event_year: int,
                          recovery_years: Sequence[int]) -> DataFrame:
    """Shortfall below trend, the event-year loss, and actual over trend in recovery years."""
    loss = F.greatest(F.lit(0.0), F.col(trend) - F.col(value))
    both = F.col(trend).isNotNull() & F.col(value).isNotNull()
    columns = {
        "downside_risk": F.when(both, loss),
        "event_loss": F.when(both & (F.col("year") == event_year), loss),
    }
    for year in recovery_years:
        columns[f"recovery_{year}"] = F.when(F.col("year") == year, F.try_divide(F.col(value), F.col(trend)))
    return df.withColumns(columns)


def max_duration(df: DataFrame, unit: str, order: Sequence[Column], flagged: Column, bucket: Column, out: str) -> DataFrame:
    """Longest run of true flags per unit.

    ``bucket`` must grow with the order (a day, a month): runs are measured inside unit
    and bucket, then short bucket summaries are chained, so even one unit holding most
    rows is spread over its buckets.
    """
    inside = Window.partitionBy(unit, "_bucket").orderBy(*order)
    rows = df.withColumn("_flag", F.coalesce(flagged, F.lit(False))).withColumn("_bucket", bucket)
    numbered = rows.withColumn("_rn", F.row_number().over(inside)).withColumn(
        "_breaks", F.sum(F.when(F.col("_flag"), 0).otherwise(1)).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )
    runs = numbered.groupBy(unit, "_bucket", "_breaks").agg(
        F.count_if(F.col("_flag")).alias("_run"), F.count(F.lit(1)).alias("_rows"),
    )
    last = F.max("_breaks")
    summaries = runs.groupBy(unit, "_bucket").agg(
        F.sum("_rows").alias("_n"), F.max("_run").alias("_best"),
        F.coalesce(F.max(F.when(F.col("_breaks") == 0, F.col("_run"))), F.lit(0)).alias("_prefix"),
        F.max_by("_run", "_breaks").alias("_suffix"),
        (last == 0).alias("_all"),
    )
    chain = Window.partitionBy(unit).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ended = summaries.withColumn(
        "_link", F.coalesce(F.sum(F.when(F.col("_all"), 0).otherwise(1)).over(chain), F.lit(0))
    )
    parts = ended.select(
        unit, "_best",
        F.explode(
            F.when(F.col("_all"), F.array(F.struct(F.col("_link").alias("link"), F.col("_n").alias("len")))).otherwise(
                F.array(
                    F.struct(F.col("_link").alias("link"), F.col("_prefix").alias("len")),
                    F.struct((F.col("_link") + 1).alias("link"), F.col("_suffix").alias("len")),
                )
            )
        ).alias("_p"),
    )
    links = parts.groupBy(unit, F.col("_p.link")).agg(F.sum("_p.len").alias("_len"), F.max("_best").alias("_best"))
    return links.groupBy(unit).agg(F.greatest(F.max("_len"), F.max("_best")).alias(out))


def zscores_within_unit(df: DataFrame, unit: str, columns: Mapping[str, str]) -> DataFrame:
    """Score columns ``{out: value}`` within the unit; a column that varies in no unit is scored within the year.

    Zero deviation yields null. All columns share one aggregate and one join per key.
    """
    names = list(columns.items())

    def moments(key: str, tag: str) -> DataFrame:
        parts = [f for i, (_, v) in enumerate(names) for f in (
            F.avg(v).alias(f"_{tag}m{i}"), F.nullif(F.stddev_samp(v), F.lit(0.0)).alias(f"_{tag}s{i}"))]
        return df.groupBy(key).agg(*parts)

    units, years = moments(unit, "u"), moments("year", "y")
    usable = units.agg(*[(F.count(f"_us{i}") > 0).alias(f"_ok{i}") for i in range(len(names))])  # one row
    joined = with_row(df.join(units, unit, "left").join(years, "year", "left"), usable)
    score = lambda i, v, tag: (F.col(v) - F.col(f"_{tag}m{i}")) / F.col(f"_{tag}s{i}")
    scored = {
        out: F.when(F.col(f"_ok{i}"), score(i, v, "u")).otherwise(score(i, v, "y")) for i, (out, v) in enumerate(names)
    }
    kept = [c for c in df.columns if c not in scored]
    return joined.withColumns(scored).select(*kept, *scored)


def zscore_within_unit(df: DataFrame, unit: str, value: str, out: str) -> DataFrame:
    """One score column within the unit."""
    return zscores_within_unit(df, unit, {out: value})


def exposure_index(df: DataFrame, heat: Sequence[str], dry: Sequence[str]) -> DataFrame:
    """Heat component, drought component and their sum from scores over all rows."""
    columns = [*heat, *dry]
    stats = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"_s_{c}") for c in columns])
    score = lambda c: F.when(
        F.col(c).isNotNull(),
        F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0),
    )
    out = with_row(df, stats)
    hot = row_mean(*[score(c) for c in heat]) if heat else F.lit(None).cast("double")
    parched = row_mean(*[-score(c) for c in dry]) if dry else F.lit(None).cast("double")
    out = out.withColumns({"heat_component": hot, "drought_component": parched})
    return out.withColumn("exposure_index", row_sum("heat_component", "drought_component")).select(
        *df.columns, "heat_component", "drought_component", "exposure_index"
    )


def zscore_outliers(df: DataFrame, group: str, value: str, out: str, limit: float = 3.0) -> DataFrame:
    """0/1 flag where the population score exceeds the limit; small or flat groups have none."""
    stats = df.groupBy(group).agg(
        F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"), F.count(value).alias("_n")
    )
    usable = (F.col("_n") >= 2) & (F.col("_s") > 0)
    score = F.abs((F.col(value) - F.col("_m")) / F.when(usable, F.col("_s")))
    return df.join(stats, group).withColumn(out, flag(score > limit)).drop("_m", "_s", "_n")


def first_column(df: DataFrame, tokens: Sequence[str], exclude: Sequence[str] = (), counts: dict | None = None) -> str | None:
    """Column whose name is, else contains, a token and that holds a number; exact names first."""
    names = [c for c in df.columns if c not in exclude]
    exact = [c for c in names if c.lower() in tokens]
    near = [c for c in names if any(t in c.lower() for t in tokens) and c not in exact]
    candidates = exact + near
    if not candidates:
        return None
    filled = counts if counts is not None else numeric_counts(df, candidates)
    return next((c for c in candidates if filled.get(c, 0) > 0), None)


def numeric_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Number of usable numbers per column, one aggregate for all columns."""
    return df.agg(*[F.count(as_number(c)).alias(c) for c in columns]).first().asDict()


def threshold_chd(df: DataFrame, unit: str | None, tmax: str, precip: str, baseline: tuple[int, int]) -> DataFrame:
    """1 when the year is hotter than the unit's baseline 90 % and drier than its 10 % mark.

    Units without baseline values take the quantiles over all baseline rows. The unit
    quantiles are over years, hence bounded.
    """
    base = df.where(F.col("year").between(*baseline))
    cuts = exact_quantiles(base, [], {"_hot_all": (tmax, 0.90), "_dry_all": (precip, 0.10)})
    out = df
    if unit:
        groups = base.groupBy(unit).agg(
            bounded_quantile(F.col(tmax), 0.90).alias("_hot"), bounded_quantile(F.col(precip), 0.10).alias("_dry")
        )
        out = out.join(groups, unit, "left")
    else:
        out = out.withColumns({"_hot": F.lit(None).cast("double"), "_dry": F.lit(None).cast("double")})
    out = with_row(out, cuts)
    both = (F.col(tmax) > F.coalesce("_hot", "_hot_all")) & (F.col(precip) < F.coalesce("_dry", "_dry_all"))
    return out.withColumn("chd_annual", flag(both)).drop("_hot", "_dry", "_hot_all", "_dry_all")


ANOMALY_SOURCES = {
    "tmax_anomaly": ("tmax", "max_temperature", "maximum_temperature", "lst"),
    "precip_anomaly": ("precipitation", "precip", "rain"),
    "soil_moisture_anomaly": ("soil_moisture", "sm"),
    "lst_anomaly": ("lst", "land_surface_temperature"),
    "ndvi_anomaly": ("ndvi",),
    "evi_anomaly": ("evi",),
    "et_anomaly": ("et", "evapotranspiration"),
}


def add_anomalies(df: DataFrame, unit: str) -> DataFrame:
    """Score column for each known variable family that the panel carries."""
    counts = numeric_counts(df, [c for c in df.columns if c not in (unit, "year")])
    found = {
        target: first_column(df, tokens, exclude=(target, unit, "year"), counts=counts) for target, tokens in ANOMALY_SOURCES.items()
    }
    scored = zscores_within_unit(df, unit, {t: c for t, c in found.items() if c}) if any(found.values()) else df
    return scored.withColumns({t: F.lit(None).cast("double") for t, c in found.items() if not c})


def add_chd_annual(df: DataFrame, unit: str | None, baseline: tuple[int, int]) -> DataFrame:
    """Annual exposure by the first branch the panel supports as a whole.

    Day counts; else thresholds on annual temperature and precipitation (three baseline
    rows at least); else a ready exposure column; else heat minus moisture anomalies.
    One aggregate over the panel decides.
    """
    counts = df.agg(
        *[F.count(as_number(c)).alias(c) for c in df.columns if c != unit],
        F.count_if(F.col("year").between(*baseline)).alias("_base"),
    ).first().asDict()
    if counts.get("hot_days", 0) and counts.get("dry_days", 0):
        compound = as_number("compound_hot_dry_days") if counts.get("compound_hot_dry_days", 0) else flag(
            (as_number("hot_days") > 0) & (as_number("dry_days") > 0))
        return df.withColumn("compound_hot_dry_days", compound).withColumn("chd_annual", F.col("compound_hot_dry_days"))
    tmax = first_column(df, ("tmax", "max_temperature", "maximum_temperature"), ("tmax_anomaly",), counts)
    precip = first_column(df, ("precipitation", "precip", "rain"), ("precip_anomaly",), counts)
    if tmax and precip and counts["_base"] >= 3:
        return threshold_chd(df, unit, tmax, precip, baseline)
    ready = first_column(df, ("exposure_index", "chd_intensity", "chd_annual"), ("chd_annual",), counts)
    if ready:
        return df.withColumn("chd_annual", as_number(ready))
    have = lambda names: [as_number(n) for n in names if n in df.columns]
    heat, moist = have(["tmax_anomaly", "lst_anomaly"]), have(["precip_anomaly", "soil_moisture_anomaly"])
    none = F.lit(None).cast("double")
    return df.withColumn("chd_annual", row_sum(
        row_mean(*heat) if heat else none, row_mean(*[-m for m in moist]) if moist else none))
