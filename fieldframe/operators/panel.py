"""Panel building: reshaping, weighted zone means, calibration, unions and outcome choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldframe.functions.numbers import as_number
from fieldframe.functions.text import clean_text, truthy
from fieldframe.operators.joins import align_names
from fieldframe.operators.picks import pick_one
from fieldframe.operators.quantiles import exact_quantile


def pivot_variables(long: DataFrame, keys: Sequence[str], variables: Sequence[str], variable: str = "variable",
                    value: str = "value") -> DataFrame:
    """Mean value per key and variable, one column per variable in sorted order."""
    rows = long.where(F.col(value).isNotNull() & (F.trim(F.col(variable)) != ""))
    return rows.groupBy(*keys).pivot(variable, sorted(variables)).agg(F.avg(value))


def weight_column(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """First candidate with a positive value anywhere in the table."""
    present = [c for c in candidates if c in df.columns]
    if not present:
        return None
    counts = df.agg(*[F.count_if(as_number(c) > 0).alias(c) for c in present]).first()
    return next((c for c in present if counts[c]), None)


def weighted_zone_mean(df: DataFrame, keys: Sequence[str], values: Sequence[str], candidates: Sequence[str],
                       codes: Sequence[str], order: str) -> DataFrame:
    """Weighted mean per zone; a zone without a positive weight takes the plain mean."""
    chosen = weight_column(df, candidates)
    weight = as_number(chosen) if chosen else F.lit(None).cast("double")
    kept = [k for k in keys]
    work = df.where(F.col(kept[0]).isNotNull() & (F.trim(F.col(kept[0])) != "") & F.col("year").isNotNull())
    aggs: list[Column] = [F.count(F.lit(1)).alias("source_rows")]
    for name in values:
        value = as_number(name)
        usable = (weight > 0) & value.isNotNull()
        weighted = F.try_divide(F.sum(F.when(usable, value * weight)), F.sum(F.when(usable, weight)))
        aggs.append(F.coalesce(weighted, F.avg(value)).alias(name))
    for code in codes:
        aggs.append(F.min_by(clean_text(code), F.when(clean_text(code).isNotNull(), F.col(order))).alias(f"_{code}"))
    out = work.groupBy(*kept).agg(*aggs)
    first_code = F.coalesce(*[F.col(f"_{c}") for c in codes], F.lit("")) if codes else F.lit("")
    return out.withColumn("province_code", first_code).withColumn(
        "aggregation_weight", F.lit(chosen or "unweighted_mean")
    ).drop(*[f"_{c}" for c in codes])


def collapse_panel(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Duplicate zone rows to one: mean of means, median of medians, extremes, total cells."""
    summed = df.groupBy(*keys).agg(
        F.avg("mean").alias("mean"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.avg("std").alias("std"), F.coalesce(F.sum("valid_pixel_count"), F.lit(0)).alias("valid_pixel_count"),
    )
    medians = exact_quantile(df, keys, "median", 0.5, "median").withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return summed.join(medians, same, "left").drop(*[f"_{k}" for k in keys])


def collapse_proxy(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Seasonal proxy rows to one per key; a zero production total means none was given."""
    files = F.array_join(F.sort_array(F.collect_set(F.nullif(F.col("source_file"), F.lit("")))), "; ")
    return df.groupBy(*keys).agg(
        files.alias("source_file"),
        F.avg("raw_proxy_value").alias("raw_proxy_value"), F.avg("raw_proxy_yield").alias("raw_proxy_yield"),
        F.nullif(F.sum("raw_proxy_production_ton"), F.lit(0.0)).alias("raw_proxy_production_ton"),
        F.sum("valid_pixel_count").alias("valid_pixel_count"),
    )


def province_calibration(panel: DataFrame, official: DataFrame, area: str | None, order: str,
                         gate: tuple[float, float] = (0.8, 1.2)) -> DataFrame:
    """Scale proxy yields so that province totals meet the official ones.

    ``official`` must be the right crop only. Its first non-null production (and area) per
    province and year counts; a province-year whose area ratio is known and outside the
    gate is not calibrated.
    """
    derived = F.col("raw_proxy_yield") * F.col("rice_area_proxy") / 1000.0
    work = panel.withColumn("proxy_production_ton", F.coalesce("raw_proxy_production_ton", derived))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order)))
    totals = (
        official.where(F.col("province").isNotNull() & F.col("year").isNotNull())
        .groupBy("province", "year")
        .agg(first("production_ton").alias("_official"),
             (first(area) if area else F.max(F.lit(None).cast("double"))).alias("_area"))
    )
    proxy = work.groupBy("province", "year").agg(
        F.sum("proxy_production_ton").alias("_proxy"), F.coalesce(F.sum("rice_area_proxy"), F.lit(0.0)).alias("_parea")
    )
    share = F.try_divide(F.col("_parea"), F.col("_area"))
    coefficient = (
        totals.join(proxy, ["province", "year"])
        .withColumn("calibration_coefficient", F.try_divide("_official", "_proxy"))
        .where(share.isNull() | share.between(*gate))
        .where("calibration_coefficient is not null")
        .select("province", "year", "calibration_coefficient")
    )
    out = work.join(coefficient, ["province", "year"], "left")
    done = F.col("calibration_coefficient").isNotNull() & F.col("proxy_production_ton").isNotNull()
    production = F.col("proxy_production_ton") * F.col("calibration_coefficient")
    from_area = F.when(F.col("rice_area_proxy") > 0, F.try_divide(production * 1000.0, F.col("rice_area_proxy")))
    scaled = F.coalesce(F.col("raw_proxy_yield") * F.col("calibration_coefficient"), from_area)
    return out.withColumns({
        "calibrated_production_ton": F.when(done, production),
        "calibrated_yield": F.when(done, scaled),
        "calibration_status": F.when(done, "calibrated").otherwise("missing_official_or_proxy"),
    })


def union_dedupe(sources: Sequence[DataFrame], keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Union by name, later sources and later rows win on the key."""
    ranked = [df.withColumn("_source", F.lit(i)) for i, df in enumerate(sources)]
    merged = ranked[0]
    for df in ranked[1:]:
        merged = merged.unionByName(df, allowMissingColumns=True)
    return pick_one(merged, keys, [F.col("_source").desc(), *order]).drop("_source")


def append_backfill(primary: DataFrame, backfill: DataFrame, normal, first: Sequence[Column],
                    tie: Sequence[Column]) -> DataFrame:
    """Append backfill rows in the primary spelling; rows with a yield, then primary rows, win."""
    left = primary if "is_backfill" in primary.columns else primary.withColumn("is_backfill", F.lit(False))
    right = backfill if "is_backfill" in backfill.columns else backfill.withColumn("is_backfill", F.lit(True))
    right = align_names(left, right, "province", normal, first)
    merged = left.unionByName(right, allowMissingColumns=True)
    late = truthy("is_backfill", ("true", "1", "yes"))
    order = [F.col("yield_kg_per_hectare").isNull().asc(), late.asc(), *tie]
    return pick_one(merged, ["province", "province_code", "year", "crop"], order)


def select_outcome(df: DataFrame, rice: Sequence[str], grain: Sequence[str], event_year: int) -> tuple[DataFrame, str]:
    """Rice rows when they reach the event year, else grain rows, else whatever is there.

    One small aggregate decides; the chosen rows stay distributed.
    """
    crop = F.lower(F.trim(F.coalesce(F.col("crop"), F.lit(""))))
    value = as_number("yield_kg_per_hectare")
    is_rice, is_grain = crop.isin(*rice), crop.isin(*grain)
    work = df
    if "admin_level" in df.columns:
        at_province = F.lower(F.coalesce(F.col("admin_level"), F.lit(""))) == "province"
        if df.where(at_province).limit(1).count():
            work = df.where(at_province)
    facts = work.agg(
        F.count(F.when(is_rice, value)).alias("rice"), F.count(F.when(is_grain, value)).alias("grain"),
        F.count_if(is_rice & (F.col("year") == event_year)).alias("rice_event"),
    ).first()
    rice_name, grain_name = "province_rice_yield_anomaly", "province_grain_yield_anomaly"
    if facts["rice"] and (facts["rice_event"] or not facts["grain"]):
        return work.where(is_rice), rice_name
    if facts["grain"]:
        return work.where(is_grain), grain_name
    return work, grain_name


def proxy_bias(proxy: DataFrame, official: DataFrame, keys: Sequence[str], proxy_value: str, official_value: str,
               large: float = 5.0) -> DataFrame:
    """Percent bias of proxy against official group means: pairs, mean, largest, count beyond a limit."""
    mean = lambda df, c, out: df.where(F.col(c).isNotNull()).groupBy(*keys).agg(F.avg(c).alias(out))
    pairs = mean(proxy, proxy_value, "_p").join(mean(official, official_value, "_o"), list(keys)).where("_o <> 0")
    bias = (F.col("_p") - F.col("_o")) / F.col("_o") * 100.0
    return pairs.agg(
        F.count(F.lit(1)).alias("pairs"), F.avg(bias).alias("mean_bias_pct"),
        F.max(F.abs(bias)).alias("max_abs_bias_pct"), F.count_if(F.abs(bias) > large).alias("large_bias_count"),
    )
