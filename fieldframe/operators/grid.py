"""Cells, boxes, polygons and zones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldframe.functions.names import PROVINCE_SUFFIXES, normalize_province_name
from fieldframe.functions.numbers import flag
from fieldframe.operators.quantiles import bounded_quantile, exact_quantile
from fieldframe.session import materialize


def clip_bbox(df: DataFrame, lon: str, lat: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Inclusive box ``(x1, y1, x2, y2)``; the corners may come in any order."""
    x1, y1, x2, y2 = box
    return df.where(
        F.col(lon).between(min(x1, x2), max(x1, x2)) & F.col(lat).between(min(y1, y2), max(y1, y2))
    )


def filter_regions(df: DataFrame, name: str, wanted: Sequence[str] | str | None) -> DataFrame:
    """Rows whose normalised region name is wanted; nothing wanted, or ``all``, keeps every row."""
    if not wanted or wanted == "all" or list(wanted) == ["all"]:
        return df
    names = [wanted] if isinstance(wanted, str) else list(wanted)
    return df.where(normalize_province_name(name).isin(*[_plain_name(n) for n in names]))


def _plain_name(name: str) -> str:
    text = name.strip()
    for suffix in PROVINCE_SUFFIXES:
        text = text.removesuffix(suffix)
    return text


# --- zones as boxes; polygons are in ``zones`` -----------------------------------------------

def zone_boxes(extents: DataFrame, zone: str) -> DataFrame:
    """Union of many extents to one box per zone."""
    return extents.groupBy(zone).agg(
        F.min("x1").alias("_x1"), F.max("x2").alias("_x2"), F.min("y1").alias("_y1"), F.max("y2").alias("_y2")
    )


# --- grids over time ------------------------------------------------------------------------
# A cell table has one row per source, variable, cell (lat, lon) and time. A cell without a
# row at a time counts as missing there, yet stays a cell of its source.

# Role -> (reducer, monthly name, growing-season name).
CLIMATE_PLAN = {
    "temperature": ("mean", "monthly_mean_temperature", "growing_season_mean_temperature"),
    "tmax": ("max", "monthly_max_temperature", "growing_season_max_temperature"),
    "precipitation": ("sum", "monthly_precipitation_sum", "growing_season_precipitation_sum"),
    "soil_moisture": ("mean", "monthly_mean_soil_moisture", "growing_season_mean_soil_moisture"),
    "evapotranspiration": ("sum", "monthly_evapotranspiration_sum", "growing_season_evapotranspiration_sum"),
    "potential_evapotranspiration": (
        "sum", "monthly_potential_evapotranspiration_sum", "growing_season_potential_evapotranspiration_sum"),
    "drought_index": ("mean", "monthly_drought_index_mean", "growing_season_drought_index_mean"),
}
ADDITIVE_ROLES = ("precipitation", "evapotranspiration", "potential_evapotranspiration", "et")


def _lookup(position: int) -> Column:
    pairs = [F.lit(x) for role, plan in CLIMATE_PLAN.items() for x in (role, plan[position])]
    return F.create_map(*pairs)


def cell_counts(cells: DataFrame) -> DataFrame:
    """Number of distinct cells per source."""
    return cells.select("source", "lat", "lon").distinct().groupBy("source").agg(F.count(F.lit(1)).alias("_cells"))


def _spatial_mean(cells: DataFrame, period: Sequence[str]) -> DataFrame:
    """Reduce each cell over the period, then average over cells.

    Means and maxima average the cells that have data. A sum over nothing is 0, so sums
    divide by all cells of the source.
    """
    known = cells.where(F.col("variable").isin(*CLIMATE_PLAN)).withColumn(
        "_how", F.try_element_at(_lookup(0), F.col("variable"))
    )
    per_cell = known.groupBy("source", "variable", "_how", "lat", "lon", *period).agg(
        F.avg("value").alias("_mean"), F.max("value").alias("_max"), F.sum("value").alias("_sum")
    )
    over = per_cell.groupBy("source", "variable", "_how", *period).agg(
        F.avg("_mean").alias("_mean"), F.avg("_max").alias("_max"), F.sum("_sum").alias("_sum")
    )
    joined = over.join(cell_counts(cells), "source")
    value = (
        F.when(F.col("_how") == "mean", F.col("_mean"))
        .when(F.col("_how") == "max", F.col("_max"))
        .otherwise(F.coalesce("_sum", F.lit(0.0)) / F.col("_cells"))
    )
    return joined.select("source", "variable", "_how", *period, value.alias("value"))


def monthly_climate(cells: DataFrame) -> DataFrame:
    """Monthly value per source and variable; months without data between first and last are filled."""
    month = F.trunc("time", "month")
    # one row per source, variable and month: the months, variables and their ends follow from it
    values = materialize(_spatial_mean(cells.withColumn("_month", month), ["_month"]), "monthly")
    ends = values.groupBy("source").agg(F.min("_month").alias("_a"), F.max("_month").alias("_b"))
    spine = ends.select("source", F.explode(F.sequence("_a", "_b", F.expr("interval 1 month"))).alias("_month"))
    grid = values.select("source", "variable", "_how").distinct().join(spine, "source")
    filled = grid.join(values.drop("_how"), ["source", "variable", "_month"], "left")
    value = F.coalesce("value", F.when(F.col("_how") == "sum", F.lit(0.0)))
    return filled.select(
        "source", F.lit("monthly").alias("aggregation"), F.try_element_at(_lookup(1), F.col("variable")).alias("variable"),
        F.year("_month").alias("year"), F.month("_month").alias("month"), value.alias("value"),
    )


def growing_season_climate(cells: DataFrame, months: Sequence[int]) -> DataFrame:
    """Growing-season value per source, variable and year."""
    season = cells.where(F.month("time").isin(*months)).withColumn("year", F.year("time"))
    values = _spatial_mean(season, ["year"])
    return values.select(
        "source", F.lit("growing_season").alias("aggregation"),
        F.try_element_at(_lookup(2), F.col("variable")).alias("variable"), "year", "value",
    )


def grid_extremes(cells: DataFrame, heat: str, dry: str, baseline: tuple[int, int], months: Sequence[int],
                  heat_q: float = 0.90, drought_q: float = 0.10) -> DataFrame:
    """Mean over cells of yearly counts of hot, very hot, dry and compound days.

    Thresholds belong to a cell and rest on its baseline season days, a bounded number.
    """
    season = cells.where(F.month("time").isin(*months) & F.col("variable").isin(heat, dry))
    days = season.groupBy("source", "lat", "lon", "time").agg(
        F.max(F.when(F.col("variable") == heat, F.col("value"))).alias("_t"),
        F.max(F.when(F.col("variable") == dry, F.col("value"))).alias("_d"),
    )
    cell = Window.partitionBy("source", "lat", "lon")
    inside = F.year("time").between(*baseline)
    mark = lambda c, q: bounded_quantile(F.when(inside, F.col(c)), q).over(cell)
    flagged = days.withColumns({
        "_hot": flag(F.col("_t") > mark("_t", heat_q)), "_very": flag(F.col("_t") > mark("_t", 0.95)),
        "_dry": flag(F.col("_d") < mark("_d", drought_q)),
    })
    totals = flagged.groupBy("source", F.year("time").alias("year")).agg(
        F.sum("_hot").alias("hot_days"), F.sum("_very").alias("very_hot_days"), F.sum("_dry").alias("dry_days"),
        F.sum(F.col("_hot") * F.col("_dry")).alias("compound_hot_dry_days"),
    )
    names = ["hot_days", "very_hot_days", "dry_days", "compound_hot_dry_days"]
    out = totals.join(cell_counts(season), "source")
    return out.unpivot(["source", "year", "_cells"], names, "variable", "_n").select(
        "source", F.lit("extremes").alias("aggregation"), "variable", "year", (F.col("_n") / F.col("_cells")).alias("value")
    )


def remote_series(cells: DataFrame) -> DataFrame:
    """Spatial mean per source, variable and time step."""
    return cells.groupBy("source", "variable", "time").agg(F.avg("value").alias("value"))


def remote_season(cells: DataFrame, months: Sequence[int], summed: Sequence[str] = ("et",)) -> DataFrame:
    """Season value from the *spatial means*: sum for fluxes, mean otherwise."""
    series = remote_series(cells.where(F.month("time").isin(*months)))
    value = F.when(F.col("variable").isin(*summed), F.sum("value")).otherwise(F.avg("value"))
    return series.groupBy("source", "variable", F.year("time").alias("year")).agg(value.alias("value"))


def zone_season(cells: DataFrame, zone: str) -> DataFrame:
    """Season value per zone, variable and year from cells that carry their zone.

    Additive roles sum the spatial means over time, others average all cells and times.
    Both come from one pass of per-time sums and counts.
    """
    steps = cells.groupBy(zone, "variable", F.year("time").alias("year"), "time").agg(
        F.sum("value").alias("_s"), F.count("value").alias("_n")
    )
    return steps.groupBy(zone, "variable", "year").agg(
        F.when(F.col("variable").isin(*ADDITIVE_ROLES), F.sum(F.try_divide("_s", "_n")))
        .otherwise(F.try_divide(F.sum("_s"), F.sum("_n"))).alias("value")
    ).where("value is not null")


def zone_stats(cells: DataFrame, zone: str, value: str) -> DataFrame:
    """Mean, median, extremes, population deviation and valid count per zone."""
    valid = materialize(cells.where(F.col(value).isNotNull()).select(zone, value), "zone-values")  # joined once, read twice
    plain = valid.groupBy(zone).agg(
        F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.stddev_pop(value).alias("std"), F.count(F.lit(1)).alias("valid_pixel_count"),
    )
    return plain.join(exact_quantile(valid, [zone], value, 0.5, "median"), zone)


def zonal_proxy(zones: DataFrame, cells: DataFrame, zone: str, production: bool, factor: float | None) -> DataFrame:
    """Total (times factor) or mean of valid cells per zone; empty zones stay with count 0."""
    valid = cells.where(F.col("value").isNotNull())
    total, mean = F.sum("value"), F.avg("value")
    if production:
        measures = [total.alias("raw_proxy_value"), (total * (factor or 1.0)).alias("raw_proxy_production_ton"),
                    F.max(F.lit(None).cast("double")).alias("raw_proxy_yield")]
    else:
        measures = [mean.alias("raw_proxy_value"), F.max(F.lit(None).cast("double")).alias("raw_proxy_production_ton"),
                    mean.alias("raw_proxy_yield")]
    found = valid.groupBy(zone).agg(F.count(F.lit(1)).alias("_n"), *measures)
    return zones.join(found, zone, "left").withColumn("valid_pixel_count", F.coalesce("_n", F.lit(0))).drop("_n")


def zonal_crop_area(zones: DataFrame, cells: DataFrame, zone: str, zone_area: str) -> DataFrame:
    """Crop area and share per zone from mask cells ``(zone, source, mask, area_ha)``."""
    per_source = cells.groupBy(zone, "source").agg(
        F.coalesce(F.sum(F.when(F.col("mask") > 0, F.col("area_ha"))), F.lit(0.0)).alias("_a")
    )
    found = per_source.groupBy(zone).agg(
        F.sum("_a").alias("_area"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("_a") > 0, F.col("source")))), ";").alias("_files"),
    )
    out = zones.join(found, zone, "left")
    area = F.coalesce("_area", F.lit(0.0))
    share = F.when(F.col(zone_area) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), area / F.col(zone_area))))
    status = F.when(area > 0, "zonal_stats").when(F.col("_area").isNotNull(), "no_crop_observed").otherwise("no_overlap")
    return out.withColumns({
        "crop_area_ha": area, "crop_fraction": share, "source_file": F.coalesce("_files", F.lit("")), "status": status,
    }).drop("_area", "_files")


def zonal_doy_mean(cells: DataFrame, zone: str) -> DataFrame:
    """Mean day of year per zone and stage over valid cells (above 0, at most 366)."""
    valid = cells.where((F.col("value") > 0) & (F.col("value") <= 366))
    return valid.groupBy(zone, "stage").agg(F.avg("value").alias("mean_doy"))


def daily_zone_reduce(temperature_k: DataFrame, precipitation: DataFrame, zone: str) -> DataFrame:
    """Zone means per day of two cell collections, temperature turned to Celsius."""
    none = F.lit(None).cast("double")
    both = temperature_k.select(zone, "date", (F.col("value") - 273.15).alias("_t"), none.alias("_p")).unionByName(
        precipitation.select(zone, "date", none.alias("_t"), F.col("value").alias("_p"))
    )
    return both.groupBy(zone, "date").agg(F.avg("_t").alias("tmax_c"), F.avg("_p").alias("precipitation_mm")).withColumns(
        {"year": F.year("date"), "month": F.month("date")}
    )
