"""Year ranges, gaps and spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldframe.functions.numbers import as_number


def year_range(df: DataFrame, column: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Inclusive year filter with optional bounds; rows without a usable year are dropped."""
    integral = dict(df.dtypes)[column] in ("int", "bigint", "smallint", "tinyint")
    year = F.col(column) if integral else as_number(column)  # a bare column can reach the scan
    out = df.where(year.isNotNull())
    if low is not None:
        out = out.where(year >= low)
    if high is not None:
        out = out.where(year <= high)
    return out


def analysis_years(baseline: tuple[int, int], event: int, recovery: list[int], validation: int | None) -> list[int]:
    """Sorted union of baseline span, event, recovery and validation years."""
    years = set(range(min(baseline), max(baseline) + 1)) | {event, *recovery}
    return sorted(years | ({validation} if validation is not None else set()))


def year_spans(df: DataFrame, unit: str, year: str, out: str) -> DataFrame:
    """Text such as ``2000-2003, 2007`` per unit from distinct years."""
    window = Window.partitionBy(unit).orderBy(year)
    distinct = df.select(unit, year).where(F.col(year).isNotNull()).distinct()
    islands = (
        distinct.withColumn("_g", F.col(year) - F.row_number().over(window))
        .groupBy(unit, "_g")
        .agg(F.min(year).alias("_a"), F.max(year).alias("_b"))
    )
    label = F.when(F.col("_a") == F.col("_b"), F.col("_a").cast("string")).otherwise(
        F.concat_ws("-", F.col("_a").cast("string"), F.col("_b").cast("string"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("_a", label.alias("s"))))
    return islands.groupBy(unit).agg(F.array_join(F.transform(ordered, lambda x: x["s"]), ", ").alias(out))


def years_array(low: int, high: int) -> Column:
    return F.sequence(F.lit(low), F.lit(high))


def missing_years(df: DataFrame, unit: str, year: str, low: int, high: int, out: str) -> DataFrame:
    """Expected years a unit lacks, as text; units that lack none are left out."""
    seen = df.groupBy(unit).agg(F.collect_set(year).alias("_seen"))
    lacking = F.array_sort(F.array_except(years_array(low, high), "_seen"))
    return (
        seen.withColumn("_lacking", lacking)
        .where(F.size("_lacking") > 0)
        .select(unit, F.array_join(F.transform("_lacking", lambda y: y.cast("string")), ",").alias(out))
    )
