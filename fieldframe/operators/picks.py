"""Deterministic one-row-per-key choices and row numbers that scale."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldframe.session import materialize


def pick_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep the first row of each key in the given total order.

    Written as ``row_number() = 1`` so that Spark adds a group limit *before* the
    shuffle: every map task forwards at most one row per key, hot keys included.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_pick", F.row_number().over(window)).where("_pick = 1").drop("_pick")


def pick_top(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep every row that ties for the first place of its key (rank 1)."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.rank().over(window)).where("_rank = 1").drop("_rank")


def number_rows(df: DataFrame, order: str, out: str) -> DataFrame:
    """1-based row number by a unique column, without one global sort task.

    Spark samples the column and deals rows into ranges of about equal number, whatever the
    spacing of the values; rows are numbered inside their range, and the table of range sizes,
    one row per shuffle partition, gives each range its offset. The ranged rows are written
    once, so both readings see the same ranges.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, order).sortWithinPartitions(order).withColumn("_range", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_range").orderBy(order)
    return (
        ranged.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, "_range")
        .withColumn(out, F.col("_offset") + F.col("_inside"))
        .drop("_range", "_inside", "_offset")
    )
