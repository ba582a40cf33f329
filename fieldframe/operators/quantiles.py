"""Exact, linearly interpolated quantiles for groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldframe.session import materialize


def bounded_quantile(value, q: float):
    """Exact quantile as one aggregate; for groups bounded by construction (days of a unit)."""
    return F.percentile(value, F.lit(float(q)))


def exact_quantile(df: DataFrame, keys: Sequence[str], value: str, q: float, out: str) -> DataFrame:
    """One row per key with the exact quantile of one column."""
    return exact_quantiles(df, keys, {out: (value, q)})


def exact_quantiles(df: DataFrame, keys: Sequence[str], marks: Mapping[str, tuple[str, float]], whole: bool = False) -> DataFrame:
    """One row per key with exact quantiles of several columns at several ranks; one way for every size of group.

    ``marks`` names each result with its column and rank. With ``whole`` a row over all keys is
    added by grouping sets, and ``_whole`` marks it. A key without any value has no row; a column
    without values there is null.

    Equal values become counts, and the counts of all columns are dealt once into ranges of about
    equal number by key, column and value, so a key that holds most rows spreads over many ranges.
    The ranges' sums tell in which one or two of a key's ranges each wanted rank lies; those ranges
    are numbered once for all ranks.
    """
    keys = list(keys)
    columns = list(dict.fromkeys(c for c, _ in marks.values()))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(columns)]))
    long = df.select(*keys, each.alias("_s")).select(*keys, "_s._c", "_s._v").where("_v is not null")
    group = ["_whole", *keys, "_c"]
    number = F.count(F.lit(1)).alias("_n")
    if whole and keys:
        sets = long.groupingSets([[*keys, "_c", "_v"], ["_c", "_v"]], *keys, "_c", "_v")
        counted = sets.agg(number, (F.grouping(keys[0]) == 1).alias("_whole"))
    else:
        counted = long.groupBy(*keys, "_c", "_v").agg(number).withColumn("_whole", F.lit(not keys))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(counted.repartitionByRange(parts, *group, "_v").withColumn("_range", F.spark_partition_id()), "quantile")

    # one row per key, column and range, then one per range that holds a wanted rank, with all of its ranks
    sums = ranged.groupBy(*group, "_range").agg(F.sum("_n").alias("_t"))
    around = Window.partitionBy(*group)
    before = around.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.select(*group, "_range", "_t", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"), F.sum("_t").over(around).alias("_all"))
    wanted = F.array(*[F.struct(F.lit(i).alias("m"), F.lit(columns.index(c)).alias("c"), F.lit(float(q)).alias("q")) for i, (c, q) in enumerate(marks.values())])
    ranks = F.transform(F.filter(wanted, lambda w: w["c"] == F.col("_c")), lambda w: F.struct(w["m"].alias("m"), ((F.col("_all") - 1) * w["q"]).alias("at")))
    held = F.filter(ranks, lambda r: (F.col("_base") <= F.ceil(r["at"])) & (F.col("_base") + F.col("_t") > F.floor(r["at"])))
    holding = placed.withColumn("_ranks", held).where(F.size("_ranks") > 0).select(*[F.col(g).alias(f"_k{g}") for g in group], F.col("_range").alias("_r"), "_base", "_ranks")
    same = [F.col(g).eqNullSafe(F.col(f"_k{g}")) for g in group]
    inside = ranged.join(holding, [F.col("_range") == F.col("_r"), *same])
    running = Window.partitionBy(*group, "_range").orderBy("_v")
    spans = inside.withColumn("_end", F.col("_base") + F.sum("_n").over(running)).withColumn("_start", F.col("_end") - F.col("_n"))
    met = spans.select("_whole", *keys, "_v", "_start", "_end", F.explode("_ranks").alias("_w")).select("*", "_w.m", "_w.at")
    on = lambda rank: (F.col("_start") <= rank) & (rank < F.col("_end"))
    low, high = F.floor("at"), F.ceil("at")
    picked = met.where(on(low) | on(high)).groupBy("_whole", *keys).agg(*[
        f.alias(f"{name}{i}") for i in range(len(marks)) for name, f in (
            ("_low", F.max(F.when((F.col("m") == i) & on(low), F.col("_v")))),
            ("_high", F.max(F.when((F.col("m") == i) & on(high), F.col("_v")))),
            ("_part", F.max(F.when(F.col("m") == i, F.col("at") - low))))])
    if not keys:  # no values still give one row of nulls
        picked = picked.agg(*[F.max(c).alias(c) for c in picked.columns if c != "_whole"])
    values = [(F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * F.col(f"_part{i}")).alias(out) for i, out in enumerate(marks)]
    return picked.select(*keys, *(["_whole"] if whole and keys else []), *values)
