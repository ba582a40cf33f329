"""Panel joins. Join strategies are left to Spark's size checks and adaptive execution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldframe.operators.scalars import with_row
from fieldframe.functions.names import normalize_province_name
from fieldframe.operators.picks import pick_one
from fieldframe.operators.quantiles import exact_quantile


def join_thresholds(df: DataFrame, baseline: DataFrame, groups: DataFrame, keys: Sequence[str], value: str,
                    q: float, out: str) -> DataFrame:
    """Group threshold on every row; groups without one take the global baseline quantile."""
    whole = exact_quantile(baseline, [], value, q, "_all")
    joined = with_row(df.join(groups, list(keys), "left"), whole)
    return joined.withColumn(out, F.coalesce(out, "_all")).drop("_all")


def prefixed_left_join(left: DataFrame, right: DataFrame, keys: Sequence[str], prefix: str,
                       last: Sequence[Column]) -> DataFrame:
    """Left join on the common keys; of duplicate right rows the last one wins."""
    keys = [k for k in keys if k in left.columns and k in right.columns]
    if not keys:
        return left
    one = pick_one(right, keys, last)
    renamed = one.select(*keys, *[F.col(c).alias(f"{prefix}_{c}") for c in one.columns if c not in keys])
    return left.join(renamed, keys, "left")


KEY_PAIRS = ("admin_id", "admin_code", "province", "prefecture")


def outer_source_merge(frames: Sequence[DataFrame]) -> DataFrame:
    """Full outer merge of annual sources on the best common key; clashes get ``_remote``."""
    merged = frames[0]
    for frame in frames[1:]:
        key = next((k for k in KEY_PAIRS if k in merged.columns and k in frame.columns), None)
        if key is None or "year" not in merged.columns or "year" not in frame.columns:
            continue
        keys = [key, "year"]
        names = {c: f"{c}_remote" for c in frame.columns if c not in keys and c in merged.columns}
        merged = merged.join(frame.withColumnsRenamed(names), keys, "outer")
    return merged


def text_or_null(c: Column | str) -> Column:
    """Trimmed text; blanks and textual nulls become null."""
    column = F.col(c) if isinstance(c, str) else c
    text = F.trim(column.cast("string"))
    return F.when(~F.lower(text).isin("", "nan", "none", "<na>"), text)


def usable_key(left: DataFrame, right: DataFrame, candidates: Sequence[str]) -> str | None:
    """First candidate key that carries text on both sides (one aggregate per side)."""
    shared = [c for c in candidates if c in left.columns and c in right.columns]
    if not shared:
        return None
    count = lambda df: df.agg(*[F.count(text_or_null(c)).alias(c) for c in shared]).first()
    mine, other = count(left), count(right)
    return next((c for c in shared if mine[c] > 0 and other[c] > 0), None)


def coalescing_left_join(left: DataFrame, right: DataFrame, candidates: Sequence[str], values: Sequence[str],
                         order: Sequence[Column]) -> DataFrame:
    """Left join on the best key and year; a non-blank left value stays, else the right one."""
    key = usable_key(left, right, candidates)
    if key is None:
        return left
    # Names are compared without their suffixes, codes as text.
    same = normalize_province_name(key) if key == "province" else F.col(key).cast("string")
    present = [v for v in values if v in right.columns]
    keyed = right.withColumn("_key", same).where("_key <> ''")
    one = pick_one(keyed, ["_key", "year"], order).select("_key", "year", *[F.col(v).alias(f"_r_{v}") for v in present])
    joined = left.withColumn("_key", same).join(one, ["_key", "year"], "left")
    for v in present:
        mine = text_or_null(v).cast(dict(right.dtypes)[v]) if v in left.columns else F.lit(None)
        joined = joined.withColumn(v, F.coalesce(mine, F.col(f"_r_{v}")))
    return joined.drop("_key", *[f"_r_{v}" for v in present])


def code_or_name_join(panel: DataFrame, other: DataFrame, code: str, name: str, normal_code, normal_name,
                      order: Sequence[Column]) -> DataFrame:
    """Left join by normalised code when both sides have codes, else by normalised name, plus year.

    The right side is reduced to one row per key first, so rows never multiply.
    """
    has = lambda df: df.where(normal_code(F.col(code)) != "").limit(1).count() > 0
    key = normal_code if has(panel) and has(other) else normal_name
    source = code if key is normal_code else name
    keyed = other.withColumn("_key", key(F.col(source))).where("_key <> ''")
    one = pick_one(keyed, ["_key", "year"], order)
    extra = [c for c in other.columns if c not in panel.columns]
    return (
        panel.withColumn("_key", key(F.col(source)))
        .join(one.select("_key", "year", *extra), ["_key", "year"], "left")
        .drop("_key")
    )


def align_names(left: DataFrame, right: DataFrame, name: str, normal, first: Sequence[Column]) -> DataFrame:
    """Spell the right side's names as the left side does (first spelling of a normalised name)."""
    spelled = left.select(name, *[c.alias(f"_o{i}") for i, c in enumerate(first)]).withColumn("_n", normal(F.col(name)))
    orders = [F.col(f"_o{i}") for i in range(len(first))]
    seen = pick_one(spelled, ["_n"], orders).select("_n", F.col(name).alias("_left"))
    return (
        right.withColumn("_n", normal(F.col(name)))
        .join(seen, "_n", "left")
        .withColumn(name, F.coalesce("_left", name))
        .drop("_n", "_left")
    )


def broadcast_to_units(rows: DataFrame, units: DataFrame, slices: int | None = None) -> DataFrame:
    """Regional rows repeated for every unit; the product is the wanted result.

    Rows are hashed into slices and every unit is present once per slice, so the product
    is an ordinary equality join of even slices: neither side has to fit one task. There are
    as many slices as shuffle partitions unless told otherwise.
    """
    slices = slices or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = rows.withColumn("_slice", F.pmod(F.xxhash64(*rows.columns), F.lit(slices)))
    spread = units.withColumn("_slice", F.explode(F.expr(f"sequence(0L, {slices - 1}L)")))
    return spread.join(sliced, "_slice").drop("_slice")


def coverage_grid(units: DataFrame, low: int, high: int, panel: DataFrame, unit: str) -> DataFrame:
    """Unit-year cells with the number of panel rows and ``available``/``missing``."""
    cells = units.withColumn("year", F.explode(F.sequence(F.lit(low), F.lit(high))))
    counts = panel.groupBy(unit, "year").agg(F.count(F.lit(1)).alias("_n"))
    joined = cells.join(counts, [unit, "year"], "left")
    n = F.coalesce("_n", F.lit(0))
    return joined.withColumn("proxy_observation_count", n).withColumn(
        "status", F.when(n > 0, "available").otherwise("missing")
    ).drop("_n")


def swap_variant(panel: DataFrame, annual: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Replace exposure columns by those of another variant, joined on code and year."""
    kept = panel.drop(*columns)
    return kept.join(annual.select(*keys, *columns), list(keys), "left")


def attach_area(panel: DataFrame, areas: DataFrame, unit: str, area: str, out: str) -> DataFrame:
    """Area per unit by text key; an all-null column when the table lacks it."""
    if unit not in areas.columns or area not in areas.columns:
        return panel.withColumn(out, F.lit(None).cast("double"))
    side = areas.select(F.col(unit).cast("string").alias("_u"), F.col(area).alias(out))
    return panel.join(side, F.col(unit).cast("string") == F.col("_u"), "left").drop("_u")
