"""Treatment assignment and event-time terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldframe.operators.scalars import with_row
from fieldframe.functions.numbers import flag
from fieldframe.functions.text import TRUE_TOKENS_WITH_PASS, truthy
from fieldframe.operators.quantiles import exact_quantile


def unit_scores(df: DataFrame, exposure: str, unit: str, event_year: int) -> DataFrame:
    """Mean event-year exposure per unit."""
    rows = df.where((F.col("year") == event_year) & F.col(unit).isNotNull() & F.col(exposure).isNotNull())
    return rows.groupBy(unit).agg(F.avg(exposure).alias("_score"))


def assign_treatment(df: DataFrame, exposure: str, unit: str, event_year: int, q: float, out: str = "treatment") -> DataFrame:
    """1 for units whose event-year exposure reaches the quantile over *units*; missing counts as 0."""
    if not 0.0 <= q <= 1.0:
        raise ValueError("quantile must be between 0 and 1")
    scores = unit_scores(df, exposure, unit, event_year)
    cut = exact_quantile(scores, [], "_score", q, "_cut")
    joined = with_row(df.join(scores, unit, "left"), cut)
    return joined.withColumn(out, flag(F.col("_score") >= F.col("_cut"))).drop("_score", "_cut")


def term_name(offset: int) -> str:
    return f"event_time_m{-offset}" if offset < 0 else f"event_time_p{offset}" if offset else "event_time_0"


def event_study_terms(df: DataFrame, treatment: str, event_year: int, window: int) -> DataFrame:
    """One 0/1 column per year offset within the window for treated rows."""
    if window < 0:
        raise ValueError("window must be non-negative")
    time = (F.col("year") - F.lit(event_year)).cast("bigint")
    treated = truthy(treatment, TRUE_TOKENS_WITH_PASS)
    terms = {term_name(o): flag(treated & (time == o)) for o in range(-window, window + 1)}
    return df.withColumns({"event_time": time, **terms})


def treatment_counts(df: DataFrame, unit: str, event_year: int, flag_column: str | None = None,
                     score: str | None = None) -> DataFrame:
    """Treated and control units in the event year: by flag when given, else score at or above its 75 % mark."""
    event = df.where(F.col("year") == event_year)
    if flag_column is not None:
        units = event.groupBy(unit).agg(F.max(truthy(flag_column).cast("int")).alias("_t"))
    else:
        scores = event.groupBy(unit).agg(F.avg(score).alias("_score"))
        cut = exact_quantile(scores, [], "_score", 0.75, "_cut")
        units = with_row(scores, cut).withColumn("_t", flag(F.col("_score") >= F.col("_cut")))
    return units.agg(
        F.coalesce(F.sum("_t"), F.lit(0)).alias("treated"), F.count_if(F.col("_t") == 0).alias("control")
    )
