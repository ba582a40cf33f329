"""Choice of key, outcome, exposure and predictor columns from what a panel holds.

Each choice is one aggregate over the candidate columns; only counts reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldframe.functions.numbers import as_number
from fieldframe.operators.joins import text_or_null
from fieldframe.operators.models import CROSS_SECTION_SCOPES

# Fallback columns in order of preference.
OUTCOME_FALLBACKS = (
    "province_rice_yield_anomaly", "province_grain_yield_anomaly", "yield_anomaly_pct", "yield_anomaly", "yield_kg_per_hectare",
    "grain_yield_kg_per_hectare", "rice_yield_kg_per_hectare", "actual_yield", "yield",
)
UNIT_FALLBACKS = ("admin_code", "province", "county", "prefecture")
UNIT_KEYS = ("admin_id", "admin_code", "province", "prefecture", "county")


def unit_key(df: DataFrame, candidates: Sequence[str] = UNIT_KEYS, share: float = 0.0) -> str | None:
    """First candidate with usable text in more than none, or in at least a share, of the rows."""
    present = [c for c in candidates if c in df.columns]
    if not present:
        return None
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(text_or_null(c)).alias(c) for c in present]).first()
    needed = max(1, counts["_rows"] * share)
    return next((c for c in present if counts[c] >= needed), None)


def outcome_field(df: DataFrame, requested: str) -> str:
    """The requested outcome when it holds a number, else the first fallback that does."""
    present = [c for c in (requested, *OUTCOME_FALLBACKS) if c in df.columns]
    if not present:
        return requested
    counts = df.agg(*[F.count(as_number(c)).alias(c) for c in dict.fromkeys(present)]).first()
    return next((c for c in present if counts[c]), requested)


def unit_field(df: DataFrame, requested: str) -> str:
    """The requested unit column when it holds text, else the first fallback that does."""
    return unit_key(df, (requested, *UNIT_FALLBACKS)) or requested


def varying_fields(df: DataFrame, fields: Sequence[str]) -> list[str]:
    """Fields with at least two distinct numbers, in the given order (smallest differs from largest)."""
    present = [c for c in dict.fromkeys(fields) if c in df.columns]
    if not present:
        return []
    ends = df.agg(*[f(as_number(c)).alias(f"{n}_{c}") for c in present for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return [c for c in present if ends[f"lo_{c}"] is not None and ends[f"lo_{c}"] != ends[f"hi_{c}"]]


def exposure_field(df: DataFrame, requested: str, scope: str, annual_rate: float) -> str:
    """Exposure column the scope allows: event intensity for cross sections, annual exposure when covered."""
    if scope in CROSS_SECTION_SCOPES:
        order = ("chd_event_intensity", requested, "exposure_index")
    elif annual_rate >= 0.75:
        order = ("chd_annual", requested, "exposure_index")
    else:
        order = (requested, "chd_annual", "exposure_index", "chd_event_intensity")
    return next(iter(varying_fields(df, order)), requested)


def predictors(df: DataFrame, outcome: str, exposure: str, unit: str) -> list[str]:
    """The exposure when it varies, else the first other varying numeric column."""
    others = [c for c in df.columns if c not in (outcome, "year", unit, exposure)]
    return varying_fields(df, [exposure, *others] if exposure != outcome else others)[:1]
