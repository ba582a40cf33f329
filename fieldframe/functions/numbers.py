"""Numeric expressions with the null rules of the panel operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text tokens that mean "no number".
MISSING_NUMBER_TOKENS = ("", "nan", "none", "na", "n/a", "--", "—", "-")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_number(c: Column | str) -> Column:
    """Text or number to double; anything unparsable, NaN or infinite is null."""
    value = col(c).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def parse_number(c: Column | str) -> Column:
    """Lenient parse: drop thousands separators, else take the first number in the text."""
    text = F.trim(col(c).cast("string"))
    bare = F.regexp_replace(text, "[,，]", "")
    first = F.regexp_extract(bare, r"-?\d+(?:\.\d+)?", 0)
    parsed = F.coalesce(as_number(bare), as_number(first))
    return F.when(~F.lower(text).isin(*MISSING_NUMBER_TOKENS), parsed)


def parse_strict_int(c: Column | str) -> Column:
    """Whole numbers only (``2008`` or ``2008.0``), else null."""
    value = as_number(F.regexp_replace(F.trim(col(c).cast("string")), ",", ""))
    return F.when(value == F.floor(value), value.cast("int"))


def parse_year(c: Column | str) -> Column:
    """First 19xx/20xx in the text as int, else null."""
    found = F.regexp_extract(col(c).cast("string"), r"(?:19|20)\d{2}", 0)
    return found.try_cast("int")


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Round and turn -0.0 into 0.0 so that equal numbers print equally."""
    return F.round(col(c), digits) + F.lit(0.0)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields null for a zero or missing denominator."""
    return F.try_divide(numerator, denominator)


def is_true(condition: Column) -> Column:
    """Comparison in which a missing side counts as false."""
    return F.coalesce(condition, F.lit(False))


def flag(condition: Column) -> Column:
    """0/1 bigint flag; missing counts as 0."""
    return is_true(condition).cast("bigint")


def row_mean(*columns: Column | str) -> Column:
    """Mean over the non-null arguments, null when all are null."""
    present = F.array_compact(F.array(*[col(c).cast("double") for c in columns]))
    total = F.aggregate(present, F.lit(0.0), lambda acc, x: acc + x)
    return ratio(total, F.size(present))


def row_sum(*columns: Column | str) -> Column:
    """Sum over the non-null arguments, null when all are null."""
    present = F.array_compact(F.array(*[col(c).cast("double") for c in columns]))
    total = F.aggregate(present, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(present) > 0, total)
