"""Text cleaning with explicit sets of tokens that mean "missing"."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldframe.functions.numbers import col

# Accepted spellings of true.
TRUE_TOKENS = ("1", "true", "t", "yes", "y")
TRUE_TOKENS_WITH_PASS = TRUE_TOKENS + ("passed", "pass")


def clean_text(c: Column | str, missing: Sequence[str] = ("", "nan", "none")) -> Column:
    """Trimmed text, null when missing."""
    text = F.trim(col(c).cast("string"))
    return F.when(~F.lower(text).isin(*missing), text)


def blank(c: Column | str, missing: Sequence[str] = ("", "nan", "none")) -> Column:
    """Trimmed text, empty when missing."""
    return F.coalesce(clean_text(c, missing), F.lit(""))


def truthy(c: Column | str, tokens: Sequence[str] = TRUE_TOKENS) -> Column:
    return F.coalesce(F.lower(F.trim(col(c).cast("string"))).isin(*tokens), F.lit(False))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """True when the text contains one of the words (plain substrings)."""
    hit = text.contains(words[0])
    for word in words[1:]:
        hit = hit | text.contains(word)
    return hit


def first_rule(rules: Sequence[tuple[Column, object]], otherwise: object = None) -> Column:
    """Value of the first rule that holds."""
    chain = None
    for condition, value in rules:
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return chain.otherwise(otherwise)


def code_list(c: Column | str) -> Column:
    """All runs of 6 to 12 digits, in order."""
    return F.regexp_extract_all(F.coalesce(col(c).cast("string"), F.lit("")), F.lit(r"(\d{6,12})"), 1)


def looks_like_code(c: Column) -> Column:
    return F.trim(c).rlike(r"^\d{6,12}$")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row.

    Plain column references are inlined by the optimizer wherever they occur, also inside
    array lambdas, where they would be computed again for every element; a lambda
    variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
