"""Units of measure: free-text statistics units, coded template units, climate units."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldframe.functions.numbers import as_number, col, parse_number
from fieldframe.functions.text import contains_any, first_rule

# Ordered unit words and factors; the first row with a word in the unit text applies.
PRODUCTION_TO_TON = (
    (("万吨", "10000t", "10kt"), 10000.0),
    (("公斤", "千克", "kg", "kilogram"), 0.001),
    (("斤", "jin", "catty"), 0.0005),
    (("克", "g", "gram"), 0.000001),
)
AREA_TO_HECTARE = (
    (("1000ha", "千公顷"), 1000.0),
    (("平方公里", "km2", "km^2", "sqkm"), 100.0),
    (("平方米", "m2", "m^2", "squaremeter"), 0.0001),
    (("亩", "mu"), 1.0 / 15.0),
)
YIELD_TO_KG_HA = (
    (("公斤/亩", "千克/亩", "kg/mu"), 15.0),
    (("斤/亩", "jin/mu", "catty/mu"), 7.5),
    (("吨/公顷", "吨/ha", "t/ha", "ton/ha", "tons/ha"), 1000.0),
)

# Precipitation rates and metres in climate tables.
RATE_UNITS = ("kgm-2s-1", "kg/m2/s", "kgm**-2s**-1")
METRE_UNITS = ("m", "meter", "metre", "meters", "metres")

# Coded units of the entry templates.
CODED_AREA = {"hectare": 1.0, "mu": 1.0 / 15.0, "thousand_hectare": 1000.0, "ten_thousand_mu": 10000.0 / 15.0}
CODED_PRODUCTION = {
    "ton": 1.0, "kg": 0.001, "jin": 0.0005, "ten_thousand_ton": 10000.0, "ten_thousand_jin": 5.0,
}
CODED_YIELD = {"kg_per_hectare": 1.0, "kg_per_mu": 15.0, "jin_per_mu": 7.5, "ton_per_hectare": 1000.0}

# Raster fill codes and scales (scale, offset, lowest raw, highest raw).
RASTER_FILL = (-32768.0, -9999.0)
RASTER_SCALES = {
    "ndvi": (0.0001, 0.0, -3000.0, 10000.0),
    "evi": (0.0001, 0.0, -3000.0, 10000.0),
    "lst": (0.02, -273.15, 7501.0, 65535.0),
}


def unit_text(c: Column | str) -> Column:
    """Lower-case unit text without spaces, underscores and middle dots."""
    text = F.lower(F.trim(F.coalesce(col(c).cast("string"), F.lit(""))))
    return F.regexp_replace(F.translate(text, "（）／", "()/"), "[ _·]", "")


def unit_in_header(header: str) -> str:
    """Unit inside the last parentheses of a column header; a bare header carries none."""
    found = re.findall(r"[（(]([^()（）]+)[）)]", header)
    return found[-1] if found else ""


def names_unit(unit: Column | str, words: Sequence[str], slash: bool = False) -> Column:
    """True when a unit text holds one of the words: Latin words as whole tokens, others anywhere.

    Spaces may stand inside a unit (``10000 t``) or between words (``in kg``), so the text is looked
    at both ways. With ``slash`` per and 每 count as a slash.
    """
    def hit(text: Column) -> Column:
        if slash:
            text = F.replace(F.replace(text, F.lit("per"), F.lit("/")), F.lit("每"), F.lit("/"))
        latin = [re.escape(w) for w in words if w.isascii()]
        tests = [text.contains(w) for w in words if not w.isascii()]
        if latin:
            tests.append(text.rlike(rf"(?<![a-z])(?:{'|'.join(latin)})s?(?![a-z])"))
        return reduce(lambda a, b: a | b, tests)

    spaced = F.translate(F.lower(F.trim(F.coalesce(col(unit).cast("string"), F.lit("")))), "（）／", "()/")
    return hit(unit_text(unit)) | hit(spaced)


def convert_by_words(value: Column | str, unit: Column | str, rules: Sequence, slash: bool = False) -> Column:
    factor = first_rule([(names_unit(unit, words, slash), F.lit(f)) for words, f in rules], F.lit(1.0))
    return parse_number(value) * factor


def production_to_ton(value: Column | str, unit: Column | str) -> Column:
    return convert_by_words(value, unit, PRODUCTION_TO_TON)


def area_to_hectare(value: Column | str, unit: Column | str) -> Column:
    return convert_by_words(value, unit, AREA_TO_HECTARE)


def yield_to_kg_ha(value: Column | str, unit: Column | str) -> Column:
    return convert_by_words(value, unit, YIELD_TO_KG_HA, slash=True)


def coded_factor(unit: Column, factors: Mapping[str, float]) -> Column:
    pairs = [F.lit(x) for pair in factors.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), F.lower(unit))


def convert_coded(value: str, unit: str, factors: Mapping[str, float], label: str) -> tuple[Column, Column]:
    """Converted value and its note; blank value and unit give neither."""
    v, u = F.trim(F.coalesce(F.col(value), F.lit(""))), F.trim(F.coalesce(F.col(unit), F.lit("")))
    number = as_number(F.replace(v, F.lit(","), F.lit("")))
    factor = coded_factor(u, factors)
    given = (v != "") | (u != "")
    note = F.when(
        given,
        F.when(number.isNull(), F.lit(f"{label}_value is not numeric")).when(
            factor.isNull(), F.concat(F.lit(f"unsupported {label}_unit '"), u, F.lit("'"))
        ),
    )
    return F.when(given, number * factor), note


def derive_yield(production_ton: Column, area_hectare: Column) -> Column:
    """kg per hectare, null unless the area is positive."""
    return F.when(area_hectare > 0, production_ton * 1000.0 / area_hectare)


def temperature_to_celsius(value: Column | str, unit: Column | str) -> Column:
    kelvin = F.lower(F.trim(col(unit))).isin("k", "kelvin")
    return F.when(F.coalesce(kelvin, F.lit(False)), col(value) - 273.15).otherwise(col(value))


def precipitation_to_mm(value: Column | str, unit: Column | str, step_seconds: Column | str) -> Column:
    """Mass-flux rates times the time step, metres to millimetres, anything else as it is."""
    u = F.lower(F.trim(col(unit)))
    rate = contains_any(F.replace(u, F.lit(" "), F.lit("")), RATE_UNITS)
    metres = u.isin(*METRE_UNITS)
    return (
        F.when(F.coalesce(rate, F.lit(False)), col(value) * col(step_seconds))
        .when(F.coalesce(metres, F.lit(False)), col(value) * 1000.0)
        .otherwise(col(value))
    )


def scale_raster(raw: Column | str, role: str) -> Column:
    """Scaled physical value; fill codes and values outside the valid range are null."""
    scale, offset, low, high = RASTER_SCALES[role]
    value = as_number(raw)
    valid = ~value.isin(*RASTER_FILL) & value.between(low, high)
    return F.when(valid, value * scale + offset)


def cell_area_ha(x_size: Column, y_size: Column, lat: Column | None = None) -> Column:
    """Cell area: square metres for projected cells, metres per degree for geographic ones."""
    if lat is None:
        return F.abs(x_size * y_size) / 10000.0
    metres = F.lit(111320.0)
    return F.abs(x_size * metres * F.cos(F.radians(lat)) * y_size * metres) / 10000.0


def doy_to_month(day: Column, year: int) -> Column:
    """Day of year to month; halves round to even, days are clamped to 1..366."""
    whole = F.greatest(F.lit(1), F.least(F.lit(366), F.bround(day).cast("int")))
    return F.month(F.date_add(F.make_date(F.lit(year), F.lit(1), F.lit(1)), whole - 1))
