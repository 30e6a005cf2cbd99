"""Number, quantity, currency and date scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_number(c: Column) -> Column:
    """Commas, blanks and currency signs off; ``%`` divides by 100; K, M, B and T multiply; null if no number is left."""
    x = F.upper(F.regexp_replace(c, r"[,\s$€£¥]", ""))
    number = F.regexp_replace(x, "[%KMBT]$", "").try_cast("double")
    scale = F.when(x.endswith("%"), 0.01).when(x.endswith("K"), 1e3).when(x.endswith("M"), 1e6).when(x.endswith("B"), 1e9).when(x.endswith("T"), 1e12).otherwise(1.0)
    return number * scale


# Units and their size in metres, kilograms and litres.
UNITS = {
    "length": {"m": 1.0, "km": 1000.0, "cm": 0.01, "mm": 0.001, "mile": 1609.34, "yard": 0.9144, "foot": 0.3048, "inch": 0.0254},
    "weight": {"kg": 1.0, "g": 0.001, "mg": 0.000001, "lb": 0.453592, "oz": 0.0283495},
    "volume": {"l": 1.0, "ml": 0.001, "gal": 3.78541, "pint": 0.473176},
}


def convert_unit(value: Column, source: Column, target: str) -> Column:
    """Value in another unit of the same kind; null for others."""
    kind, size = next((k, t[target]) for k, t in UNITS.items() if target in t)
    factors = F.create_map(*(F.lit(x) for pair in UNITS[kind].items() for x in pair))
    return value * F.try_element_at(factors, F.lower(source)) / F.lit(size)


def parse_quantity(c: Column) -> Column:
    """``struct(value, unit)`` of texts such as ``12.5 km``."""
    pattern = r"^\s*([-+]?[0-9]*\.?[0-9]+)\s*([A-Za-z]+)\s*$"
    return F.struct(F.regexp_extract(c, pattern, 1).try_cast("double").alias("value"), F.lower(F.regexp_extract(c, pattern, 2)).alias("unit"))


# Signs and codes of currencies.
SIGNS = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₹": "INR"}
CODES = ("USD", "EUR", "GBP", "JPY", "INR", "CHF", "CAD", "AUD", "CNY")


def parse_currency(c: Column, default: str = "USD") -> Column:
    """``struct(amount, currency)``; a sign or a code names the currency."""
    amount = F.replace(F.regexp_extract(c, r"([-+]?[0-9][0-9,]*\.?[0-9]*)", 1), F.lit(","), F.lit("")).try_cast("double")
    code = F.coalesce(*(F.when(c.contains(s), F.lit(v)) for s, v in SIGNS.items()), *(F.when(F.upper(c).contains(v), F.lit(v)) for v in CODES), F.lit(default))
    return F.struct(amount.alias("amount"), code.alias("currency"))


def significant(c: Column, digits: int) -> Column:
    """Rounded to so many significant digits."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(c))))
    return F.when(c == 0, F.lit(0.0)).otherwise(F.round(c * scale) / scale)


DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy", "MMM d, yyyy", "d MMM yyyy", "yyyyMMdd")


def parse_date(c: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """The first format that fits; null if none does."""
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in formats))


def relative_date(c: Column, reference: Column) -> Column:
    """today, yesterday, tomorrow, ``N unit ago|from now|later`` (no direction: ago); else the reference."""
    x = F.lower(F.trim(c))
    n = F.regexp_extract(x, r"(\d+)\s*(day|week|month|year)", 1).try_cast("int")
    unit = F.regexp_extract(x, r"(\d+)\s*(day|week|month|year)", 2)
    sign = F.when(x.rlike("from now|later"), 1).otherwise(-1)
    day = F.to_date(reference)
    return (
        F.when(x == "today", day).when(x == "yesterday", F.date_sub(day, 1)).when(x == "tomorrow", F.date_add(day, 1))
        .when(unit == "day", F.date_add(day, sign * n)).when(unit == "week", F.date_add(day, sign * n * 7))
        .when(unit == "month", F.add_months(day, sign * n)).when(unit == "year", F.add_months(day, sign * n * 12)).otherwise(day)
    )


def period_bounds(c: Column) -> Column:
    """``struct(start, end)`` (end exclusive) of ``YYYY``, ``YYYY-MM``, ``Qn YYYY`` and ``YYYY-MM-DD``; null otherwise."""
    year = F.regexp_extract(c, r"(\d{4})", 1).try_cast("int")
    quarter = F.regexp_extract(c, r"^Q([1-4]) \d{4}$", 1).try_cast("int")
    month = F.regexp_extract(c, r"^\d{4}-(\d{2})$", 1).try_cast("int")
    day = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c))
    start = F.when(c.rlike(r"^\d{4}$"), F.make_date(year, F.lit(1), F.lit(1))).when(quarter.isNotNull(), F.make_date(year, quarter * 3 - 2, F.lit(1))).when(month.isNotNull(), F.make_date(year, month, F.lit(1))).otherwise(day)
    months = F.when(c.rlike(r"^\d{4}$"), 12).when(quarter.isNotNull(), 3).when(month.isNotNull(), 1)
    return F.struct(start.alias("start"), F.when(months.isNotNull(), F.add_months(start, months)).otherwise(F.date_add(day, 1)).alias("end"))


def floor_to(c: Column, unit: str) -> Column:
    return F.date_trunc(unit, c)


def ceil_to(c: Column, unit: str) -> Column:
    """The last microsecond of the unit."""
    return F.date_trunc(unit, c) + F.expr(f"interval 1 {unit}") - F.expr("interval 1 microsecond")
