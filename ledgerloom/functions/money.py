"""Money, dates and rounding as the ledger defines them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16


def round_half_up(value: Column) -> Column:
    """To a whole number, halves toward plus infinity."""
    return F.floor(value + 0.5)


def round_money(value: Column) -> Column:
    return round_half_up(value * 100) / F.lit(100.0)


def minor_units(value: Column) -> Column:
    """Whole cents; the epsilon lifts halves that doubles store just below."""
    return round_half_up((value + F.lit(EPSILON)) * 100)


def parse_money(text: Column) -> Column:
    """A double from ``R$``, pt-BR or plain notation; null where the text is no amount."""
    t = F.regexp_replace(F.regexp_replace(F.trim(text), r"(?i)^R\$\s*", ""), r"\s+", "")
    bracketed = t.rlike(r"^\(.+\)$")
    t = F.when(bracketed, F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)
    local = t.rlike(r"^[+-]?(?:[0-9]{1,3}(?:\.[0-9]{3})*|[0-9]+)(?:,[0-9]{1,2})?$")
    plain = t.rlike(r"^[+-]?[0-9]+(?:\.[0-9]{1,2})?$")
    number = F.when(local, F.regexp_replace(F.regexp_replace(t, r"\.", ""), ",", ".")).when(plain, t).try_cast("double")
    return minor_units(F.when(bracketed, -F.abs(number)).otherwise(number)) / F.lit(100.0)


def parse_date(text: Column) -> Column:
    """A date from ``dd/mm/yyyy``, ISO or a spreadsheet's day number; null where it names no calendar day."""
    t = F.trim(text)
    return (
        F.when(t.rlike("^[0-9]{2}/[0-9]{2}/[0-9]{4}$"), F.try_to_date(t, "dd/MM/yyyy"))
        .when(t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(t, "yyyy-MM-dd"))
        .when(t.rlike(r"^[0-9]{1,6}(\.[0-9]+)?$"), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(t.try_cast("double")).cast("int")))
    )


def relative_difference(a: Column, b: Column) -> Column:
    """|a - b| over their mean; 0 when the mean is 0."""
    return F.when((a + b) == 0, 0.0).otherwise(F.abs(a - b) / ((a + b) / 2))


def month_index(date: Column) -> Column:
    return F.year(date) * 12 + F.month(date)


def is_monthly_pair(a: Column, b: Column, low: int = 25, high: int = 35, tolerance: int = 5) -> Column:
    gap = F.abs(F.datediff(b, a))
    return gap.between(low, high) | ((F.abs(month_index(a) - month_index(b)) == 1) & (F.abs(F.day(a) - F.day(b)) <= tolerance))


def is_cadence_pair(a: Column, b: Column, longest: int = 3) -> Column:
    """A monthly pair, or two or three months apart on the same day or both on the last day."""
    apart = F.abs(month_index(a) - month_index(b))
    ends = (a == F.last_day(a)) & (b == F.last_day(b))
    return is_monthly_pair(a, b) | (apart.between(2, longest) & (ends | (F.day(a) == F.day(b))))
