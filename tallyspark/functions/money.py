"""Money and number parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def try_double(c: Column) -> Column:
    return c.try_cast("double")


def number_or_zero(c: Column) -> Column:
    """Strict numeric text; thousands separators do not parse and give 0."""
    return F.coalesce(F.nanvl(try_double(c), F.lit(None).cast("double")), F.lit(0.0))


def money_text_to_double(c: Column) -> Column:
    """Strip everything but digits, dot and minus, then parse; bad text gives 0."""
    return F.coalesce(try_double(F.regexp_replace(c.cast("string"), r"[^\d\.-]", "")), F.lit(0.0))


def to_minor(c: Column) -> Column:
    """Exact minor units, half up. Null for text that does not parse and for negatives (see ``is_bad_money``)."""
    value = F.trim(F.replace(c.cast("string"), F.lit(","), F.lit(""))).try_cast("decimal(38,10)")
    cents = F.round(value, 2) * F.lit(100)
    return F.when(value >= 0, cents.cast("bigint"))


def is_bad_money(c: Column) -> Column:
    return to_minor(c).isNull()


def from_minor(c: Column) -> Column:
    return (c.cast("decimal(18,0)") / F.lit(100)).cast("decimal(18,2)")


def safe_rate(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high)))


def score(c: Column) -> Column:
    """A 0..100 score with two decimals."""
    return F.round(clamp(c, 0.0, 100.0), 2)
