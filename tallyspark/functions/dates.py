"""Date parsing and calendar arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse_time(c: Column, is_text: bool = True) -> Column:
    """Timestamp or null; never an error on bad text."""
    return F.try_to_timestamp(c) if is_text else c


def time_of(df: DataFrame, name: str) -> Column:
    return parse_time(F.col(name), isinstance(df.schema[name].dataType, T.StringType))


def to_day(df: DataFrame, name: str) -> Column:
    return F.to_date(time_of(df, name))


def month_key(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def day_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def days_to_month_end(day: Column) -> Column:
    return F.datediff(F.last_day(day), day)


def is_weekend(day: Column) -> Column:
    return F.weekday(day) >= 5


def month_window(day: Column) -> Column:
    """Fixed labels: first three days, from the 26th on, the rest."""
    number = F.dayofmonth(day)
    return F.when(number <= 3, F.lit("月初")).when(number >= 26, F.lit("月末")).otherwise(F.lit("月中"))


def week_window(day: Column) -> Column:
    return F.when(is_weekend(day), F.lit("週末")).otherwise(F.lit("平日"))


def event_window(day: Column) -> Column:
    return F.concat_ws(" / ", month_window(day), week_window(day))


def horizon_bucket(horizon: Column) -> Column:
    return F.when(horizon <= 1, F.lit(1)).when(horizon <= 7, F.lit(7)).otherwise(F.lit(30))
