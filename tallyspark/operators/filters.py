"""Period filters and choice lists. All predicates stay on plain columns so they reach the scan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.dates import month_key, time_of, to_day
from tallyspark.functions.text import plain_spaces


@dataclass(frozen=True)
class Period:
    """Years, months and a day range; all given parts must hold. Months may be ``yyyy-MM`` or ``MM``."""

    years: tuple[int, ...] = ()
    months: tuple[str, ...] = ()
    date_range: tuple[str, ...] = field(default=())

    def predicate(self, day: Column) -> Column:
        keep = F.lit(True)
        if self.years:
            keep = keep & F.year(day).isin(*self.years)
        if self.months:
            texts = [str(m).strip() for m in self.months]
            full = [m for m in texts if "-" in m]
            numbers = [m.zfill(2) for m in texts if m and "-" not in m]
            hit = F.lit(False)
            if full:
                hit = hit | month_key(day).isin(*full)
            if numbers:
                hit = hit | F.date_format(day, "MM").isin(*numbers)
            keep = keep & hit
        if len(self.date_range) == 2:
            start, end = (F.lit(d).cast("date") for d in self.date_range)
            keep = keep & (day >= start) & (day <= end)
        elif len(self.date_range) == 1:
            keep = keep & (day == F.lit(self.date_range[0]).cast("date"))
        return keep

    def apply(self, df: DataFrame, column: str) -> DataFrame:
        return df.where(self.predicate(to_day(df, column)))


def in_month(df: DataFrame, month: str, column: str = "unified_date") -> DataFrame:
    return df.where(month_key(to_day(df, column)) == month)


def period_column(df: DataFrame, candidates=("unified_date", "receipt_time", "trans_time")) -> str | None:
    """The first date column that holds any parseable value (one small aggregate)."""
    present = [c for c in candidates if c in df.columns]
    if not present:
        return None
    row = df.agg(*[F.max(time_of(df, c).isNotNull()).alias(c) for c in present]).first()
    return next((c for c in present if row[c]), None)


def rule_period(df: DataFrame, column: str | None, month: str = "", year: str = "") -> Column:
    if not month and not year:
        return F.lit(True)
    if column is None:
        return F.lit(False)
    stamp = time_of(df, column)
    text = F.date_format(stamp, "yyyy-MM") if month else F.date_format(stamp, "yyyy")
    return F.coalesce(text == (month or year), F.lit(False))


def options(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-blank texts of a column, sorted."""
    text = F.trim(plain_spaces(F.col(column).cast("string")))
    return df.select(text.alias("value")).where(F.col("value") != "").distinct().orderBy("value")


def date_context(receipts: DataFrame) -> DataFrame:
    """One row: row counts, date bounds, and the years and months present."""
    daily = receipts.groupBy("unified_date").agg(
        F.count(F.when(F.col("is_tour"), 1)).alias("tour_rows"), F.count(F.when(~F.col("is_tour"), 1)).alias("others_rows")
    )
    day = F.col("unified_date")
    return daily.agg(
        F.sum("tour_rows").alias("tour_rows"),
        F.sum("others_rows").alias("others_rows"),
        F.date_format(F.min(day), "yyyy-MM-dd").alias("min_date"),
        F.date_format(F.max(day), "yyyy-MM-dd").alias("max_date"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.date_format(day, "yyyy")))).alias("years"),
        F.concat_ws(",", F.array_sort(F.collect_set(month_key(day)))).alias("months"),
    )
