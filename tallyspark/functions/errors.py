"""Forecast error columns and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_errors(df: DataFrame, actual: str = "actual", prediction: str = "prediction") -> DataFrame:
    a, p = F.col(actual), F.col(prediction)
    error = p - a
    size = F.abs(a) + F.abs(p)
    return df.withColumns(
        {
            "error": error,
            "abs_error": F.abs(error),
            "ape": F.when(a != 0, F.abs(error) / a * 100),
            "smape": F.when(size != 0, 2 * F.abs(error) / size * 100),
        }
    )


def ratio_pct(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator != 0, numerator / denominator * 100)


def error_aggregates(keep: Column | None = None) -> list[Column]:
    """The standard error summary; ``keep`` restricts it to flagged rows."""

    def pick(name: str) -> Column:
        return F.col(name) if keep is None else F.when(keep, F.col(name))

    return [
        F.avg(pick("abs_error")).alias("mae"),
        ratio_pct(F.sum(pick("abs_error")), F.sum(pick("actual"))).alias("wape"),
        F.avg(pick("ape")).alias("mape"),
        # one value per (cutoff, horizon) in a group, so the exact median stays small
        F.percentile(pick("ape"), 0.5).alias("median_ape"),
        F.avg(pick("smape")).alias("smape_avg"),
        F.avg(pick("error")).alias("bias"),
        F.count(pick("ape")).alias("samples"),
    ]


def summarize_errors(detail: DataFrame, keys: list[str], extra: list[Column] | None = None) -> DataFrame:
    return detail.groupBy(*keys).agg(*error_aggregates(), *(extra or []))
