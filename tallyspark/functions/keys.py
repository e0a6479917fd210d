"""Per-key helpers that stay safe when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``, remaining columns breaking ties.

    A minimum over a struct combines map-side, so a hot key is reduced before the shuffle; a window would
    send all its rows to one task.
    """
    rest = [c for c in df.columns if c not in keys]
    packed = F.struct(*[e.alias(f"_o{i}") for i, e in enumerate(order)], *[F.col(f"`{c}`") for c in rest])
    picked = df.groupBy(*keys).agg(F.min(packed).alias("_first"))
    return picked.select(*keys, *[F.col(f"_first.`{c}`").alias(c) for c in rest]).select(*df.columns)


def nulls_last(c: Column) -> list[Column]:
    return [c.isNull(), c]


def attach_one_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Put the columns of a one-row frame on every row, as a scalar subquery instead of a join."""
    names = row.columns
    return df.withColumn("_row", row.select(F.struct(*names).alias("s")).scalar()).select(
        *df.columns, *[F.col(f"_row.`{c}`").alias(c) for c in names]
    )
