"""Exact order statistics for columns of any size.

The built-in exact percentile keeps a whole group's value histogram in one task. Here a sketch brackets the wanted
rank, everything below the bracket is folded into one count, and only the values inside are ranked exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000


def _ranked_bracket(df: DataFrame, groups: list[str], value: str, share: float) -> DataFrame:
    """Distinct values near ``share`` with their running row count ``_cum``, plus the group size ``_n``.

    The rows are read twice: once for the sketch, once to fold them. All values under the bracket become one row with the
    largest of them, all values over it one row with the smallest, so that a rank just outside is still exact, however
    small the group. Both passes combine map-side, and only the bracket is shuffled.
    """
    data = df.select(*groups, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    slack = 4 / ACCURACY
    marks = F.percentile_approx("_v", [max(0.0, share - slack), min(1.0, share + slack)], ACCURACY)
    size = data.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"), marks.alias("_m"))
    size = size.select(*groups, "_n", F.col("_m")[0].alias("_lo"), F.col("_m")[1].alias("_hi"))
    if groups:
        marked = data.join(size, groups)
    else:
        row = size.select(F.struct("_n", "_lo", "_hi").alias("s")).scalar()
        marked = data.withColumn("_s", row).select("_v", "_s.*")
    side = F.when(F.col("_v") < F.col("_lo"), -1).when(F.col("_v") > F.col("_hi"), 1).otherwise(0)
    folded = (
        marked.withColumn("_side", side)
        .groupBy(*groups, "_n", "_side", F.when(F.col("_side") == 0, F.col("_v")).alias("_at"))
        .agg(F.count(F.lit(1)).alias("_c"), F.sum("_v").alias("_s"), F.max("_v").alias("_max"), F.min("_v").alias("_min"))
        .withColumn("_v", F.when(F.col("_side") < 0, F.col("_max")).otherwise(F.col("_min")))
    )
    order = Window.partitionBy(*groups, "_n").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    return folded.withColumn("_cum", F.sum("_c").over(order))


def exact_quantile(df: DataFrame, groups: list[str], value: str, share: float, out: str) -> DataFrame:
    """Linear-interpolated quantile per group, equal to sorting the whole group."""
    position = F.lit(float(share)) * (F.col("_n") - 1)
    ranked = _ranked_bracket(df, groups, value, share)
    ends = ranked.groupBy(*groups, "_n").agg(
        F.min(F.when(F.col("_cum") > F.floor(position), F.col("_v"))).alias("_a"),
        F.min(F.when(F.col("_cum") > F.ceil(position), F.col("_v"))).alias("_b"),
    )
    weight = position - F.floor(position)
    return ends.select(*groups, (F.col("_a") + (F.col("_b") - F.col("_a")) * weight).alias(out))


def top_share_sum(df: DataFrame, value: str, share: float, count_of: Callable[[Column], Column]) -> DataFrame:
    """Sum of the ``count_of(n)`` largest values: one row ``(top_rows, top_sum, all_sum, all_rows)``."""
    k = count_of(F.col("_n"))
    ranked = _ranked_bracket(df, [], value, 1 - share)
    # the wanted rank is in the bracket or next to it, so all rows over the bracket are among the largest
    cut = F.min(F.when(F.col("_cum") > F.col("_n") - k, F.col("_v"))).over(Window.partitionBy("_n"))
    marked = ranked.withColumn("_cut", cut).withColumn("_above", (F.col("_v") > F.col("_cut")) | (F.col("_side") > 0))
    sums = marked.agg(
        F.max("_n").alias("_n"),
        F.max("_cut").alias("_cut"),
        F.coalesce(F.sum(F.when(F.col("_above"), F.col("_c"))), F.lit(0)).alias("_taken"),
        F.coalesce(F.sum(F.when(F.col("_above"), F.col("_s"))), F.lit(0.0)).alias("_taken_sum"),
        F.coalesce(F.sum("_s"), F.lit(0.0)).alias("all_sum"),
        F.coalesce(F.sum("_c"), F.lit(0)).alias("all_rows"),
    )
    return sums.select(
        F.coalesce(k, F.lit(0)).alias("top_rows"),
        F.coalesce(F.col("_taken_sum") + (k - F.col("_taken")) * F.col("_cut"), F.lit(0.0)).alias("top_sum"),
        "all_sum",
        "all_rows",
    )
