"""Boosted histogram trees for a whole grid of (series, line, cutoff) at once.

Every model of the grid grows from the days its cutoff knows and from no later one. Features are binned once; each level of
a tree is one aggregate of residuals by (model, node, feature, bin) for all models together, so the number of jobs depends on
the trees and not on the models. Labels, residuals and leaf values are whole minor units: their sums are exact, whatever
order they are added in, and a model is the same at every number of tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.series import KEYS, history_to, let
from tallyspark.session import written

MODEL = (*KEYS, "cutoff")
BINS = 16
RATE = 0.3
LEAST_ROWS = 5  # days on either side of a split


def bin_edges(matrix: DataFrame, features: tuple[str, ...], cutoffs: DataFrame) -> DataFrame:
    """Edges between the bins of every feature, by series and line: quantiles of the days up to the first cutoff of the series.

    All its models know these days. Groups are as long as the calendar. A series without such days has no edges.
    """
    first = cutoffs.groupBy("series_id").agg(F.min("cutoff").alias("_first"))
    known = matrix.join(first, "series_id").where(F.col("date") <= F.col("_first"))
    shares = [k / BINS for k in range(1, BINS)]
    return known.groupBy(*KEYS).agg(F.array(*[F.percentile(f, shares) for f in features]).alias("edges"))


def codes(values: list[Column], edges: Column) -> Column:
    """The bin of every value: how many of its edges lie below it."""

    def code(value: Column, own: Column) -> Column:
        return let(value, lambda v: F.coalesce(F.array_size(F.filter(own, lambda e: e < v)), F.lit(0)))

    return F.array(*[code(v, edges[i]) for i, v in enumerate(values)])


def training_rows(matrix: DataFrame, features: tuple[str, ...], edges: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """The days of every model with their bins and their label; days that lack a feature are left out."""
    whole = matrix.na.drop(subset=list(features)).join(edges, list(KEYS))
    coded = whole.select(*KEYS, "date", F.col("revenue").cast("long").alias("label"), codes([F.col(f) for f in features], F.col("edges")).alias("codes"))
    return history_to(coded, cutoffs)


def best_splits(rows: DataFrame) -> DataFrame:
    """The split of every node that lowers the squared error most: bins up to ``bin`` go left.

    Ties go to the first feature, then to the lowest bin. Nodes that no split improves have no row. Only sums by bin leave
    a task.
    """
    node = [*MODEL, "node"]
    cells = rows.select(*node, "residual", F.posexplode("codes").alias("feature", "bin")).groupBy(*node, "feature", "bin")
    sums = cells.agg(F.sum("residual").alias("_s"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*node, "feature")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    split = sums.select(
        *node,
        "feature",
        "bin",
        F.sum("_s").over(upto).alias("left_sum"),
        F.sum("_n").over(upto).alias("left_rows"),
        F.sum("_s").over(whole).alias("_all_sum"),
        F.sum("_n").over(whole).alias("_all_rows"),
    )

    def weight(total: Column, count: Column) -> Column:
        return total.cast("double") * total.cast("double") / count

    right_sum, right_rows = F.col("_all_sum") - F.col("left_sum"), F.col("_all_rows") - F.col("left_rows")
    enough = split.where((F.col("left_rows") >= LEAST_ROWS) & (right_rows >= LEAST_ROWS))
    judged = enough.withColumn("_gain", weight(F.col("left_sum"), F.col("left_rows")) + weight(right_sum, right_rows))
    better = judged.where(F.col("_gain") > weight(F.col("_all_sum"), F.col("_all_rows")))
    order = F.struct("_gain", -F.col("feature"), -F.col("bin"))
    best = better.groupBy(*node).agg(F.max_by(F.struct("feature", "bin", "left_rows", "left_sum"), order).alias("_b"))
    return best.select(*node, "_b.*")


def grow(rows: DataFrame, depth: int) -> DataFrame:
    """``rows`` with ``path``, the splits that lead to their leaf, and ``step``, what the leaf adds to a prediction."""
    node = [*MODEL, "node"]
    none = F.array().cast("array<struct<feature:int,bin:int,right:boolean>>")
    work = rows.withColumns({"residual": F.col("label") - F.col("made"), "node": F.lit(1), "path": none})
    for _ in range(depth):
        # a few rows for each model, written before the next level names them twice
        splits = written(best_splits(work).select(*node, "feature", "bin"))
        work = work.join(splits, node, "left")
        right = F.col("codes")[F.col("feature")] > F.col("bin")
        turn = F.struct("feature", "bin", right.alias("right"))
        path = F.when(F.col("feature").isNotNull(), F.concat("path", F.array(turn))).otherwise(F.col("path"))
        work = work.withColumns({"path": path, "node": F.col("node") * 2 + F.coalesce(right, F.lit(False)).cast("int")}).drop("feature", "bin")
    mean = F.avg("residual").over(Window.partitionBy(*node))
    return work.withColumn("step", F.round(mean * RATE).cast("long")).drop("residual")


def fit(rows: DataFrame, trees: int, depth: int) -> DataFrame:
    """One row per model: its ``start`` and the ``leaves`` of all its trees, each a path and what it adds.

    The leaves of one tree share out all days, so a prediction is the start and the steps of the paths that hold.
    """
    start = F.round(F.avg("label").over(Window.partitionBy(*MODEL))).cast("long")
    state = rows.withColumn("start", start).withColumn("made", F.col("start"))
    leaves = None
    for _ in range(trees):
        # a tree is written once; its days and its leaves are read from there
        grown = written(grow(state, depth))
        found = grown.groupBy(*MODEL, "node").agg(F.any_value("start").alias("start"), F.any_value("path").alias("path"), F.any_value("step").alias("step"))
        leaves = found if leaves is None else leaves.unionByName(found)
        state = grown.withColumn("made", F.col("made") + F.col("step")).drop("node", "path", "step")
    if leaves is None:
        return state.groupBy(*MODEL).agg(F.any_value("start").alias("start"), F.array().cast("array<struct<path:array<struct<feature:int,bin:int,right:boolean>>,step:bigint>>").alias("leaves"))
    return leaves.groupBy(*MODEL).agg(F.any_value("start").alias("start"), F.collect_list(F.struct("path", "step")).alias("leaves"))


def predicted(start: Column, leaves: Column, coded: Column) -> Column:
    """What a model says of a day with the bins ``coded``."""

    def step(leaf: Column, own: Column) -> Column:
        holds = F.forall(leaf["path"], lambda s: (own[s["feature"]] > s["bin"]) == s["right"])
        return F.when(holds, leaf["step"]).otherwise(F.lit(0).cast("long"))

    return let(coded, lambda own: F.aggregate(leaves, start, lambda total, leaf: total + step(leaf, own)))
