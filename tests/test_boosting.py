"""Trees of a grid of cutoffs against trees grown one by one, and against a changed future."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import series as s
from tallyspark.plans import boosting, forecast
from tallyspark.sources import calendar

FIRST = datetime.date(2021, 1, 1)
LAGS = ("lag_1", "lag_7", "rolling_mean_7")


def day(n):
    return FIRST + datetime.timedelta(n)


def values(count, seed):
    dice = random.Random(seed)
    return [round(500 + 300 * (n % 7 > 4) + 40 * dice.random() + n, 2) for n in range(count)]


def frame(spark, by_series):
    rows = [(name, s.TOTAL, day(n), v) for name, found in by_series.items() for n, v in enumerate(found)]
    return spark.createDataFrame(rows, "series_id string, line string, date date, revenue double")


def at(spark, rows):
    return spark.createDataFrame(rows, "series_id string, cutoff date")


def one_tree(rows, made, depth):
    """What the tree of one model adds to each of its days, by trying every split."""
    residual = [label - m for (label, _), m in zip(rows, made)]
    steps = [0] * len(rows)

    def weight(members):
        total = float(sum(residual[i] for i in members))
        return total * total / len(members)

    def split(members, left):
        best = None
        for feature in range(len(LAGS)):
            for at_bin in range(boosting.BINS + 1):
                low = [i for i in members if rows[i][1][feature] <= at_bin]
                high = [i for i in members if rows[i][1][feature] > at_bin]
                if min(len(low), len(high)) < boosting.LEAST_ROWS:
                    continue
                gain = weight(low) + weight(high)
                if gain > weight(members) and (best is None or gain > best[0]):
                    best = (gain, low, high)
        if left == 0 or best is None:
            mean = sum(residual[i] for i in members) / len(members) * boosting.RATE
            for i in members:
                steps[i] = int(math.copysign(math.floor(abs(mean) + 0.5), mean))
            return
        split(best[1], left - 1)
        split(best[2], left - 1)

    split(list(range(len(rows))), depth)
    return steps


def test_models_equal_trees_grown_one_by_one(spark):
    series = frame(spark, {"a": [v * 100 for v in values(120, 1)], "b": [v * 100 for v in values(90, 2)]}).withColumn("revenue", F.round("revenue"))
    cutoffs = at(spark, [("a", day(80)), ("a", day(110)), ("b", day(85))])
    matrix = s.lag_features(series)
    rows = boosting.training_rows(matrix, LAGS, boosting.bin_edges(matrix, LAGS, cutoffs), cutoffs)
    models = boosting.fit(rows, 2, 2)
    made = boosting.predicted(F.col("start"), F.col("leaves"), F.col("codes"))
    found = rows.join(models, list(boosting.MODEL)).select(*boosting.MODEL, "date", "label", "codes", made.alias("made")).collect()
    assert len({(r.series_id, r.cutoff) for r in found}) == 3
    for name, cutoff in {(r.series_id, r.cutoff) for r in found}:
        own = sorted((r for r in found if (r.series_id, r.cutoff) == (name, cutoff)), key=lambda r: r.date)
        assert max(r.date for r in own) == cutoff and len(own) == (cutoff - FIRST).days + 1 - 7
        days = [(r.label, r.codes) for r in own]
        told = [math.floor(sum(x for x, _ in days) / len(days) + 0.5)] * len(days)
        for _ in range(2):
            told = [a + b for a, b in zip(told, one_tree(days, told, 2))]
        assert [r.made for r in own] == told


@pytest.fixture(scope="module")
def quiet(spark):
    days = spark.createDataFrame([(day(0),), (day(150),)], "d date")
    return calendar.recurring_calendar(days, "d", ["01-01", "05-01"], [("02-20", "02-23")])


def test_a_model_knows_nothing_after_its_cutoff(spark, quiet):
    past, cutoffs = values(120, 3), [("a", day(90)), ("a", day(100))]
    changed = past[:91] + [v * 7 + 1 for v in past[91:]]
    sides = [forecast.learned_track(frame(spark, {"a": v}), quiet, at(spark, cutoffs), 9, trees=2, depth=2).collect() for v in (past, changed)]
    early, late = [[{r.horizon: r.prediction for r in rows if r.cutoff == c} for rows in sides] for _, c in cutoffs]
    assert early[0] == early[1] and set(early[0]) == set(range(1, 10))
    assert late[0] != late[1]
    assert all(r.date == r.cutoff + datetime.timedelta(r.horizon) and r.prediction >= 0 for r in sides[0])


def test_short_and_empty_series_make_no_row(spark, quiet):
    short = frame(spark, {"a": values(20, 4)})
    assert forecast.learned_track(short, quiet, at(spark, [("a", day(15))]), 3, trees=1, depth=1).count() == 0
    assert forecast.learned_track(short.limit(0), quiet, at(spark, []), 3, trees=1, depth=1).count() == 0
