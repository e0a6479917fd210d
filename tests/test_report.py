"""The backtest report with a key for its series."""

from pyspark.sql import functions as F

from tallyspark.plans import report
from tallyspark.suite import forecasting
from tallyspark.suite.base import RULES, Tables


def test_signals_and_lanes_are_made_for_every_series(spark, small):
    tables = Tables(spark, small)
    made = report.BacktestReport(tables.official(), RULES, forecasting._calendar(tables), F.col("branch"))

    def per_series(frame):
        return {r.series_id: r["count"] for r in frame.groupBy("series_id").count().collect()}

    spikes = per_series(made.spike_detail)
    assert len(spikes) > 5 and spikes["all"] == 30
    assert per_series(made.event_detail) == spikes
    assert per_series(made.selector_detail) == {k: 3 * n for k, n in spikes.items()}
    assert per_series(made.normal_day_detail) == {k: 11 * n for k, n in spikes.items()}
    assert per_series(made.two_lane_detail) == {k: 12 * n for k, n in spikes.items()}
    assert made.spike_detail.where(~F.col("no_future_leak")).count() == 0
