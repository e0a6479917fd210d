"""The whole backtest report as one job, and the bundles written from it.

Intermediate frames are calendar-sized, while the plans that make them are long. Each is materialised once on the
checkpoint folder: later steps start from a short plan, and a lost executor costs a read, not a recomputation.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.series import daily_series
from tallyspark.plans import backtest as b
from tallyspark.plans import governance as g
from tallyspark.plans import signals as s
from tallyspark.rules import BusinessRules
from tallyspark.session import cut_lineage


class BacktestReport:
    """Detail, summaries, signals, selectors, diagnostics and weights of the rolling backtest.

    ``receipts`` are official receipts of both tables. With a ``series_key`` tracks, signals and selectors are also made
    per series; summaries of classes and risk, and what governance reads, describe the series ``all``. Frames are built when
    first asked for.
    """

    def __init__(self, receipts: DataFrame, rules: BusinessRules, calendar, series_key: Column | None = None, window_days: int = b.WINDOW_DAYS):
        self.receipts, self.rules, self.series_key, self.window_days = receipts, rules, series_key, window_days
        self._calendar = calendar

    @cached_property
    def calendar(self):
        return tuple(cut_lineage(c) for c in self._calendar)

    @cached_property
    def series(self) -> DataFrame:
        out = daily_series(self.receipts, self.rules.cruise_depts)
        if self.series_key is not None:
            out = out.unionByName(daily_series(self.receipts, self.rules.cruise_depts, self.series_key))
        return cut_lineage(out)

    @cached_property
    def source(self) -> DataFrame:
        return s.spike_source(self.receipts, self.rules)

    @cached_property
    def order_days(self) -> DataFrame:
        """Written once: the signals of all cutoffs and series read these rows, not the receipts."""
        return cut_lineage(s.order_days(self.source, self.series_key))

    @cached_property
    def order_states(self) -> DataFrame:
        return cut_lineage(s.order_states(self.order_days, b.reference_rows(self.base_detail)))

    @cached_property
    def base_detail(self) -> DataFrame:
        return cut_lineage(b.backtest_detail(self.series, self.calendar, self.window_days))

    @cached_property
    def spike_detail(self) -> DataFrame:
        return cut_lineage(s.spike_detail(self.base_detail, self.order_days, self.calendar, self.order_states))

    @cached_property
    def event_detail(self) -> DataFrame:
        return cut_lineage(s.event_detail(self.spike_detail, self.order_days, self.order_states))

    @cached_property
    def selector_detail(self) -> DataFrame:
        return cut_lineage(s.spike_aware_selector(self.base_detail, self.spike_detail))

    @cached_property
    def with_selector(self) -> DataFrame:
        return self.base_detail.unionByName(self.selector_detail.select(*self.base_detail.columns))

    @cached_property
    def base_summary(self) -> DataFrame:
        return cut_lineage(b.backtest_summary(self.with_selector))

    @cached_property
    def detail(self) -> DataFrame:
        return cut_lineage(b.with_fusion(self.with_selector))

    @cached_property
    def summary(self) -> DataFrame:
        return b.backtest_summary(self.detail)

    @cached_property
    def robust(self) -> DataFrame:
        return cut_lineage(b.robust_errors(self.detail))

    @cached_property
    def normal_day_detail(self) -> DataFrame:
        return cut_lineage(s.normal_day_detail(self.detail, self.robust, self.series))

    @cached_property
    def two_lane_detail(self) -> DataFrame:
        return s.two_lane_detail(self.event_detail, self.normal_day_detail)

    @cached_property
    def spike_days(self) -> DataFrame:
        return cut_lineage(s.spike_days(self.detail))

    @cached_property
    def risk_summary(self) -> DataFrame:
        return s.risk_summary(s.of_series(self.spike_detail))

    def datasets(self) -> dict[str, DataFrame]:
        """Every table of the report by name."""
        return {
            "detail": self.detail,
            "summary": self.summary,
            "diagnostics": b.segmented_errors(self.detail, self.calendar),
            "robust": self.robust,
            "accuracy_baseline": s.accuracy_baseline(self.summary, self.robust, self.risk_summary),
            "normal_day_detail": self.normal_day_detail,
            "normal_day_summary": s.normal_day_summary(self.normal_day_detail),
            "spike_days": s.spike_day_summary(self.spike_days, self.source, self.calendar),
            "spike_contributors": s.contributors(self.spike_days, self.source),
            "spike_detail": self.spike_detail,
            "risk_summary": self.risk_summary,
            "spike_class_summary": s.spike_class_summary(s.of_series(self.spike_detail)),
            "event_detail": self.event_detail,
            "event_class_summary": s.event_class_summary(s.of_series(self.event_detail)),
            "two_lane_detail": self.two_lane_detail,
            "two_lane_summary": s.two_lane_summary(self.two_lane_detail),
            "selector_detail": self.selector_detail,
            "weights": b.weight_table(self.base_summary),
            "strategy_comparison": b.strategy_comparison(self.base_summary),
        }


def macro_report(series: DataFrame, window_days: int = b.WINDOW_DAYS) -> dict[str, DataFrame]:
    detail = cut_lineage(b.macro_with_fusion(cut_lineage(b.macro_detail(series, window_days))))
    return {"detail": detail, "summary": b.macro_summary(detail)}


def governance_report(report: BacktestReport, macro: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The governance matrix over official, diagnostic, experimental and macro rows."""
    daily = F.lit(g.DAILY_VIEW)
    rows = g.governance_input(report.detail.where((F.col("horizon") == 1) & (F.col("series_id") == "all")), daily, g.OFFICIAL)
    rows = rows.unionByName(g.governance_input(s.of_series(report.normal_day_detail).where("is_normal"), daily, g.DIAGNOSTIC))
    rows = rows.unionByName(g.governance_input(s.of_series(report.two_lane_detail), daily, g.EXPERIMENT, F.col("lane")))
    rows = rows.unionByName(g.governance_input(macro["detail"].where(F.col("series_id") == "all"), F.col("layer"), g.OFFICIAL))
    matrix = g.governance_matrix(rows)
    summary = g.governance_summary(matrix)
    return {"matrix": matrix, "summary": summary, "overall": g.overall_governance(summary), "recommendations": g.recommendations(matrix)}


def feature_report(report: BacktestReport) -> dict[str, DataFrame]:
    snapshot = g.feature_snapshot(s.of_series(report.spike_detail), s.of_series(report.event_detail))
    families = {
        "Spike Signal": report.risk_summary,
        "Event Lead Signal": s.event_class_summary(s.of_series(report.event_detail)),
        "Two-Lane Selector": s.two_lane_summary(s.of_series(report.two_lane_detail)),
    }
    return {"snapshot": snapshot, "health": g.feature_health(snapshot), "readiness": g.signal_readiness(families), "overview": g.snapshot_overview(snapshot)}
