"""Dashboard and report bundles from the two detail tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyspark.functions.hashing import state_token, table_print
from tallyspark.operators import dashboards as d
from tallyspark.operators.filters import Period
from tallyspark.operators.mart import Mart
from tallyspark.operators.scope import freshness, official_rows, scope_audit
from tallyspark.rules import BusinessRules


def build_facts(receipts: DataFrame, rules: BusinessRules, tie_order: tuple[str, ...] = (), keep: bool = False) -> dict:
    """Raw, official and daily-fact frames under one rule set; ``keep`` persists the small grid."""
    official = official_rows(receipts, rules.excluded_types, rules.excluded_methods)
    mart = Mart(official, rules, tie_order)
    facts = mart.facts()
    return {
        "mart": mart,
        "raw": receipts,
        "official": official,
        "audit": scope_audit(receipts, rules.excluded_types, rules.excluded_methods),
        "facts": facts.persist() if keep else facts,
        "rules": rules,
    }


def facts_token(facts: dict, columns: list[str]) -> DataFrame:
    """Content token of the frames behind the facts."""
    prints = {k: table_print(facts[k], columns) for k in ("raw", "official")}
    return state_token(prints, facts["rules"].fingerprint())


def dashboard_summary(facts: dict, period: Period = Period(), entity: str | None = None, seller: str | None = None, rows: int | None = None) -> dict[str, DataFrame]:
    """``rows`` cuts the product mix for display."""
    grid = facts["facts"]
    mix = d.of_channel(grid, "specialist").orderBy("entity", "day")
    view = d.filtered(grid, period, entity, seller)
    return {
        "scope_audit": facts["audit"],
        "kpis": d.kpi_row(grid, facts["official"], period, entity, seller),
        "revenue_totals": d.revenue_totals(grid, period, entity, seller),
        "data_freshness": freshness(facts["official"], facts["audit"]),
        "branch_ranking": d.ranking(d.of_channel(view, "branch"), top=20, share_after_top=True),
        "specialist_ranking": d.ranking(d.of_channel(view, "specialist"), top=20, share_after_top=True),
        "product_mix": mix if rows is None else mix.limit(rows),
    }


def dashboard_report(facts: dict, period: Period = Period(), entity: str | None = None, seller: str | None = None, gate: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Every dataset of the dashboard report under one set of filters."""
    summary = dashboard_summary(facts, period, entity, seller)
    analytics = d.analytics_bundle(facts["facts"], period, entity, seller)
    names = ("kpis", "revenue_totals", "data_freshness", "branch_ranking", "specialist_ranking", "product_mix")
    more = ("annual_summary", "monthly_trend", "branch_products", "specialist_products", "reconciliation")
    return {**{n: summary[n] for n in names}, **{n: analytics[n] for n in more}, **(gate or {})}
