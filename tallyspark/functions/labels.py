"""Threshold ladders that turn numbers into labels, scores and advice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.money import clamp

# Fixed values: (limit, label) ladders. "below" ladders pick the first limit above the value,
# "at_least" ladders the first limit the value reaches.
ERROR_HEALTH_BELOW = ((10, "優秀"), (20, "可接受"), (30, "可參考"))
ERROR_HEALTH_REST = "需謹慎"
SCORE_HEALTH_AT_LEAST = ((90, "優秀"), (75, "可接受"), (60, "需關注"))
SCORE_HEALTH_REST = "需處理"
NOT_ASSESSED = "未評估"
NOT_APPLICABLE = "不適用"
CONFIDENCE_AT_LEAST = ((85, "高信心"), (70, "中信心"))
CONFIDENCE_REST = "觀察"
SAMPLE_SCORE_AT_LEAST = ((30, 100.0), (20, 85.0), (10, 65.0), (5, 45.0))
SAMPLE_SCORE_REST = 25.0
SAMPLE_SCORE_MISSING = 45.0
ROLE_SCORES = {"正式": 100.0, "診斷": 75.0, "實驗": 55.0}
ROLE_SCORE_REST = 60.0
GOVERNANCE_WEIGHTS = {"accuracy": 0.35, "bias": 0.20, "stability": 0.20, "sample": 0.15, "role": 0.10}

# Advice texts of the governance matrix.
ADVICE_EXPERIMENT = "保留為實驗；未打贏正式模型且穩定性未確認前不接入正式 Forecast。"
ADVICE_DIAGNOSTIC = "作為診斷最佳模型展示；不覆蓋正式 Daily Forecast。"
ADVICE_FEW_SAMPLES = "樣本不足，不建議切換或自動調權。"
ADVICE_BIAS = "需關注 Bias，先檢查長期高估/低估再調整模型。"
ADVICE_HEALTHY = "保持正式觀察；可作為管理層 forecast 健康參考。"
ADVICE_WATCH = "保持正式但需追蹤；優先檢查偏差、波動與極端日影響。"
ADVICE_REST = "需處理；不建議作為自動切換依據。"


def _missing(c: Column) -> Column:
    return c.isNull() | F.isnan(c.cast("double"))


def at_least(c: Column, ladder, rest) -> Column:
    out = F.lit(rest)
    for limit, value in reversed(ladder):
        out = F.when(c >= limit, F.lit(value)).otherwise(out)
    return out


def below(c: Column, ladder, rest) -> Column:
    out = F.lit(rest)
    for limit, value in reversed(ladder):
        out = F.when(c < limit, F.lit(value)).otherwise(out)
    return out


def error_health(c: Column) -> Column:
    return F.when(_missing(c), F.lit(NOT_ASSESSED)).otherwise(below(c, ERROR_HEALTH_BELOW, ERROR_HEALTH_REST))


def quality_health(c: Column, missing: str = NOT_APPLICABLE) -> Column:
    return F.when(_missing(c), F.lit(missing)).otherwise(at_least(c, SCORE_HEALTH_AT_LEAST, SCORE_HEALTH_REST))


def governance_health(c: Column) -> Column:
    return quality_health(c, NOT_ASSESSED)


def confidence_label(c: Column) -> Column:
    return F.when(_missing(c), F.lit(CONFIDENCE_REST)).otherwise(at_least(c, CONFIDENCE_AT_LEAST, CONFIDENCE_REST))


def severity_from_gap(gap: Column, threshold: float) -> Column:
    return (
        F.when(gap <= -max(threshold * 2, 0.1), F.lit("critical"))
        .when(gap <= -threshold, F.lit("warning"))
        .otherwise(F.lit("info"))
    )


def accuracy_score(avg_error: Column) -> Column:
    return F.when(_missing(avg_error), F.lit(55.0)).otherwise(clamp(100 - avg_error * 1.2, 0, 100))


def bias_direction(bias: Column) -> Column:
    return (
        F.when(_missing(bias), F.lit(NOT_ASSESSED))
        .when(bias > 0, F.lit("偏高估"))
        .when(bias < 0, F.lit("偏低估"))
        .otherwise(F.lit("中性"))
    )


def bias_score(mae: Column, bias: Column) -> Column:
    usable = (F.coalesce(mae, F.lit(0.0)) > 0) & ~_missing(bias)
    return F.when(usable, clamp(100 - F.abs(bias) / mae * 80, 0, 100)).otherwise(F.lit(60.0))


def stability_score(ape_count: Column, ape_std: Column) -> Column:
    """55 without rows, 50 under three rows, else falls with the spread of the error."""
    return (
        F.when(F.coalesce(ape_count, F.lit(0)) == 0, F.lit(50.0))
        .when(ape_count < 3, F.lit(50.0))
        .otherwise(clamp(100 - ape_std * 1.35, 0, 100))
    )


def sample_score(n: Column) -> Column:
    return F.when(_missing(n), F.lit(SAMPLE_SCORE_MISSING)).otherwise(at_least(n, SAMPLE_SCORE_AT_LEAST, SAMPLE_SCORE_REST))


def role_score(role: Column) -> Column:
    out = F.lit(ROLE_SCORE_REST)
    for name, value in ROLE_SCORES.items():
        out = F.when(role == name, F.lit(value)).otherwise(out)
    return out


def governance_advice(role: Column, health: Column, bias_ratio: Column, samples: Column) -> Column:
    return (
        F.when(role == "實驗", F.lit(ADVICE_EXPERIMENT))
        .when(role == "診斷", F.lit(ADVICE_DIAGNOSTIC))
        .when(samples < 20, F.lit(ADVICE_FEW_SAMPLES))
        .when(F.abs(bias_ratio) > 0.8, F.lit(ADVICE_BIAS))
        .when(health.isin("優秀", "可接受"), F.lit(ADVICE_HEALTHY))
        .when(health == "需關注", F.lit(ADVICE_WATCH))
        .otherwise(F.lit(ADVICE_REST))
    )
