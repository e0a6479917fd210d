"""Column roles. Operators use role names, so they run on any receipt, order or event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.dates import to_day
from tallyspark.functions.money import number_or_zero
from tallyspark.functions.text import blank_coalesce

# The column headings of the receipt and product sheets, by role.
SHEET_HEADINGS = {
    "order_id": "來源單據號",
    "secondary_key": "交易號碼",
    "receipt_no": "收款單號",
    "receipt_time": "收款時間",
    "trans_time": "交易時間",
    "unified_date": "統一日期",
    "amount": "收款原幣金額",
    "base_amount": "收款本幣金額",
    "receivable": "應收",
    "received": "已收",
    "qty": "數量",
    "days": "行程天數",
    "branch": "銷售點",
    "sub_branch": "副表_銷售點",
    "salesperson": "銷售員",
    "operator": "收款操作員",
    "dept": "團負責人部門",
    "dept_owner": "團負責人",
    "dest_category": "目的地大類",
    "dest_level1": "一級目的地",
    "dest_level2": "二級目的地",
    "dest_name": "目的地名稱",
    "tour_name": "團名稱",
    "tour_code": "團代號",
    "source_tag": "來源報表標籤",
    "source_name": "資料來源",
    "receipt_type": "收款類型",
    "pay_method": "收款方式",
    "pay_serial": "收款流水號",
    "currency": "幣種",
    "original_currency": "原幣幣種",
    "fx_rate": "匯率",
    "customer": "客戶名稱",
    "sales_company": "銷售公司",
    "summary_no": "匯總單號",
    "receipt_state": "收款單狀態",
    "receipt_month": "收款月份分組",
    "trans_month": "交易月份分組",
    "refund_no": "退款單號",
    "refund_amount": "退款原幣金額",
    "refund_status": "退款狀態",
    "refund_date": "退款日期",
}

# Texts that stand for "no value".
UNKNOWN = "未知"
UNCLASSIFIED = "未分類"
UNMATCHED = "未匹配"

# Default text of a role whose column is absent.
ABSENT_TEXT = {
    "branch": UNKNOWN,
    "dept": "",
    "dest_category": UNCLASSIFIED,
    "salesperson": UNKNOWN,
    "source_tag": "",
    "tour_name": "",
    "order_id": "",
}
MEASURES = ("amount", "days", "qty")


def to_roles(df: DataFrame, headings: dict[str, str] | None = None) -> DataFrame:
    """Rename sheet headings to role names; unknown columns keep their names."""
    by_heading = {heading: role for role, heading in (headings or SHEET_HEADINGS).items()}
    return df.select([F.col(f"`{c}`").alias(by_heading.get(c, c)) for c in df.columns])


def to_headings(df: DataFrame, headings: dict[str, str] | None = None) -> DataFrame:
    names = headings or SHEET_HEADINGS
    return df.select([F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns])


def first_present(df: DataFrame, candidates: list[str]) -> str | None:
    return next((c for c in candidates if c in df.columns), None)


# Which side of a suffixed join column wins.
SUFFIX_PREFERENCE = {
    "salesperson": ("salesperson_x", "salesperson_y"),
    "tour_code": ("tour_code_y", "tour_code_x"),
    "tour_name": ("tour_name_y", "tour_name_x"),
}


def merge_suffixed(df: DataFrame, parity: bool = False) -> DataFrame:
    """Fold ``role_x``/``role_y`` pairs left by a join into ``role``.

    ``parity=True`` keeps the old rule in which a null first choice blocks the second one.
    """
    for role, pair in SUFFIX_PREFERENCE.items():
        present = [c for c in pair if c in df.columns]
        if role not in df.columns:
            merged: Column = F.lit("")
            for name in present:
                merged = blank_coalesce(merged, F.col(name), null_blocks=parity)
            df = df.withColumn(role, merged)
        df = df.drop(*present)
    return df


def normalize_receipts(df: DataFrame, parity: bool = False) -> DataFrame:
    """Give every frame the same typed roles; idempotent, one projection."""
    df = merge_suffixed(df, parity) if any(c.endswith(("_x", "_y")) for c in df.columns) else df
    present = set(df.columns)
    out = {c: F.col(f"`{c}`") for c in df.columns}
    if "unified_date" in present:
        day = to_day(df, "unified_date")
    else:
        source = first_present(df, ["receipt_time", "trans_time"])
        day = to_day(df, source) if source else F.lit(None).cast("date")
    out["unified_date"] = day
    for role, text in ABSENT_TEXT.items():
        if role not in present:
            out[role] = F.lit(text)
    if "trans_time" not in present:
        out["trans_time"] = day.cast("timestamp_ntz")
    for role in MEASURES:
        out[role] = number_or_zero(F.col(role)) if role in present else F.lit(0.0)
    return df.select([expr.alias(name) for name, expr in out.items()])
