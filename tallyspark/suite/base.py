"""Role mapping of the driver tables, and the registry of check queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.rules import BusinessRules
from tallyspark.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its reference SQL."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


DESK = "SPECIALIST DESK"
SPECIALISTS = tuple(f"REP_{i:02d}" for i in range(5))
NATIONS = {f"{i:02d}": f"NATION_{i}" for i in range(25)}
CRUISE_BRANDS = ("Brand#1", "Brand#2", "Brand#3")
RULES = BusinessRules(
    branch_map={**NATIONS, "99": DESK},
    exclude_prefixes=(),
    target_branches=tuple(NATIONS.values()),
    specialists=SPECIALISTS,
    cruise_depts=CRUISE_BRANDS,
    overrides=(),
    specialist_desk=DESK,
)
TIES = ("receipt_time", "receipt_no", "part_key", "supplier_key", "amount")


def order_code(key: Column) -> Column:
    """Order number text: two digits that name a branch, one more digit, then the key."""
    return F.concat(F.lpad((key % 30).cast("string"), 2, "0"), (key % 7).cast("string"), F.lit("-"), key.cast("string"))


def order_code_sql(key: str) -> str:
    return f"lpad(CAST({key} % 30 AS VARCHAR), 2, '0') || CAST({key} % 7 AS VARCHAR) || '-' || CAST({key} AS VARCHAR)"


_LINE = {
    "order_id": lambda: order_code(F.col("l_orderkey")),
    "order_key": lambda: F.col("l_orderkey"),
    "line_no": lambda: F.col("l_linenumber"),
    "part_key": lambda: F.col("l_partkey"),
    "supplier_key": lambda: F.col("l_suppkey"),
    "receipt_no": lambda: F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")),
    "receipt_time": lambda: F.col("l_shipdate"),
    "unified_date": lambda: F.to_date("l_shipdate"),
    # net price in whole cents, half up; integers keep it exact and inside generated code
    "amount": lambda: F.floor(
        (F.round(F.col("l_extendedprice") * 100).cast("long") * (F.lit(100) - F.round(F.col("l_discount") * 100).cast("long")) + 50) / 100
    )
    / F.lit(100.0),
    "qty": lambda: F.col("l_quantity"),
    "salesperson": lambda: F.concat(F.lit("REP_"), F.lpad((F.col("l_suppkey") % 60).cast("string"), 2, "0")),
    "operator": lambda: F.when(F.col("l_linenumber") == 1, F.concat(F.lit("rep_"), F.lpad((F.col("l_suppkey") % 60).cast("string"), 2, "0"), F.lit(" 櫃台"))).otherwise(
        F.concat(F.lit("TELLER "), (F.col("l_suppkey") % 9).cast("string"))
    ),
    "receipt_type": lambda: F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), F.lit("掛賬核銷")).otherwise(
        F.concat("l_returnflag", "l_linestatus")
    ),
    "returnflag": lambda: F.col("l_returnflag"),
    "linestatus": lambda: F.col("l_linestatus"),
}
_ORDER = {
    "trans_time": lambda: F.col("o_orderdate"),
    "pay_method": lambda: F.when((F.col("o_orderstatus") == "P") & (F.col("l_linenumber") == 7), F.lit("TT 退款轉團款")).otherwise(
        F.col("o_orderstatus")
    ),
}
_PART = {
    "days": lambda: F.col("p_size").cast("double"),
    "dept": lambda: F.col("p_brand"),
    "dest_category": lambda: F.when(F.col("p_type") == "ECONOMY", F.lit("海外遊"))
    .when(F.col("p_type") == "LARGE", F.lit("港澳遊"))
    .when(F.col("p_type") == "MEDIUM", F.lit("中國長線團"))
    .otherwise(F.lit("")),
    "tour_name": lambda: F.when(F.col("p_name").endswith("ring"), F.lit("機票"))
    .when(F.col("p_name").endswith("widget"), F.lit("高鐵"))
    .when(F.col("p_name").endswith("bolt"), F.lit("船票"))
    .when(F.col("p_name").endswith("gear"), F.lit("巴士"))
    .otherwise(F.col("p_name")),
    "source_tag": lambda: F.when(F.col("l_linenumber") == 5, F.lit("未匹配"))
    .when(F.col("p_type") == "PROMO", F.lit("酒店"))
    .when(F.col("p_type") == "SMALL", F.lit("套票"))
    .otherwise(F.lit("門券")),
    "is_tour": lambda: F.col("p_type").isin("ECONOMY", "LARGE", "MEDIUM"),
}
_SUPPLIER = {
    "branch": lambda: F.when(F.col("l_suppkey") % 60 < 5, F.lit(DESK)).otherwise(F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string"))),
    "sub_branch": lambda: F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")),
}

RECEIPTS_SQL = f"""receipts AS (
  SELECT {order_code_sql("l_orderkey")} AS order_id,
    l_orderkey AS order_key, l_linenumber AS line_no, l_partkey AS part_key, l_suppkey AS supplier_key,
    CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS receipt_no,
    l_shipdate AS receipt_time, CAST(l_shipdate AS DATE) AS unified_date,
    CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))), 2) AS DOUBLE) AS amount,
    l_quantity AS qty, 'REP_' || lpad(CAST(l_suppkey % 60 AS VARCHAR), 2, '0') AS salesperson,
    CASE WHEN l_linenumber = 1 THEN 'rep_' || lpad(CAST(l_suppkey % 60 AS VARCHAR), 2, '0') || ' 櫃台'
         ELSE 'TELLER ' || CAST(l_suppkey % 9 AS VARCHAR) END AS operator,
    CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN '掛賬核銷' ELSE l_returnflag || l_linestatus END AS receipt_type,
    l_returnflag AS returnflag, l_linestatus AS linestatus,
    o_orderdate AS trans_time,
    CASE WHEN o_orderstatus = 'P' AND l_linenumber = 7 THEN 'TT 退款轉團款' ELSE o_orderstatus END AS pay_method,
    CAST(p_size AS DOUBLE) AS days, p_brand AS dept,
    CASE p_type WHEN 'ECONOMY' THEN '海外遊' WHEN 'LARGE' THEN '港澳遊' WHEN 'MEDIUM' THEN '中國長線團' ELSE '' END AS dest_category,
    CASE WHEN p_name LIKE '%ring' THEN '機票' WHEN p_name LIKE '%widget' THEN '高鐵' WHEN p_name LIKE '%bolt' THEN '船票'
         WHEN p_name LIKE '%gear' THEN '巴士' ELSE p_name END AS tour_name,
    CASE WHEN l_linenumber = 5 THEN '未匹配' WHEN p_type = 'PROMO' THEN '酒店' WHEN p_type = 'SMALL' THEN '套票' ELSE '門券' END AS source_tag,
    p_type IN ('ECONOMY', 'LARGE', 'MEDIUM') AS is_tour,
    CASE WHEN l_suppkey % 60 < 5 THEN '{DESK}' ELSE 'NATION_' || CAST(s_nationkey AS VARCHAR) END AS branch,
    'NATION_' || CAST(s_nationkey AS VARCHAR) AS sub_branch
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey)"""

# official scope: orders without any excluded receipt
OFFICIAL_SQL = (
    RECEIPTS_SQL
    + """, poisoned AS (SELECT DISTINCT order_id FROM receipts WHERE receipt_type = '掛賬核銷' OR pay_method = 'TT 退款轉團款'),
official AS (SELECT * FROM receipts WHERE order_id NOT IN (SELECT order_id FROM poisoned))"""
)

ALL_ROLES = (
    "order_id",
    "receipt_no",
    "receipt_time",
    "unified_date",
    "trans_time",
    "amount",
    "qty",
    "days",
    "branch",
    "sub_branch",
    "salesperson",
    "operator",
    "dept",
    "dest_category",
    "tour_name",
    "source_tag",
    "receipt_type",
    "pay_method",
    "part_key",
    "supplier_key",
)


class Tables:
    """Driver tables by name, plus the receipts they map to."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = tune(spark)
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def receipts(self, *roles: str) -> DataFrame:
        """The asked roles only; a dimension is joined only if a role needs it."""
        wanted = roles or (*ALL_ROLES, "is_tour")
        return self._described(self._lines(wanted), wanted)

    def _lines(self, wanted) -> DataFrame:
        """Line items, with their order if a role needs it. The amount is worked out first: one column to move, not two."""
        df = self.lineitem
        if "amount" in wanted:
            df = df.withColumn("amount", _LINE["amount"]())
        if any(r in _ORDER for r in wanted):
            orders = self.orders.select("o_orderkey", "o_orderdate", "o_orderstatus")
            df = df.join(orders, df.l_orderkey == orders.o_orderkey, "left")
        return df

    def _described(self, df: DataFrame, wanted) -> DataFrame:
        """Lines with the parts and suppliers that the roles need, as roles."""
        if any(r in _PART for r in wanted):
            part = self.part.select("p_partkey", "p_size", "p_brand", "p_type", "p_name")
            df = df.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
        if any(r in _SUPPLIER for r in wanted):
            supplier = self.supplier.select("s_suppkey", "s_nationkey")
            df = df.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left")
        sources = {**_LINE, **_ORDER, **_PART, **_SUPPLIER}
        return df.select([F.col(r) if r in df.columns else sources[r]().alias(r) for r in wanted])

    def split(self, *roles: str) -> tuple[DataFrame, DataFrame]:
        """Tour and others receipts."""
        wanted = roles or ALL_ROLES
        both = self.receipts(*wanted, "is_tour")
        return both.where("is_tour").drop("is_tour"), both.where(~F.col("is_tour")).drop("is_tour")

    def official(self, *roles: str) -> DataFrame:
        """Receipts of both tables in the official scope.

        Orders leave before parts and suppliers are joined, by the key that the lines were brought together with their orders
        by: an order's number is made of its key, one to one.
        """
        from tallyspark.operators.scope import official_rows

        scoped = ("order_id", "receipt_type", "pay_method")
        wanted = dict.fromkeys((*(roles or ALL_ROLES), *scoped, "is_tour"))
        lines = self._lines(wanted).withColumns({r: {**_LINE, **_ORDER}[r]() for r in scoped})
        return self._described(official_rows(lines, key="l_orderkey"), wanted)


def money(name: str, out: str | None = None) -> Column:
    return F.round(F.col(name), 2).alias(out or name)


def rounded(df: DataFrame, places: int = 4, *names: str) -> DataFrame:
    """Round double columns at the sink."""
    doubles = names or [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.select([F.round(c, places).alias(c) if c in doubles else F.col(c) for c in df.columns])


def texted(df: DataFrame) -> DataFrame:
    """Dates as text, as every report shows them."""
    dates = {f.name for f in df.schema.fields if f.dataType.typeName() == "date"}
    return df.select([F.date_format(c, "yyyy-MM-dd").alias(c) if c in dates else F.col(c) for c in df.columns])
