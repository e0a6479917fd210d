"""Side-by-side comparison of a check query with its SQL."""

from __future__ import annotations

import datetime as dt
import math
import os

import duckdb


def connect(folder: str):
    db = duckdb.connect()
    for name in sorted(os.listdir(folder)):
        if name.endswith(".parquet"):
            db.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{folder}/{name}'")
    return db


def _cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if isinstance(v, (dt.datetime, dt.date)):
        return str(v)
    if hasattr(v, "as_tuple"):
        return round(float(v), 6) + 0.0
    return v


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=lambda r: tuple((x is not None, str(type(x)), x if x is not None else 0) for x in r))


def spark_result(df):
    return canonical(df.columns, [tuple(r) for r in df.collect()])


def sql_result(db, sql):
    cursor = db.execute(sql)
    return canonical([d[0] for d in cursor.description], cursor.fetchall()), [str(d[1]) for d in cursor.description]


def difference(db, df, sql) -> str:
    """Empty when equal, else a short account of the first difference."""
    names, rows = spark_result(df)
    (sql_names, sql_rows), types = sql_result(db, sql)
    if "HUGEINT" in types:
        return f"oracle returns HUGEINT: {types}"
    if names != sql_names:
        return f"columns differ: {names} vs {sql_names}"
    if len(rows) != len(sql_rows):
        return f"row counts differ: {len(rows)} vs {len(sql_rows)}; spark {rows[:2]} sql {sql_rows[:2]}"
    for a, b in zip(rows, sql_rows):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"first difference on {names}:\n  spark {a}\n  sql   {b}"
    if not rows:
        return "both empty"
    return ""
