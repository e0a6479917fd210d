"""Resolving receipts: branch by order prefix, product attributes by order, and the override steps."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.dates import time_of
from tallyspark.functions.keys import first_per_key
from tallyspark.functions.text import branch_text, match_key
from tallyspark.operators.filters import period_column, rule_period
from tallyspark.operators.similar import closest
from tallyspark.roles import UNKNOWN
from tallyspark.rules import BusinessRules
from tallyspark.session import cut_lineage

NAME_CUTOFF = 0.6
OPERATOR_CUTOFF = 0.82

# Wording of the change log.
BLANK_TEXT = "空白"
LOG_FUZZY = "✅ 自動模糊替換"
LOG_NO_MATCH = "⚠️ 無法匹配"
LOG_KEPT = "維持原值"
LOG_OPERATOR = "✅ 收款操作員命中專職名單，已改歸專職銷售組"
LOG_SUB_BRANCH = "✅ 副表銷售點與主表識別不一致，已改用副表銷售點"
LOG_REASSIGNED = "✅ 命中月份限定分社歸屬 override，已重派銷售點"


# --- prefixes -----------------------------------------------------------------------------------------------


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for pair in pairs.items() for v in pair])


def branch_by_prefix(order_id: Column, branch_map: dict[str, str], default: str | None = UNKNOWN) -> Column:
    """Branch of the longest mapped prefix: one map lookup per prefix length, no join."""
    table = _literal_map(branch_map)
    lengths = sorted({len(p) for p in branch_map}, reverse=True)
    hits = [F.try_element_at(table, F.substring(order_id, 1, n)) for n in lengths]
    return F.coalesce(*hits, F.lit(default))


def starts_with_any(c: Column, prefixes) -> Column:
    """Whether the text begins with one of the prefixes. The text is named once, however many prefixes there are."""
    return c.rlike(f"\\A{_any_of(prefixes)}")


def _any_of(prefixes) -> str:
    """Pattern of the literal texts; of none, one that fits nothing."""
    return f"(?:{'|'.join(map(re.escape, prefixes))})" if prefixes else "(?!)"


def keep_mapped_orders(df: DataFrame, rules: BusinessRules, column: str = "order_id") -> DataFrame:
    """Orders of mapped prefixes that no exclusion prefix covers; an empty exclusion list excludes nothing."""
    # one pattern for both: a filter is pushed down to the raw text, which is cleaned anew wherever the filter names it
    return df.where(F.col(column).rlike(f"\\A(?!{_any_of(rules.exclude_prefixes)}){_any_of(rules.branch_map)}"))


# --- product attributes -------------------------------------------------------------------------------------


def attach_secondary(
    main: DataFrame, secondary: DataFrame, order: list[Column], key: str = "order_id"
) -> DataFrame:
    """Left-join the first product row per order. ``is_matched`` tells whether there was one."""
    one = first_per_key(secondary, [key], order).withColumn("is_matched", F.lit(True))
    clash = [c for c in one.columns if c in main.columns and c != key]
    left = main
    for c in clash:
        left = left.withColumnRenamed(c, f"{c}_x")
        one = one.withColumnRenamed(c, f"{c}_y")
    # the product side is as large as the main one, so it is not multiplied by salts; a hot order on the main side
    # is split by the session's skew-join setting
    joined = left.join(one, key, "left")
    return joined.withColumn("is_matched", F.coalesce("is_matched", F.lit(False)))


# --- names --------------------------------------------------------------------------------------------------


def name_matches(df: DataFrame, column: str, standard: tuple[str, ...] | DataFrame, cutoff: float = NAME_CUTOFF) -> DataFrame:
    """Distinct raw names with their standard form, how it was found, and on how many rows they occur.

    ``standard`` may be a frame with a column ``text``, of any size. Unlisted names meet only those listed names with which
    they share rare characters.
    """
    listed = standard if isinstance(standard, DataFrame) else df.sparkSession.createDataFrame([(x,) for x in standard], "text string")
    counted = df.where(F.trim(F.col(column)) != "").groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    names = counted.withColumn("text", F.trim(F.col(column)))
    known = listed.select("text", F.lit(True).alias("_known")).distinct()
    found = names.join(known, "text", "left")
    near = closest(found.where(F.col("_known").isNull()), listed, cutoff).select("text", F.col("close").alias("_close"))
    return found.join(near, "text", "left").select(
        column,
        F.when(F.col("_known"), F.col("text")).otherwise(F.coalesce("_close", "text")).alias("standard_name"),
        F.when(F.col("_known"), F.lit("listed")).when(F.col("_close").isNotNull(), F.lit("fuzzy")).otherwise(F.lit("none")).alias("found_by"),
        "rows",
    )


def standardize_names(
    df: DataFrame, column: str, standard: tuple[str, ...], names: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Replace names by their standard form; the log has one row per changed or unmatched raw name.

    ``names`` may give the raw names from an earlier, cheaper frame, so that ``df`` is not computed twice. The different ones
    among them are written once, being read twice.
    """
    found = name_matches(df, column, standard)
    lookup = found if names is None else name_matches(cut_lineage(names.select(column).distinct()), column, standard)
    fixed = df.join(lookup.select(column, "standard_name"), column, "left")
    fixed = fixed.withColumn(column, F.coalesce("standard_name", F.col(column))).drop("standard_name")
    log = found.where(F.col("found_by") != "listed").select(
        F.lit(column).alias("field"),
        F.trim(F.col(column)).alias("original"),
        F.when(F.col("found_by") == "fuzzy", F.col("standard_name")).otherwise(F.lit(LOG_KEPT)).alias("corrected"),
        F.when(F.col("found_by") == "fuzzy", F.lit(LOG_FUZZY)).otherwise(F.lit(LOG_NO_MATCH)).alias("status"),
        "rows",
    )
    return fixed.select(*df.columns), log


def _key_of(text: str) -> str:
    flat = text.upper().replace("　", " ").replace("\xa0", " ")
    return re.sub("[^A-Z0-9一-鿿]+", "", flat)


def operator_matches(df: DataFrame, specialists: tuple[str, ...], column: str = "operator") -> DataFrame:
    """Distinct operators with the specialist they stand for, if any.

    Stages: same compact text, same leading code, one is a prefix of the other, closest text. The first three
    are expressions over literal maps; only leftovers are held against texts with which they share rare characters.
    """
    by_key = {_key_of(s): s for s in specialists if _key_of(s)}
    codes = ((re.match("[A-Z0-9]*", _key_of(s)).group(0), s) for s in specialists)
    by_code = {code: s for code, s in codes if code}
    # the key hangs on the count, so that what is asked of it below is not pushed under the aggregate and asked of every row
    names = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    names = names.select(column, match_key(F.when(F.col("_n") > 0, F.col(column))).alias("_key"))
    names = names.where(F.col("_key") != "")
    if not by_key and not by_code:
        return names.select(column, F.lit(None).cast("string").alias("specialist"), F.lit(None).cast("string").alias("stage"))
    key = F.col("_key")
    code = F.regexp_extract(key, "^[A-Z0-9]+", 0)
    none = F.lit(None).cast("string")
    same = F.try_element_at(_literal_map(by_key), key) if by_key else none
    coded = F.when(code != "", F.try_element_at(_literal_map(by_code), code)) if by_code else none
    prefix = none
    for rep_key, rep in reversed(by_key.items()):
        mutual = key.startswith(rep_key) | F.lit(rep_key).startswith(key)
        prefix = F.when(mutual, F.lit(rep)).otherwise(prefix)
    staged = names.withColumns({"_same": same, "_code": coded, "_prefix": prefix})
    candidates = [*by_key, *by_code]
    rep_of = {**by_code, **by_key}
    listed = df.sparkSession.createDataFrame([(x,) for x in candidates], "text string")
    left = staged.where(F.coalesce("_same", "_code", "_prefix").isNull()).select(key.alias("text"))
    near = closest(left, listed, OPERATOR_CUTOFF).select(F.col("text").alias("_key"), F.col("close").alias("_close"))
    staged = staged.join(near, "_key", "left")
    close = F.try_element_at(_literal_map(rep_of), F.col("_close"))
    return staged.select(
        column,
        F.coalesce("_same", "_code", "_prefix", close).alias("specialist"),
        F.when(F.col("_same").isNotNull(), F.lit("key"))
        .when(F.col("_code").isNotNull(), F.lit("code"))
        .when(F.col("_prefix").isNotNull(), F.lit("prefix"))
        .when(F.col("_close").isNotNull(), F.lit("fuzzy"))
        .alias("stage"),
    )


# --- overrides ----------------------------------------------------------------------------------------------


def _log_row(field: str, original: Column, corrected: Column, status: str) -> list[Column]:
    return [F.lit(field).alias("field"), original.alias("original"), corrected.alias("corrected"), F.lit(status).alias("status")]


def _shown(c: Column, default: str = BLANK_TEXT) -> Column:
    text = branch_text(c)
    return F.when(text == "", F.lit(default)).otherwise(text)


def override_by_operator(df: DataFrame, rules: BusinessRules, operators: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Receipts taken by a specialist go to the specialist desk under that specialist's name.

    ``operators`` may give the operator texts from an earlier, cheaper frame; the different ones among them are written once.
    """
    texts = df if operators is None else cut_lineage(operators.select("operator").distinct())
    matched = operator_matches(texts, rules.specialists).select("operator", "specialist")
    joined = df.join(matched.where(F.col("specialist").isNotNull()), "operator", "left")
    settled = (F.trim("branch") == rules.specialist_desk) & (F.trim("salesperson") == F.col("specialist"))
    changes = F.col("specialist").isNotNull() & ~F.coalesce(settled, F.lit(False))
    flagged = joined.withColumn("_changes", changes)
    log = flagged.where("_changes").select(
        *_log_row(
            "operator",
            F.concat_ws(" | ", "operator", _shown(F.col("branch")), _shown(F.col("salesperson"))),
            F.concat(F.lit(f"{rules.specialist_desk} / "), "specialist"),
            LOG_OPERATOR,
        )
    )
    fixed = flagged.withColumns(
        {
            "branch": F.when(F.col("_changes"), F.lit(rules.specialist_desk)).otherwise(F.col("branch")),
            "salesperson": F.when(F.col("_changes"), F.col("specialist")).otherwise(F.col("salesperson")),
        }
    )
    return fixed.select(*df.columns), log


def override_by_sub_branch(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A filled product-side branch wins over a different one from the order prefix."""
    if "sub_branch" not in df.columns:
        empty = df.limit(0).select(*_log_row("sub_branch", F.lit(""), F.lit(""), LOG_SUB_BRANCH))
        return df, empty
    sub, main = branch_text(F.col("sub_branch")), branch_text(F.col("branch"))
    differs = (sub != "") & (sub != main)
    log = df.where(differs).select(
        *_log_row(
            "sub_branch",
            F.concat_ws(" | ", _shown(F.col("order_id"), UNKNOWN), _shown(F.col("branch")), sub),
            sub,
            LOG_SUB_BRANCH,
        )
    )
    return df.withColumn("branch", F.when(differs, sub).otherwise(F.col("branch"))), log


def _clean_rule(rule: dict) -> dict[str, str]:
    fields = ("to_branch", "from_branch", "from_prefix", "source_order_id", "month", "year")
    out = {f: str(rule.get(f) or "").replace("　", " ").strip() for f in fields}
    out["from_prefix"] = out["from_prefix"].upper()
    out["source_order_id"] = out["source_order_id"].upper()
    return out


def _rule_hit(rule: dict[str, str], branch: Column, sub: Column, order_id: Column, period: Column) -> Column:
    hit = period
    if rule["from_branch"]:
        hit = hit & ((branch_text(branch) == rule["from_branch"]) | (branch_text(sub) == rule["from_branch"]))
    if rule["from_prefix"]:
        hit = hit & F.upper(branch_text(order_id)).startswith(rule["from_prefix"])
    if rule["source_order_id"]:
        hit = hit & (F.upper(branch_text(order_id)) == rule["source_order_id"])
    return F.coalesce(hit, F.lit(False))


def reassign_branches(df: DataFrame, overrides, date_column: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Apply the override rules in order; later rules see what earlier ones wrote.

    The rules are one literal array that is folded per row, so the expression does not grow with their number.
    """
    rules = [r for r in map(_clean_rule, overrides or []) if r["to_branch"]]
    if "sub_branch" not in df.columns:
        df = df.withColumn("sub_branch", F.lit(""))
    if not rules:
        return df, df.limit(0).select(*_log_row("branch", F.lit(""), F.lit(""), LOG_REASSIGNED))
    column = date_column or (period_column(df) if any(r["month"] or r["year"] for r in rules) else None)
    stamp = time_of(df, column) if column else F.lit(None).cast("timestamp_ntz")
    order_id = F.upper(branch_text(F.col("order_id"))) if "order_id" in df.columns else F.lit("")
    month = F.coalesce(F.date_format(stamp, "yyyy-MM"), F.lit("?"))
    year = F.coalesce(F.date_format(stamp, "yyyy"), F.lit("?"))
    listed = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in r.items()]) for r in rules])
    no_hits = F.array().cast("array<struct<old_branch:string,old_sub:string,to_branch:string>>")
    start = F.struct(F.col("branch").alias("branch"), F.col("sub_branch").alias("sub_branch"), no_hits.alias("hits"))

    def step(acc: Column, rule: Column) -> Column:
        old, old_sub = branch_text(acc["branch"]), branch_text(acc["sub_branch"])
        period = F.when(rule["month"] != "", month == rule["month"]).when(rule["year"] != "", year == rule["year"]).otherwise(F.lit(True))
        hit = (
            period
            & ((rule["from_branch"] == "") | (old == rule["from_branch"]) | (old_sub == rule["from_branch"]))
            & order_id.startswith(rule["from_prefix"])
            & ((rule["source_order_id"] == "") | (order_id == rule["source_order_id"]))
        )
        entry = F.struct(old.alias("old_branch"), old_sub.alias("old_sub"), rule["to_branch"].alias("to_branch"))
        done = F.struct(rule["to_branch"].alias("branch"), rule["to_branch"].alias("sub_branch"), F.concat(acc["hits"], F.array(entry)).alias("hits"))
        return F.when(hit, done).otherwise(acc)

    work = df.withColumn("_fold", F.aggregate(listed, start, step))
    # an outer explode, so that no filter on the folded value is pushed back into the scan
    hits = work.select("order_id", F.explode_outer("_fold.hits").alias("h")).where(F.col("h").isNotNull())
    log = hits.select(
        *_log_row(
            "branch",
            F.concat_ws(" | ", _shown(F.col("order_id"), UNKNOWN), _shown(F.col("h.old_branch")), _shown(F.col("h.old_sub"))),
            F.col("h.to_branch"),
            LOG_REASSIGNED,
        )
    )
    fixed = work.withColumns({"branch": F.col("_fold.branch"), "sub_branch": F.col("_fold.sub_branch")})
    return fixed.select(*df.columns), log


def reassignment_target(df: DataFrame, overrides, date_column: str) -> Column:
    """Target of the first rule that fits, null if none does (the rule for rows already stored)."""
    hits = []
    for rule in map(_clean_rule, overrides or []):
        if rule["to_branch"]:
            period = rule_period(df, date_column, rule["month"]) if rule["month"] else F.lit(True)
            if rule["year"]:
                period = period & rule_period(df, date_column, year=rule["year"])
            hit = _rule_hit(rule, F.col("branch"), F.col("sub_branch"), F.col("order_id"), period)
            hits.append(F.when(hit, F.lit(rule["to_branch"])))
    return F.coalesce(*hits) if hits else F.lit(None).cast("string")


def repair_stored_branches(df: DataFrame, rules: BusinessRules, date_column: str = "unified_date") -> DataFrame:
    """Stored rows with a product-side branch, put right: specialist desk, first fitting rule, else that branch.

    ``is_repaired`` marks the rows that changed.
    """
    matched = operator_matches(df, rules.specialists).select("operator", "specialist")
    work = df.join(matched.where(F.col("specialist").isNotNull()), "operator", "left")
    sub = branch_text(F.col("sub_branch"))
    target = reassignment_target(work, rules.overrides, date_column)
    wanted = F.when(F.col("specialist").isNotNull(), F.lit(rules.specialist_desk)).otherwise(F.coalesce(target, sub))
    seller = F.coalesce("specialist", branch_text(F.col("salesperson")))
    work = work.withColumns({"_wanted": wanted, "_seller": seller})
    wrong = (sub != "") & ((branch_text(F.col("branch")) != F.col("_wanted")) | (branch_text(F.col("salesperson")) != F.col("_seller")))
    work = work.withColumn("is_repaired", wrong)
    work = work.withColumns(
        {
            "branch": F.when(F.col("is_repaired"), F.col("_wanted")).otherwise(F.col("branch")),
            "salesperson": F.when(F.col("is_repaired") & F.col("specialist").isNotNull(), F.col("_seller")).otherwise(F.col("salesperson")),
        }
    )
    return work.select(*df.columns, "is_repaired")


def repair_stored_operators(df: DataFrame, rules: BusinessRules) -> tuple[DataFrame, DataFrame]:
    """The operator override over stored rows, with the number of rows it changed."""
    fixed, log = override_by_operator(df, rules)
    return fixed, log.agg(F.count(F.lit(1)).alias("updated"))
