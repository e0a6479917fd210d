"""Closest listed text of each value, by a join over shared characters instead of every pair."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Room for rounding where bounds are taken in doubles; bounds only let pairs through, the ratio itself decides.
SLACK = 1e-9


def tokens(text: Column) -> Column:
    """Characters of a text, each with the number of times it has come up: equal multisets have equal tokens."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x == c)).cast("string")))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(listed: pd.Series, value: pd.Series) -> pd.Series:
    """Share of characters in matching blocks, the longest block first, then left and right of it."""
    import difflib

    return pd.Series([difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(listed, value)], dtype="float64")


def _rare_first(texts: DataFrame, frequency: DataFrame) -> DataFrame:
    """``(text, n, all)``: the tokens of each text, those that fewer listed texts have first."""
    each = texts.select("text", F.explode(tokens(F.col("text"))).alias("token")).join(frequency, "token", "left")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("listed", F.lit(0)).alias("listed"), "token")))
    return each.groupBy("text").agg(order.alias("order")).select("text", F.size("order").alias("n"), F.col("order.token").alias("all"))


def closest(values: DataFrame, listed: DataFrame, cutoff: float) -> DataFrame:
    """``(text, close, ratio)`` for each different ``values(text)`` with a listed text at ``cutoff`` or above; of equal ratios
    the greatest text. Null and empty texts are close to nothing.

    The ratio is twice the matched characters over the length of both, and no more can match than both texts have in
    common as multisets. So alike texts share a token among the rarest of each (in one order for all), their lengths are
    near each other, and their multisets overlap enough; only pairs that pass all three reach the ratio, and none is lost.
    """
    if not 0 < cutoff <= 1:
        raise ValueError("the cutoff must be above 0 and at most 1")
    words, names = (df.select("text").where(F.col("text") != "").distinct() for df in (values, listed))
    frequency = names.select(F.explode(tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("listed"))
    least = F.ceil(F.col("n") * (cutoff / (2 - cutoff)) - SLACK).cast("int")
    first = F.explode(F.slice("all", F.lit(1), F.col("n") - least + 1)).alias("token")
    left, right = (
        _rare_first(df, frequency).select(first, *[F.col(c).alias(f"{c}_{x}") for c in ("text", "n", "all")]) for x, df in (("a", names), ("b", words))
    )
    both = F.col("n_a") + F.col("n_b")
    near = 2 * F.least("n_a", "n_b") >= cutoff * both - SLACK
    pairs = left.join(right, "token").where(near).dropDuplicates(["text_a", "text_b"])
    pairs = pairs.where(2 * F.size(F.array_intersect("all_a", "all_b")) >= cutoff * both - SLACK)
    rated = pairs.select("text_a", "text_b", sequence_ratio("text_a", "text_b").alias("ratio")).where(F.col("ratio") >= cutoff)
    best = rated.groupBy(F.col("text_b").alias("text")).agg(F.max(F.struct("ratio", F.col("text_a").alias("close"))).alias("best"))
    return best.select("text", "best.close", "best.ratio")
