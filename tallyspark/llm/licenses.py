"""License scans by diagonal voting, in DataFrame expressions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import prepare

GRAM = 3
BAND = 12  # diagonals this close are one span: words left out or put in between
COVERAGE = 0.6  # share of a template's word triples that a span must have
STRETCH = 2.0  # longest span, as a multiple of its template

# The phrases of the contract with their labels, then the standard notices of common licenses.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this work is licensed under the gnu general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by", "this work is licensed under a creative commons attribution"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "no part of this publication may be reproduced in any form without permission"),
)
TEMPLATES = tuple((n, label, text, n < len(PHRASES)) for n, (label, text) in enumerate(PHRASES + NOTICES))

# two letters outside ASCII whose small form is or starts with an ASCII letter; they match no phrase either way
_ODD = (("K", "κ"), ("İ", "ı"))
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of digits, letters and anything outside ASCII, with A-Z lowered; none for a null text."""
    for letter, other in _ODD:
        text = F.replace(text, F.lit(letter), F.lit(other))
    return F.coalesce(F.array_remove(F.split(F.lower(text), _GAPS), ""), F.array().cast("array<string>"))


def template_grams(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """``(gram, template, label, base, t_pos, t_grams)``: every position of every template."""
    rows = []
    for n, label, text, base in templates:
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        rows += [(" ".join(ws[i : i + GRAM]), n, label, base, i, len(ws) - GRAM + 1) for i in range(len(ws) - GRAM + 1)]
    return spark.createDataFrame(rows, "gram string, template int, label string, base boolean, t_pos int, t_grams int")


def _hash(grams: Column) -> Column:
    parts = F.split(grams, " ")
    return F.xxhash64(*[F.get(parts, F.lit(i)) for i in range(GRAM)])


def best_window(votes: Column, longest: Column) -> Column:
    """Most template positions that the votes ``(diagonal, seen)`` have in a window of at most ``longest`` words.

    Votes are taken up by position; those that the window has left behind are dropped, so a step costs one window.
    """
    at = lambda v: F.transform(v["seen"], lambda t: F.struct((v["diagonal"] + t).alias("pos"), t.alias("t")))
    placed = F.array_sort(F.flatten(F.transform(votes, at)))

    def step(state: Column, vote: Column) -> Column:
        window = F.concat(F.filter(state["window"], lambda x: vote["pos"] - x["pos"] + GRAM <= longest), F.array(vote))
        return F.struct(window.alias("window"), F.greatest(state["best"], F.size(F.array_distinct(window["t"]))).alias("best"))

    start = F.struct(F.array().cast("array<struct<pos:int,t:int>>").alias("window"), F.lit(0).alias("best"))
    return F.aggregate(placed, start, step, lambda state: state["best"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """Spans found in each row, with a row number, the id and the word count; a row without spans stays, without template.

    The hashes of all rolling triples are held against those of the templates (a fixed set); the triples that remain are
    joined to the template positions and verified word by word. Votes are counted by document, template and diagonal
    (position in the text less position in the template); neighbouring diagonals merge into one span, which must cover
    enough of the template and not be stretched too far. A longer chain without an exact place, such as an altered notice
    line after line, is judged by its best window of the longest allowed length. A diagonal that has all triples is an exact
    place.
    """
    spark = prepare(docs.sparkSession)
    grams = template_grams(spark, templates)
    keyed = grams.withColumn("h", _hash(F.col("gram")))
    known = sorted({r["h"] for r in keyed.select("h").collect()})
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), words(F.col(f"`{text_col}`")).alias("w"))

    def hit(i: Column) -> Column:
        return F.xxhash64(*[F.get("w", i + j) for j in range(GRAM)]).isin(known)

    n = F.size("w")
    places = F.when(n >= GRAM, F.filter(F.sequence(F.lit(0), n - GRAM), hit)).otherwise(F.array().cast("array<int>"))
    found = base.select("row", "doc_id", n.cast("long").alias("n_words"), "w", places.alias("at"))
    triples = F.transform("at", lambda i: F.struct(i.alias("pos"), F.array_join(F.slice("w", i + 1, F.lit(GRAM)), " ").alias("gram")))
    hits = found.select("row", "doc_id", "n_words", F.explode_outer(triples).alias("x")).select("row", "doc_id", "n_words", "x.pos", "x.gram")
    # the templates are a fixed list
    voted = hits.withColumn("h", _hash(F.col("gram"))).join(F.broadcast(keyed.withColumnRenamed("gram", "t_gram")), "h", "left")
    same = F.col("gram") == F.col("t_gram")
    voted = voted.select("row", "doc_id", "n_words", *[F.when(same, F.col(c)).alias(c) for c in ("template", "label", "base", "t_pos", "t_grams", "pos")])
    voted = voted.repartition("row").withColumn("diagonal", F.col("pos") - F.col("t_pos"))
    diagonals = voted.groupBy("row", "doc_id", "n_words", "template", "label", "base", "t_grams", "diagonal").agg(
        F.collect_set("t_pos").alias("seen"), F.min("pos").alias("first"), F.max("pos").alias("last")
    )
    near = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(near) > BAND, F.lit(True)).cast("int")
    spans = diagonals.withColumn("cluster", F.sum(apart).over(near)).groupBy(
        "row", "doc_id", "n_words", "template", "label", "base", "t_grams", "cluster"
    ).agg(
        F.sort_array(F.collect_list(F.when(F.size("seen") == F.col("t_grams"), F.col("diagonal").cast("long")))).alias("exact"),
        (F.size(F.array_distinct(F.flatten(F.collect_list("seen")))) / F.col("t_grams")).alias("coverage"),
        (F.max("last") - F.min("first") + GRAM).alias("length"),
        F.min("first").alias("first_word"),
        F.collect_list(F.struct("diagonal", "seen")).alias("votes"),
    )
    longest = STRETCH * (F.col("t_grams") + GRAM - 1)
    loose = (F.col("length") > longest) & (F.size("exact") == 0) & (F.col("coverage") >= COVERAGE) & ~F.col("base")
    spans = spans.withColumn("coverage", F.when(loose, best_window(F.col("votes"), longest) / F.col("t_grams")).otherwise(F.col("coverage"))).drop("votes")
    fits = (F.col("coverage") >= COVERAGE) & (loose | (F.col("length") <= longest)) & ~F.col("base")
    return spans.withColumn("accepted", F.coalesce(fits | (F.size("exact") > 0), F.lit(False)))


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)`` for every row.

    ``score`` is the best coverage of an accepted span, 1 for an exact place and 0 without any. Null and empty texts have
    no words; ids may be null or repeat (every row keeps its own result); an empty table gives no rows; other columns are
    not read.
    """
    spans = scan(docs, id_col, text_col)
    exact = F.when(F.col("base"), F.col("exact"))
    rows = spans.groupBy("row", "doc_id", "n_words").agg(
        F.coalesce(F.sum(F.size(exact)), F.lit(0)).cast("long").alias("n_base"),
        F.min(F.get(exact, F.lit(0))).alias("first_word"),
        F.max(F.element_at(F.when(F.size(exact) > 0, exact), -1)).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.size(exact) > 0, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("accepted"), F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(F.col("accepted"), F.least(F.col("coverage"), F.lit(1.0)))), F.lit(0.0)).alias("score"),
    )
    return rows.drop("row")


def license_query(spark: SparkSession, folder: str) -> DataFrame:
    return licenses(spark.read.parquet(f"{folder}/documents.parquet"))


def _oracle() -> str:
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for n, label, text, base in TEMPLATES:
        ws = text.split(" ")
        rows += [f"('{' '.join(ws[i:i + GRAM])}',{n},'{label}',{base},{i},{len(ws) - GRAM + 1})" for i in range(len(ws) - GRAM + 1)]
    return f"""
WITH grams(gram, template, label, base, t_pos, t_grams) AS (VALUES {",".join(rows)}),
w AS (SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), '{letters.upper()}', '{letters}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
      FROM documents),
p AS (SELECT r, ws, unnest(range(0, len(ws) - {GRAM - 1})) AS pos FROM w),
v AS (SELECT r, template, label, base, t_pos, t_grams, pos, pos - t_pos AS diagonal
      FROM (SELECT r, pos, array_to_string(ws[pos + 1:pos + {GRAM}], ' ') AS gram FROM p) JOIN grams USING (gram)),
d AS (SELECT r, template, label, base, t_grams, diagonal, list(DISTINCT t_pos) AS seen, min(pos) AS a, max(pos) AS b
      FROM v GROUP BY r, template, label, base, t_grams, diagonal),
c AS (SELECT *, sum(apart) OVER (PARTITION BY r, template ORDER BY diagonal) AS cluster
      FROM (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) <= {BAND} THEN 0 ELSE 1 END AS apart FROM d)),
s AS (SELECT r, template, label, base, t_grams, cluster, {STRETCH} * (t_grams + {GRAM - 1}) AS longest,
        count(*) FILTER (WHERE len(seen) = t_grams) AS n,
        min(diagonal) FILTER (WHERE len(seen) = t_grams) AS lo, max(diagonal) FILTER (WHERE len(seen) = t_grams) AS hi,
        len(list_distinct(flatten(list(seen)))) / t_grams AS whole, max(b) - min(a) + {GRAM} AS length
      FROM c GROUP BY r, template, label, base, t_grams, cluster),
l AS (SELECT *, NOT base AND n = 0 AND whole >= {COVERAGE} AND length > longest AS loose FROM s),
z AS (SELECT l.r, l.template, l.cluster, l.longest, l.t_grams, v.pos, v.t_pos FROM l JOIN c USING (r, template, cluster)
      JOIN v ON v.r = c.r AND v.template = c.template AND v.diagonal = c.diagonal WHERE loose),
o AS (SELECT r, template, cluster, max(m) / any_value(t_grams) AS best
      FROM (SELECT x.r, x.template, x.cluster, x.pos, any_value(x.t_grams) AS t_grams, count(DISTINCT y.t_pos) AS m
            FROM z x JOIN z y ON x.r = y.r AND x.template = y.template AND x.cluster = y.cluster AND y.pos BETWEEN x.pos + {GRAM} - x.longest AND x.pos
            GROUP BY x.r, x.template, x.cluster, x.pos)
      GROUP BY r, template, cluster),
k AS (SELECT l.*, coalesce(best, whole) AS coverage,
        n > 0 OR (NOT base AND coalesce(best, whole) >= {COVERAGE} AND (loose OR length <= longest)) AS accepted
      FROM l LEFT JOIN o USING (r, template, cluster))
SELECT w.doc_id, CAST(any_value(len(w.ws)) AS BIGINT) AS n_words,
  CAST(coalesce(sum(n) FILTER (WHERE base), 0) AS BIGINT) AS n_base,
  CAST(min(lo) FILTER (WHERE base) AS BIGINT) AS first_word, CAST(max(hi) FILTER (WHERE base) AS BIGINT) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base AND n > 0), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE accepted), '') AS labels,
  CAST(coalesce(max(least(coverage, 1.0)) FILTER (WHERE accepted), 0) AS DOUBLE) AS score
FROM w LEFT JOIN k ON w.r = k.r GROUP BY w.r, w.doc_id"""


LICENSE_SQL = _oracle()
