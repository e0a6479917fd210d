"""Text cleaning expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE_SPACE = "\u3000"
HARD_SPACE = "\xa0"
# every character a sheet may pad a cell with
BLANKS = " \t\n\r\x0b\x0c\xa0\u3000"
# Cleaned ids that mean "no id".
VOID_IDS = ("", "NAN", "NONE")
VOID_CANDIDATES = ("", "NAN", "NONE", "NULL")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def clean_document_number(c: Column, parity: bool = False) -> Column:
    """Drop a trailing ``.0`` and hard spaces, trim, upper-case. ``parity`` spells null as ``NAN``."""
    cleaned = F.upper(strip(F.replace(F.regexp_replace(c.cast("string"), r"\.0$", ""), F.lit(HARD_SPACE), F.lit(""))))
    return F.coalesce(cleaned, F.lit("NAN")) if parity else cleaned


def is_valid_id(cleaned: Column) -> Column:
    return cleaned.isNotNull() & ~cleaned.isin(*VOID_IDS)


def blank_coalesce(first: Column, second: Column, null_blocks: bool = False) -> Column:
    """``second`` where ``first`` is blank text; a null ``first`` is blank unless ``null_blocks``."""
    text = strip(first.cast("string"))
    blank = text == ""
    if not null_blocks:
        blank = blank | first.isNull()
    return F.when(F.coalesce(blank, F.lit(False)), second).otherwise(first)


def plain_spaces(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(WIDE_SPACE), F.lit(" ")), F.lit(HARD_SPACE), F.lit(" "))


def branch_text(c: Column) -> Column:
    return strip(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit(WIDE_SPACE), F.lit(" ")))


def identity_text(c: Column) -> Column:
    return F.upper(strip(plain_spaces(F.coalesce(c.cast("string"), F.lit("")))))


def safe_text(c: Column) -> Column:
    return strip(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit(WIDE_SPACE), F.lit(" ")))


def match_key(c: Column) -> Column:
    """Upper-cased letters, digits and CJK ideographs only."""
    return F.regexp_replace(F.upper(plain_spaces(F.coalesce(c.cast("string"), F.lit("")))), "[^A-Z0-9一-鿿]+", "")


def leading_code(c: Column) -> Column:
    return F.regexp_extract(match_key(c), "^[A-Z0-9]+", 0)


def candidate_text(c: Column) -> Column:
    text = strip(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit(WIDE_SPACE), F.lit(" ")))
    return F.when(F.upper(text).isin(*VOID_CANDIDATES), F.lit("")).otherwise(text)


def id_prefix(c: Column, length: int = 2) -> Column:
    compact = F.regexp_replace(F.upper(candidate_text(c)), r"[^\p{L}\p{N}]", "")
    return F.when(F.length(compact) < length, F.lit("")).otherwise(F.substring(compact, 1, length))


def suggestion_id(rule_type: Column, candidate: Column) -> Column:
    return F.concat(rule_type, F.lit("-"), F.substring(F.sha1(F.concat(rule_type, F.lit("|"), candidate)), 1, 10))


def _nfkc_udf():
    # a closure, so that executors need nothing but the standard library
    @F.arrow_udf("string")
    def normalize(values: pa.Array) -> pa.Array:
        import unicodedata

        return pa.array([None if v is None else unicodedata.normalize("NFKC", v).strip() for v in values.to_pylist()], pa.string())

    return normalize


def nfkc(column: Column) -> Column:
    """NFKC form of a text, trimmed; null is empty. ASCII texts are empty rows to Python, which sees the others in place."""
    text = F.coalesce(column.cast("string"), F.lit(""))
    wide = text.rlike(r"[^\x00-\x7F]")
    return F.when(wide, _nfkc_udf()(F.when(wide, text))).otherwise(F.trim(text))
