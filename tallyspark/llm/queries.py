"""The corpus queries and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm.bytebpe import bytebpe_query
from tallyspark.llm.decontamination import decontamination_query
from tallyspark.llm.divergence import DIVERGENCE_SQL, divergence_query
from tallyspark.llm.licenses import LICENSE_SQL, license_query
from tallyspark.llm.packing import packing_query
from tallyspark.llm.pii import pii_query
from tallyspark.llm.quality import quality_query
from tallyspark.llm.simhash import simhash_query
from tallyspark.llm.sketches import fingerprint_query
from tallyspark.llm.substrings import SUBSTRING_SQL, substring_query
from tallyspark.llm.suffixes import SUFFIX_SQL, suffix_query
from tallyspark.llm.toxicity import toxicity_query
from tallyspark.llm.vectorcodes import VECTORCODE_SQL, vectorcode_query

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": fingerprint_query,
    "op2_suffixes": suffix_query,
    "op3_simhash": simhash_query,
    "op4_substrings": substring_query,
    "op5_toxicity": toxicity_query,
    "op6_packing": packing_query,
    "op7_decontamination": decontamination_query,
    "op8_pii": pii_query,
    "op9_quality": quality_query,
    "op10_licenses": license_query,
    "op11_bytebpe": bytebpe_query,
    "op12_vectorcodes": vectorcode_query,
    "op13_divergence": divergence_query,
}
ORACLES: dict[str, str] = {
    "op2_suffixes": SUFFIX_SQL,
    "op4_substrings": SUBSTRING_SQL,
    "op10_licenses": LICENSE_SQL,
    "op12_vectorcodes": VECTORCODE_SQL,
    "op13_divergence": DIVERGENCE_SQL,
}
