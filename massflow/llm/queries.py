"""The queries of this package's operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from massflow.llm import language, licenses, media, mixing, pieces, quality_model, quality_rules, simhash, token_counts, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixing": mixing.query,
    "op2_language_id": language.query,
    "op3_quality_classifier": quality_model.query,
    "op4_token_counts": token_counts.query,
    "op5_license_scans": licenses.query,
    "op6_quality_rules": quality_rules.query,
    "op7_simhash_near_dedup": simhash.query,
    "op8_warc": warc.query,
    "op9_media_columns": media.query,
    "op10_sentencepiece": pieces.query,
}

SQL: dict[str, str] = {
    "op1_source_mixing": mixing.SQL,
    "op5_license_scans": licenses.SQL,
    "op6_quality_rules": quality_rules.SQL,
    "op8_warc": warc.SQL,
}
