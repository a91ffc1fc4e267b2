"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import bpe, chat_format, language_id, license_scan, lm_scoring, merkle_manifest, mil_classifier, near_dedup, periodic_runs, quality_rules, source_mix, token_records, topk_search


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_dedup": near_dedup.query,
        "op2_token_records": token_records.query,
        "op3_source_mix": source_mix.query,
        "op4_mil_classifier": mil_classifier.query,
        "op5_license_scan": license_scan.query,
        "op6_topk_search": topk_search.query,
        "op7_lm_scoring": lm_scoring.query,
        "op8_chat_format": chat_format.query,
        "op9_quality_rules": quality_rules.query,
        "op10_bpe": bpe.query,
        "op11_merkle_manifest": merkle_manifest.query,
        "op12_language_id": language_id.query,
        "op13_periodic_runs": periodic_runs.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_license_scan": license_scan.sql(), "op6_topk_search": topk_search.SQL, "op8_chat_format": chat_format.SQL, "op11_merkle_manifest": merkle_manifest.SQL, "op13_periodic_runs": periodic_runs.SQL}
