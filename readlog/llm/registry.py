"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from readlog.llm import binary_packing, clustering, language_id, license_scan, mixing, near_dedup, oracle, packing, quality_model, quality_rules, search, substring_dedup, suffix_dedup, token_alignment


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": language_id.op1_language_id,
        "op2_search": search.op2_search,
        "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
        "op4_minhash": near_dedup.op4_minhash,
        "op5_mixing": mixing.op5_mixing,
        "op6_quality_model": quality_model.op6_quality_model,
        "op7_binary_packing": binary_packing.op7_binary_packing,
        "op8_quality_rules": quality_rules.op8_quality_rules,
        "op9_packing": packing.op9_packing,
        "op10_substring_dedup": substring_dedup.op10_substring_dedup,
        "op11_token_alignment": token_alignment.op11_token_alignment,
        "op12_centroid_clustering": clustering.op12_centroid_clustering,
        "op13_license_scan": license_scan.op13_license_scan,
    }


def oracle_sql() -> dict[str, str]:
    return oracle.SQL | {"op12_centroid_clustering": clustering.oracle(), "op13_license_scan": license_scan.oracle()}
