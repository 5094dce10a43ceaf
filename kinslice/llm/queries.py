"""Queries of this subpackage, each over whole tables, and DuckDB SQL for those that have any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, html, lm_scoring, minhash, packing, quality, rules, substring, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": lm_scoring.op1_lm_scoring,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_html_extraction": html.op3_html_extraction,
    "op4_url_filters": urls.op4_url_filters,
    "op5_decontamination": decontam.op5_decontamination,
    "op6_substring_dedup": substring.op6_substring_dedup,
    "op7_bestfit_packing": packing.op7_bestfit_packing,
    "op8_minhash_dedup": minhash.op8_minhash_dedup,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_quality_rules": rules.op10_quality_rules,
}

ORACLES: dict[str, str] = {
    "op4_url_filters": urls.ORACLE,
    "op6_substring_dedup": substring.ORACLE,
    "op8_minhash_dedup": minhash.ORACLE,
    "op10_quality_rules": rules.ORACLE,
}
