"""Queries of this package by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, decontaminate, embedding_dedup, license_scan, lm_score, quality, simhash, substring_dedup, toxicity, url_filter

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_quality": quality.op3_quality,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_embedding_dedup": embedding_dedup.op5_embedding_dedup,
    "op6_simhash": simhash.op6_simhash,
    "op7_lm_score": lm_score.op7_lm_score,
    "op8_bpe": bpe.op8_bpe,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_url_filter": url_filter.op10_url_filter,
}
ORACLE = {
    "op1_substring_dedup": substring_dedup.SQL,
    "op2_license_scan": license_scan.SQL,
    "op5_embedding_dedup": embedding_dedup.SQL,
    "op9_decontaminate": decontaminate.SQL,
}
