"""Registered queries of the training-data operators, and their SQL where it can express them."""

from __future__ import annotations

from plumbline.llm import byte_pairs, decontamination, lm_scoring, merkle, periodic_runs, pieces, quality, sharding, simhash, suffix_array, token_counts, toxicity, url_filter
from plumbline.llm.common import drop_written  # noqa: F401

QUERIES = {
    "op1_suffix_array": suffix_array.op1_suffix_array,
    "op2_simhash": simhash.op2_simhash,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_lm_scoring": lm_scoring.op6_lm_scoring,
    "op7_sharding": sharding.op7_sharding,
    "op8_url_filters": url_filter.op8_url_filters,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_merkle": merkle.op11_merkle,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_byte_pairs": byte_pairs.op13_byte_pairs,
}

ORACLE_SQL = {
    "op4_decontamination": decontamination.OP4_SQL,
    "op8_url_filters": url_filter.OP8_SQL,
    "op10_quality_rules": quality.OP10_SQL,
}
