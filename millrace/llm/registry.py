"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from millrace.llm import bpe, lm, packing, quality, rules, search, sharding, simhash, tokens, urls


def queries() -> dict:
    return {
        "op1_bpe_round_trip": bpe.op1_bpe_round_trip,
        "op2_quality_rules": rules.op2_quality_rules,
        "op3_token_counts": tokens.op3_token_counts,
        "op4_url_filter": urls.op4_url_filter,
        "op5_quality_classifier": quality.op5_quality_classifier,
        "op6_context_tree_scores": lm.op6_context_tree_scores,
        "op7_simhash_components": simhash.op7_simhash_components,
        "op8_pattern_packing": packing.op8_pattern_packing,
        "op9_kd_sharding": sharding.op9_kd_sharding,
        "op10_exact_top_k": search.op10_exact_top_k,
    }


def oracle_sql() -> dict[str, str]:
    return dict(search.ORACLES)
