"""Queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from alertloom.llm import (
    chat_format,
    exact_dedup,
    language_id,
    minhash_dedup,
    quality_crf,
    quality_rules,
    sentence_pieces,
    simhash_dedup,
    source_divergence,
    source_mix,
    spelling_variants,
    suffix_dedup,
    token_count,
)

LLM_QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_sentence_pieces": sentence_pieces.op2_sentence_pieces,
    "op3_chat_format": chat_format.op3_chat_format,
    "op4_quality_crf": quality_crf.op4_quality_crf,
    "op5_language_id": language_id.op5_language_id,
    "op6_source_mix": source_mix.op6_source_mix,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_minhash_dedup": minhash_dedup.op9_minhash_dedup,
    "op10_token_count": token_count.op10_token_count,
    "op11_spelling_variants": spelling_variants.op11_spelling_variants,
    "op12_simhash_dedup": simhash_dedup.op12_simhash_dedup,
    "op13_source_divergence": source_divergence.op13_source_divergence,
}

LLM_ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op3_chat_format": chat_format.ORACLE,
    "op8_quality_rules": quality_rules.ORACLE,
    "op13_source_divergence": source_divergence.ORACLE,
}
