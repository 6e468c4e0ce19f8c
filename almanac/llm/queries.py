"""The registered queries of this package and their SQL."""

from __future__ import annotations

from . import conversation_repair, cuckoo_dedup, embedding_dedup, language_id, lm_scoring, mixing, packing, quality, simhash_dedup, source_divergence, suffix_dedup, token_counts, toxicity

QUERIES = {
    "op1_embedding_near_dedup": embedding_dedup.op1_embedding_near_dedup,
    "op2_suffix_array_dedup": suffix_dedup.op2_suffix_array_dedup,
    "op3_language_id": language_id.op3_language_id,
    "op4_source_mixing": mixing.op4_source_mixing,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_lm_scoring": lm_scoring.op6_lm_scoring,
    "op7_simhash_near_dedup": simhash_dedup.op7_simhash_near_dedup,
    "op8_exact_dedup": cuckoo_dedup.op8_exact_dedup,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_source_divergence": source_divergence.op11_source_divergence,
    "op12_quality": quality.op12_quality,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}

ORACLE_SQL = {
    "op8_exact_dedup": cuckoo_dedup.ORACLE,
    "op11_source_divergence": source_divergence.ORACLE,
    "op12_quality": quality.op12_quality,
    "op13_conversation_repair": conversation_repair.ORACLE,
}
