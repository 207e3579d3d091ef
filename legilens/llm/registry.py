"""The queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from legilens.llm import (
    exact_dedup, fill_in_middle, minhash, mixing, pii, quality, sentencepiece, simhash, substring_dedup, suffix_dedup, topk, toxicity, vector_codes,
)

QUERIES = {
    "op1_quality_co_training": quality.op1_quality_co_training,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_sentencepiece": sentencepiece.op4_sentencepiece,
    "op5_pii_sanitise": pii.op5_pii_sanitise,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_simhash_near_dedup": simhash.op9_simhash_near_dedup,
    "op10_exact_top_k": topk.op10_exact_top_k,
    "op11_minhash_near_dedup": minhash.op11_minhash_near_dedup,
    "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

SQL = {
    "op2_mix_sources": mixing.SQL,
    "op3_exact_dedup": exact_dedup.SQL,
    "op10_exact_top_k": topk.SQL,
    "op11_minhash_near_dedup": minhash.SQL,
    "op12_fill_in_middle": fill_in_middle.SQL,
    "op13_vector_codes": vector_codes.SQL,
}
