"""Queries of the corpus operators, and SQL where it can express them."""

from __future__ import annotations

from marquee.llm import conversations, decontamination, exact_dedup, language_id, lm, mixing, negatives, ngram_join, pii, quality, repeats, toxicity, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_pii": pii.op4_pii,
    "op5_quality": quality.op5_quality,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_mixing": mixing.op7_mixing,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_language_id": language_id.op9_language_id,
    "op10_lm_scoring": lm.op10_lm_scoring,
    "op11_suffix_dedup": repeats.op11_suffix_dedup,
    "op12_conversations": conversations.op12_conversations,
    "op13_hard_negatives": negatives.op13_hard_negatives,
}

ORACLES = {
    "op1_warc": warc.ORACLE_SQL,
    "op2_ngram_join": ngram_join.ORACLE_SQL,
    "op3_exact_dedup": exact_dedup.ORACLE_SQL,
    "op7_mixing": mixing.ORACLE_SQL,
    "op11_suffix_dedup": repeats.ORACLE_SQL,
    "op12_conversations": conversations.ORACLE_SQL,
    "op13_hard_negatives": negatives.ORACLE_SQL,
}
