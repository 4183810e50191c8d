"""The dealt operators as queries over the given tables, and their SQL twins where SQL can express them."""

from __future__ import annotations

from . import (
    ann, chat, hard_negatives, language_id, mixing, packing, quality_crf, quality_rules, simhash, suffix_tree, token_counts, toxicity, whitening,
)

QUERIES = {
    "op4_quality_classifier": quality_crf.op4_quality_classifier,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_simhash": simhash.op2_simhash,
    "op3_token_counts": token_counts.op3_token_counts,
    "op8_lm_scoring": suffix_tree.op8_lm_scoring,
    "op6_chat_formatting": chat.op6_chat_formatting,
    "op7_nearest_neighbours": ann.op7_nearest_neighbours,
    "op9_mixing": mixing.op9_mixing,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_whitening": whitening.op11_whitening,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_language_id": language_id.op13_language_id,
}

ORACLES = {
    "op5_quality_rules": quality_rules.OP5_SQL,
    "op6_chat_formatting": chat.OP6_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
}
