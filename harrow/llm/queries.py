"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from . import chat, decontaminate, language_model, licenses, mixing, negatives, pii, quality_model, quality_rules, simhash, substrings, tokens, trie

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_find_pii": pii.op2_find_pii,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_format_chat": chat.op4_format_chat,
    "op5_simhash_near_dedup": simhash.op5_simhash_near_dedup,
    "op6_lm_scoring": language_model.op6_lm_scoring,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_quality_classifier": quality_model.op8_quality_classifier,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_remove_repeats": substrings.op10_remove_repeats,
    "op11_count_tokens": tokens.op11_count_tokens,
    "op12_prefix_trie": trie.op12_prefix_trie,
    "op13_hard_negatives": negatives.op13_hard_negatives,
}
ORACLE_SQL = {
    "op3_decontaminate": decontaminate.SQL,
    "op4_format_chat": chat.SQL,
    "op7_mix_sources": mixing.SQL,
    "op10_remove_repeats": substrings.SQL,
    "op12_prefix_trie": trie.SQL,
    "op13_hard_negatives": negatives.SQL,
}
