"""The operators' queries and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from . import bpe, chat, decontaminate, katz, licenses, near_duplicates, negatives, periodic, private, quality, sharding, toxicity, url_rules

QUERIES = {
    "op1_risk_thresholds": quality.op1_risk_thresholds,
    "op2_url_rules": url_rules.op2_url_rules,
    "op3_hilbert_shards": sharding.op3_hilbert_shards,
    "op4_bpe_automaton": bpe.op4_bpe_automaton,
    "op5_parity_join": near_duplicates.op5_parity_join,
    "op6_prefix_join": decontaminate.op6_prefix_join,
    "op7_katz": katz.op7_katz,
    "op8_diagonal_voting": licenses.op8_diagonal_voting,
    "op9_nb_char_ngrams": toxicity.op9_nb_char_ngrams,
    "op10_prefix_target": chat.op10_prefix_target,
    "op11_weak_supervision": private.op11_weak_supervision,
    "op12_inverted_lists": negatives.op12_inverted_lists,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}
ORACLES = {
    "op2_url_rules": url_rules.OP2_SQL,
    "op6_prefix_join": decontaminate.OP6_SQL,
    "op10_prefix_target": chat.OP10_SQL,
    "op12_inverted_lists": negatives.OP12_SQL,
}
