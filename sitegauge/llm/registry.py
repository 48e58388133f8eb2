"""Queries of the training-data operators and their comparison SQL."""

from __future__ import annotations

import corpus_pipeline
from sitegauge.llm import queries_ann, queries_chat, queries_collocations, queries_conversation_repair, queries_exact_dedup, queries_language_id, queries_line_dedup, queries_minhash, queries_packing, queries_pieces, queries_quality, queries_sharding, queries_token_counts

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_weighted_hash_tree": queries_sharding.op1_weighted_hash_tree,
    "op2_token_level_chat": queries_chat.op2_token_level_chat,
    "op3_probminhash_near_dedup": queries_minhash.op3_probminhash_near_dedup,
    "op4_subword_language_id": queries_language_id.op4_subword_language_id,
    "op5_transducer_token_counts": queries_token_counts.op5_transducer_token_counts,
    "op6_rule_ensemble_quality": queries_quality.op6_rule_ensemble_quality,
    "op7_unigram_viterbi_pieces": queries_pieces.op7_unigram_viterbi_pieces,
    "op8_best_fit_packing": queries_packing.op8_best_fit_packing,
    "op9_salted_exact_dedup": queries_exact_dedup.op9_salted_exact_dedup,
    "op10_balanced_posting_lists": queries_ann.op10_balanced_posting_lists,
    "op11_levelled_line_runs": queries_line_dedup.op11_levelled_line_runs,
    "op12_multikey_collocations": queries_collocations.op12_multikey_collocations,
    "op13_grammar_conversation_repair": queries_conversation_repair.op13_grammar_conversation_repair,
}

ORACLE = {
    "op1_weighted_hash_tree": queries_sharding.ORACLE,
    "op2_token_level_chat": queries_chat.ORACLE,
    "op9_salted_exact_dedup": queries_exact_dedup.ORACLE,
    "op11_levelled_line_runs": queries_line_dedup.ORACLE,
    "op12_multikey_collocations": queries_collocations.ORACLE,
    "op13_grammar_conversation_repair": queries_conversation_repair.ORACLE,
}
