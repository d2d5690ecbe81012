"""Queries of this package by name, and SQL for those that SQL can express."""

from watchfold.llm import (
    conversation_trie,
    exact_dedup,
    fuzzy_lines,
    id_files,
    kd_shards,
    language_id,
    near_dedup,
    packing,
    periodic_runs,
    segment_sampling,
    source_mixing,
    token_counts,
    topk_search,
)

QUERIES = {
    "op1_gumbel_topk": segment_sampling.op1_gumbel_topk,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_language_id": language_id.op3_language_id,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_jaccard_join": near_dedup.op6_jaccard_join,
    "op7_huffman_ids": id_files.op7_huffman_ids,
    "op8_fuzzy_lines": fuzzy_lines.op8_fuzzy_lines,
    "op9_kd_shards": kd_shards.op9_kd_shards,
    "op10_topk_search": topk_search.op10_topk_search,
    "op11_conversation_trie": conversation_trie.op11_conversation_trie,
    "op12_source_mixing": source_mixing.op12_source_mixing,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}
ORACLES = {**exact_dedup.SQL, **topk_search.SQL, **conversation_trie.SQL, **source_mixing.SQL}
