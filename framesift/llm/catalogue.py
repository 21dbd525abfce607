"""Queries of the training-data operators and the DuckDB statements to compare them with."""

from __future__ import annotations

import corpus_pipeline
from framesift.llm import content_sort, context_tree, licences, mixing, near_join, neighbours, packing, periodic_runs, preference, prefix_trie, privacy, quality, toxicity

QUERIES = {
    "op1_nearest_neighbours": neighbours.op1,
    "op2_sanitise_pii": privacy.op2,
    "op3_quality_rules": quality.op3,
    "op4_toxicity": toxicity.op4,
    "op5_license_scan": licences.op5,
    "op6_preference_format": preference.op6,
    "op7_mix_sources": mixing.op7,
    "op8_best_fit_packing": packing.op8,
    "op9_context_tree_score": context_tree.op9,
    "op10_ngram_jaccard_join": near_join.op10,
    "op11_exact_dedup": content_sort.op11,
    "op12_prefix_trie": prefix_trie.op12,
    "op13_periodic_runs": periodic_runs.op13,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op6_preference_format": preference.ORACLE,
    "op7_mix_sources": mixing.ORACLE,
    "op10_ngram_jaccard_join": near_join.ORACLE,
    "op11_exact_dedup": content_sort.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
    "op13_periodic_runs": periodic_runs.ORACLE,
}
