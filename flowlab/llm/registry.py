"""Queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from flowlab.llm import (conversation_trie, crf_quality, decontaminate, host_suffix_extract, license_scan, mixing, oracle, pii,
                         pivot_topk, simhash_dedup, substring_dedup, url_filter, weak_toxicity, whitening)

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_crf_quality": crf_quality.op2_crf_quality,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_mixing": mixing.op4_mixing,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_host_suffix_extract": host_suffix_extract.op6_host_suffix_extract,
    "op7_weak_toxicity": weak_toxicity.op7_weak_toxicity,
    "op8_simhash_dedup": simhash_dedup.op8_simhash_dedup,
    "op9_pii": pii.op9_pii,
    "op10_pivot_topk": pivot_topk.op10_pivot_topk,
    "op11_whitening": whitening.op11_whitening,
    "op12_conversation_trie": conversation_trie.op12_conversation_trie,
    "op13_substring_dedup": substring_dedup.op13_substring_dedup,
}
ORACLE = dict(oracle.ORACLE)
