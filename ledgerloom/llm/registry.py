"""The corpus queries and their DuckDB equivalents."""

from __future__ import annotations

import corpus_pipeline

from . import conversation_repair, exact_dedup, fingerprints, html_extract, license_scan, line_dedup, ngram_join, packing, prefix_trie, sampled_pieces, token_counts, toxicity, url_filters


def queries() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_url_filters": url_filters.op2_url_filters,
        "op3_packing": packing.op3_packing,
        "op4_license_scans": license_scan.op4_license_scans,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_ngram_jaccard_join": ngram_join.op6_ngram_jaccard_join,
        "op7_html_extraction": html_extract.op7_html_extraction,
        "op8_token_counts": token_counts.op8_token_counts,
        "op9_sampled_pieces": sampled_pieces.op9_sampled_pieces,
        "op10_document_fingerprints": fingerprints.op10_document_fingerprints,
        "op11_prefix_trie": prefix_trie.op11_prefix_trie,
        "op12_line_dedup": line_dedup.op12_line_dedup,
        "op13_conversation_repair": conversation_repair.op13_conversation_repair,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.SQL,
        "op2_url_filters": url_filters.SQL,
        "op4_license_scans": license_scan.SQL,
        "op11_prefix_trie": prefix_trie.SQL,
        "op12_line_dedup": line_dedup.SQL,
    }
