"""Queries and SQL of the corpus operators."""

from __future__ import annotations

from matchloom.llm import op1_jaccard_join, op2_licenses, op3_secrets, op4_line_dedup, op5_html_text, op6_language, op7_substring_dedup, op8_decontaminate, op9_byte_bpe, op10_exact_dedup, op11_token_files, op12_prefix_trie, op13_source_divergence


def queries():
    return {
        "op1_jaccard_join": op1_jaccard_join.query,
        "op2_licenses": op2_licenses.query,
        "op3_secrets": op3_secrets.query,
        "op4_line_dedup": op4_line_dedup.query,
        "op5_html_text": op5_html_text.query,
        "op6_language": op6_language.query,
        "op7_substring_dedup": op7_substring_dedup.query,
        "op8_decontaminate": op8_decontaminate.query,
        "op9_byte_bpe": op9_byte_bpe.query,
        "op10_exact_dedup": op10_exact_dedup.query,
        "op11_token_files": op11_token_files.query,
        "op12_prefix_trie": op12_prefix_trie.query,
        "op13_source_divergence": op13_source_divergence.query,
    }


def oracle_sql():
    return {
        "op1_jaccard_join": op1_jaccard_join.SQL,
        "op2_licenses": op2_licenses.SQL,
        "op4_line_dedup": op4_line_dedup.SQL,
        "op7_substring_dedup": op7_substring_dedup.SQL,
        "op8_decontaminate": op8_decontaminate.SQL,
        "op10_exact_dedup": op10_exact_dedup.SQL,
        "op12_prefix_trie": op12_prefix_trie.SQL,
        "op13_source_divergence": op13_source_divergence.SQL,
    }
