"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from textloom.llm import ann, decontaminate, filter_audit, line_dedup, mixing, ngram_join, pieces, quality, range_join, source_divergence, substring_dedup, url_filter, wrappers

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_range_join": range_join.query,
    "op3_substring_dedup": substring_dedup.query,
    "op4_url_filter": url_filter.query,
    "op5_sentencepiece": pieces.query,
    "op6_ngram_join": ngram_join.query,
    "op7_ann": ann.query,
    "op8_mixing": mixing.query,
    "op9_quality_classifier": quality.query,
    "op10_html_extraction": wrappers.query,
    "op11_filter_audit": filter_audit.query,
    "op12_decontamination": decontaminate.query,
    "op13_source_divergence": source_divergence.query,
}

ORACLES = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op2_range_join": range_join.ORACLE,
    "op8_mixing": mixing.oracle(),
    "op11_filter_audit": filter_audit.ORACLE,
    "op12_decontamination": decontaminate.ORACLE,
    "op13_source_divergence": source_divergence.ORACLE,
}
