"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from reelframe.llm import (
    chat_format,
    decontamination,
    html_extraction,
    jaccard_join,
    license_scan,
    packing,
    quality_classifier,
    quality_rules,
    ranked_search,
    source_divergence,
    suffix_dedup,
    toxicity,
    url_filters,
)

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_packing": packing.op2_packing,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_quality_classifier": quality_classifier.op4_quality_classifier,
    "op5_ngram_jaccard_join": jaccard_join.op5_ngram_jaccard_join,
    "op6_html_extraction": html_extraction.op6_html_extraction,
    "op7_benchmark_decontamination": decontamination.op7_benchmark_decontamination,
    "op8_url_filters": url_filters.op8_url_filters,
    "op9_suffix_array_dedup": suffix_dedup.op9_suffix_array_dedup,
    "op10_chat_formatting": chat_format.op10_chat_formatting,
    "op11_source_divergence": source_divergence.op11_source_divergence,
    "op12_ranked_search": ranked_search.op12_ranked_search,
    "op13_license_scans": license_scan.op13_license_scans,
}

ORACLES = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op10_chat_formatting": chat_format.ORACLE,
    "op11_source_divergence": source_divergence.ORACLE,
    "op12_ranked_search": ranked_search.ORACLE,
    "op13_license_scans": license_scan.ORACLE,
}
