"""The subpackage's queries and their SQL, for the driver's entry module."""

from __future__ import annotations

from . import decontaminate, html_text, importance, jaccard, katz, licenses, mixing, quality_rules, token_counts, url_rules

QUERIES = {
    "op1_source_mixing": mixing.op1_source_mixing,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_benchmark_decontamination": decontaminate.op3_benchmark_decontamination,
    "op4_ngram_jaccard_join": jaccard.op4_ngram_jaccard_join,
    "op5_lm_scoring": katz.op5_lm_scoring,
    "op6_html_extraction": html_text.op6_html_extraction,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_quality_classifier": importance.op8_quality_classifier,
    "op9_url_filters": url_rules.op9_url_filters,
    "op10_license_scans": licenses.op10_license_scans,
}
ORACLE_SQL = {"op1_source_mixing": mixing.ORACLE, "op4_ngram_jaccard_join": jaccard.ORACLE, "op9_url_filters": url_rules.ORACLE}
