"""The text operators' queries, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from tarnql.llm import decontamination, fingerprints, html_text, jaccard_join, language, licenses, packing, quality, sql, token_counts, toxicity

_QUERIES = (
    decontamination.op1_benchmark_decontamination,
    packing.op2_packing,
    html_text.op3_html_extraction,
    jaccard_join.op4_ngram_jaccard_join,
    language.op5_language_id,
    licenses.op6_license_scans,
    toxicity.op7_toxicity,
    token_counts.op8_token_counts,
    quality.op9_quality_classifier,
    fingerprints.op10_document_fingerprints,
)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op1_benchmark_decontamination": sql.DECONTAMINATION, "op4_ngram_jaccard_join": sql.JACCARD}
