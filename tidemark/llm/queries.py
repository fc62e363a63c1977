"""Queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from . import audit, codes, jaccard, kernel, langid, neighbours, packing, pieces, pii, quality, substrings, toxicity, urlrules


def queries() -> dict:
    return {
        "op1_neighbours": neighbours.op1_neighbours,
        "op2_url_filters": urlrules.op2_url_filters,
        "op3_sentencepiece": pieces.op3_sentencepiece,
        "op4_quality_rules": quality.op4_quality_rules,
        "op5_substring_dedup": substrings.op5_substring_dedup,
        "op6_jaccard_join": jaccard.op6_jaccard_join,
        "op7_packing": packing.op7_packing,
        "op8_pii": pii.op8_pii,
        "op9_language_id": langid.op9_language_id,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_quality_classifier": kernel.op11_quality_classifier,
        "op12_vector_codes": codes.op12_vector_codes,
        "op13_filter_audit": audit.op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filters": urlrules.OP2_SQL, "op5_substring_dedup": substrings.OP5_SQL, "op6_jaccard_join": jaccard.OP6_SQL, "op12_vector_codes": codes.OP12_SQL, "op13_filter_audit": audit.OP13_SQL}
