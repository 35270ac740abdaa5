"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from cadenza.llm import decontaminate, exact_dedup, language_id, ngram_join, packing, quality, secret_scan, spelling, token_alignment, token_counts, toxicity, url_filter, warc

QUERIES = {
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_warc": warc.op8_warc,
    "op2_ngram_jaccard_join": ngram_join.op2_ngram_jaccard_join,
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_secret_scan": secret_scan.op10_secret_scan,
    "op11_language_id": language_id.op11_language_id,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_token_alignment": token_alignment.op13_token_alignment,
}
ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard_join": ngram_join.SQL,
    "op5_exact_dedup": exact_dedup.SQL,
    "op6_url_filter": url_filter.SQL,
    "op8_warc": warc.SQL,
    "op12_spelling_variants": spelling.SQL,
}
