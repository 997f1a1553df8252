"""The queries of this subpackage and their SQL, for the entry point to add."""

from __future__ import annotations

from siftmark.llm import (
    alignment, chat_format, exact_dedup, jaccard_join, language_id, media_ts, packing, pii, quality, sentencepiece_scan, token_counts, toxicity, vector_codes,
)

QUERIES = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_ngram_jaccard_join": jaccard_join.op2_ngram_jaccard_join,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_packing": packing.op4_packing,
    "op5_sentencepiece": sentencepiece_scan.op5_sentencepiece,
    "op6_pii": pii.op6_pii,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_media_columns": media_ts.op9_media_columns,
    "op10_language_id": language_id.op10_language_id,
    "op11_quality": quality.op11_quality,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_alignment": alignment.op13_alignment,
}

#: DuckDB SQL where SQL can express the query; the tests hold the others against brute force.
ORACLES = {
    "op1_chat_format": chat_format.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op12_vector_codes": vector_codes.ORACLE,
}
