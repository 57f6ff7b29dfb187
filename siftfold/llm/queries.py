"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from siftfold.llm import exact_dedup, licenses, lm_scoring, media, mixing, ngram_join, quality, sentencepiece_nbest, token_counts, toxicity

QUERIES = {
    "op1_sentencepiece": sentencepiece_nbest.op1_sentencepiece,
    "op2_lm_scoring": lm_scoring.op2_lm_scoring,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_mixing": mixing.op4_mixing,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_media_columns": media.op6_media_columns,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_quality": quality.op9_quality,
    "op10_ngram_join": ngram_join.op10_ngram_join,
}
ORACLES = {"op3_exact_dedup": exact_dedup.OP3_SQL, "op4_mixing": mixing.OP4_SQL, "op8_license_scan": licenses.OP8_SQL}
