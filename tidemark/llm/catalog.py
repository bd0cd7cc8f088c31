"""The registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from tidemark.llm import (
    centroid_clusters, exact_dedup, fingerprints, line_dedup, lm_score, mixing, ngram_join, quality_rules, sentencepiece_codec, substring_dedup,
    suffix_dedup, url_filter, vector_codes,
)

QUERIES = {
    "op1_sentencepiece": sentencepiece_codec.op1_sentencepiece,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_lm_score": lm_score.op5_lm_score,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_source_mixing": mixing.op8_source_mixing,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_ngram_join": ngram_join.op10_ngram_join,
    "op11_centroid_clusters": centroid_clusters.op11_centroid_clusters,
    "op12_fingerprints": fingerprints.op12_fingerprints,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}
ORACLE = {
    "op2_url_filter": url_filter.ORACLE,
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op4_suffix_dedup": suffix_dedup.ORACLE,
    "op7_substring_dedup": substring_dedup.ORACLE,
    "op8_source_mixing": mixing.ORACLE,
    "op9_line_dedup": line_dedup.ORACLE,
    "op10_ngram_join": ngram_join.ORACLE,
    "op11_centroid_clusters": centroid_clusters.ORACLE,
    "op13_vector_codes": vector_codes.ORACLE,
}
