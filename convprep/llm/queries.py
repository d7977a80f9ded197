"""The operators of this subpackage as registered queries, with their SQL where SQL can express them."""

from __future__ import annotations

from convprep.llm import (
    bpe,
    centroid_clusters,
    exact_dedup,
    fingerprints,
    html_text,
    jaccard_join,
    language_id,
    license_scan,
    lm_scoring,
    mixing,
    sharding,
    spelling_variants,
    substring_dedup,
)

QUERIES = {
    "op10_mixing": mixing.op10_mixing,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op1_jaccard_join": jaccard_join.op1_jaccard_join,
    "op8_lm_scoring": lm_scoring.op8_lm_scoring,
    "op4_html_text": html_text.op4_html_text,
    "op5_sharding": sharding.op5_sharding,
    "op9_fingerprints": fingerprints.op9_fingerprints,
    "op2_language_id": language_id.op2_language_id,
    "op3_bpe": bpe.op3_bpe,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op11_license_scan": license_scan.op11_license_scan,
    "op12_spelling_variants": spelling_variants.op12_spelling_variants,
    "op13_centroid_clusters": centroid_clusters.op13_centroid_clusters,
}

ORACLES = {
    "op10_mixing": mixing.OP10_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op13_centroid_clusters": centroid_clusters.OP13_SQL,
}
