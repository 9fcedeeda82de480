"""The queries of this subpackage and, where SQL can express them, their SQL on the same tables."""

from __future__ import annotations

from . import centroids, chat_format, decontaminate, jaccard_join, language_id, license_scan, line_dedup, prefix_trie, quality, recurrent_lm, secret_scan, source_mix, vector_dedup

QUERIES = {
    "op1_source_mix": source_mix.op1_source_mix,
    "op2_chat_format": chat_format.op2_chat_format,
    "op3_jaccard_join": jaccard_join.op3_jaccard_join,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_secret_scan": secret_scan.op5_secret_scan,
    "op6_quality": quality.op6_quality,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_language_id": language_id.op8_language_id,
    "op9_vector_dedup": vector_dedup.op9_vector_dedup,
    "op10_license_scan": license_scan.op10_license_scan,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_centroid_clustering": centroids.op12_centroid_clustering,
    "op13_lm_scoring": recurrent_lm.op13_lm_scoring,
}
ORACLE_SQL = {
    "op2_chat_format": chat_format.OP2_SQL,
    "op4_line_dedup": line_dedup.OP4_SQL,
    "op5_secret_scan": secret_scan.OP5_SQL,
    "op7_decontaminate": decontaminate.OP7_SQL,
    "op10_license_scan": license_scan.OP10_SQL,
    "op11_prefix_trie": prefix_trie.OP11_SQL,
    "op12_centroid_clustering": centroids.OP12_SQL,
}
