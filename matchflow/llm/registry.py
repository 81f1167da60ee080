"""The queries of this subpackage and the SQL that some can be checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from matchflow.llm import ann_search, byte_bpe, centroids, chat_format, decontamination, exact_dedup, language_id, minhash_dedup, packing, periodic_runs, secret_scan, substring_dedup, token_counts

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_secret_scan": secret_scan.op4_secret_scan,
    "op5_language_id": language_id.op5_language_id,
    "op6_ann_search": ann_search.op6_ann_search,
    "op7_byte_bpe": byte_bpe.op7_byte_bpe,
    "op8_minhash_dedup": minhash_dedup.op8_minhash_dedup,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_packing": packing.op10_packing,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_centroid_clusters": centroids.op12_centroid_clusters,
    "op13_decontamination": decontamination.op13_decontamination,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": chat_format.OP1_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op12_centroid_clusters": centroids.OP12_SQL,
    "op13_decontamination": decontamination.OP13_SQL,
}
