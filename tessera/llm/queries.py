"""Registered queries of the operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import (
    assembly,
    chat_format,
    clustering,
    decontamination,
    exact_dedup,
    language_id,
    mixing,
    quality,
    sharding,
    simhash,
    substring_dedup,
    token_counts,
    toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_simhash_near_dedup": simhash.op4_simhash_near_dedup,
    "op5_quality": quality.op5_quality,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_mixing": mixing.op8_mixing,
    "op9_sharding": sharding.op9_sharding,
    "op10_language_id": language_id.op10_language_id,
    "op11_sale_assembly": assembly.op11_sale_assembly,
    "op12_centroid_clusters": clustering.op12_centroid_clusters,
    "op13_chat_format": chat_format.op13_chat_format,
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": exact_dedup.SQL,
    "op8_mixing": mixing.SQL,
    "op11_sale_assembly": assembly.SQL,
    "op12_centroid_clusters": clustering.SQL,
    "op13_chat_format": chat_format.SQL,
}
