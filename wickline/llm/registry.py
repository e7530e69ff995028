"""The subpackage's queries and their SQL, merged by ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, mixing, phrases, quality, simhash, suffixes, token_counts, token_files, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing_sources": mixing.op1_mixing_sources,
        "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
        "op3_token_id_binary": token_files.op3_token_id_binary,
        "op4_benchmark_decontamination": decontaminate.op4_benchmark_decontamination,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_quality_rules": quality.op6_quality_rules,
        "op7_suffix_array_dedup": suffixes.op7_suffix_array_dedup,
        "op8_chat_quotation_linking": chat.op8_chat_quotation_linking,
        "op9_substring_dedup": phrases.op9_substring_dedup,
        "op10_token_counts": token_counts.op10_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_benchmark_decontamination": decontaminate.ORACLE_SQL,
        "op8_chat_quotation_linking": chat.ORACLE_SQL,
        "op9_substring_dedup": phrases.ORACLE_SQL,
    }
