"""The operators over their whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cellmob.llm import (alignment, decontamination, exact_dedup, hard_negatives, language,
                         minhash, mixing, packing, quality, sharding, substring, suffixes,
                         vectors_topk)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": substring.op1,
    "op2_exact_dedup": exact_dedup.op2,
    "op3_quality_classifier": quality.op3,
    "op4_source_mixing": mixing.op4,
    "op5_language_id": language.op5,
    "op6_sharding": sharding.op6,
    "op7_exact_topk": vectors_topk.op7,
    "op8_minhash_dedup": minhash.op8,
    "op9_suffix_array_dedup": suffixes.op9,
    "op10_best_fit_packing": packing.op10,
    "op11_tokenizer_alignment": alignment.op11,
    "op12_benchmark_decontamination": decontamination.op12,
    "op13_hard_negatives": hard_negatives.op13,
}

# The others depend on hashes, fitted models or a search that SQL cannot express;
# tests/llm holds them against brute force, invariants and held-out rows.
ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": substring.SQL,
    "op2_exact_dedup": exact_dedup.SQL,
    "op4_source_mixing": mixing.SQL,
    "op7_exact_topk": vectors_topk.SQL,
    "op8_minhash_dedup": minhash.SQL,
    "op9_suffix_array_dedup": suffixes.SQL,
    "op12_benchmark_decontamination": decontamination.SQL,
    "op13_hard_negatives": hard_negatives.SQL,
}
