"""The registered queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, language_id, license_scan, merkle, ngram_jaccard, packing, pii, quality_rules, substring_dedup, suffix_dedup, token_files, toxicity, whitening


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``corpus_pipeline.run``; imported here, as that module stands beside the package."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_best_fit_packing": packing.op2_best_fit_packing,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_ngram_jaccard_join": ngram_jaccard.op4_ngram_jaccard_join,
        "op5_benchmark_decontamination": decontamination.op5_benchmark_decontamination,
        "op6_license_scans": license_scan.op6_license_scans,
        "op7_suffix_array_dedup": suffix_dedup.op7_suffix_array_dedup,
        "op8_substring_dedup": substring_dedup.op8_substring_dedup,
        "op9_pii": pii.op9_pii,
        "op10_language_id": language_id.op10_language_id,
        "op11_merkle_manifest": merkle.op11_merkle_manifest,
        "op12_embedding_whitening": whitening.op12_embedding_whitening,
        "op13_token_files": token_files.op13_token_files,
        "pipeline": pipeline,
        "quality_ablations": quality_rules.quality_ablations,
        "license_phrases": license_scan.license_phrases,
    }


def oracle_sql() -> dict[str, str]:
    """Operators that SQL cannot express are tested against brute force in tests/llm instead."""
    return {
        "op1_quality_rules": quality_rules.ORACLE_SQL,
        "op4_ngram_jaccard_join": ngram_jaccard.ORACLE_SQL,
        "op5_benchmark_decontamination": decontamination.ORACLE_SQL,
        "op8_substring_dedup": substring_dedup.ORACLE_SQL,
        "op11_merkle_manifest": merkle.ORACLE_SQL,
        "quality_ablations": quality_rules.ABLATION_SQL,
        "license_phrases": license_scan.PHRASES_SQL,
    }
