"""A training corpus from raw documents, in stages that each apply one operator to all that the stage before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of ``docs``. Empty
tables, null texts and null ids pass through as the operators define it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternscan.llm import decontamination, ngram_jaccard, packing, pii, toxicity
from lanternscan.llm.common import Scratch, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar rejects go."""
    return toxicity.reject_toxic(docs, toxicity.learn_from_fold(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest doc_id."""
    return ngram_jaccard.keep_one_per_group(docs, **NEAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and credentials get surrogates; n_chars follows the new text."""
    key = pii.key_of(spark)
    if "n_chars" not in docs.columns:
        return pii.anonymize(docs, key)
    count = next(f"_changed{n}" for n in range(len(docs.columns) + 1) if f"_changed{n}" not in docs.columns)
    out = pii.anonymize(docs, key, count)
    chars = F.when(F.col(count) > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", chars).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces placed in sequences."""
    return packing.packed_documents(docs)


#: Near duplicates of the pipeline share 80 % of their shingles of five words; op4's own three words and 90 % bind that query only.
NEAR = {"shingle": 5, "percent": 80}

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", replace_pii),
    ("best_fit_packing", pack_sequences),
]

#: SQL has neither the learned grammar nor the tokenizer; tests/llm compares with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; what a stage returns is written as Parquet, and replaces what the one before returned."""
    docs, before = table(spark, sf_dir, "documents"), None
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.store(name, stage(spark, docs, sf_dir))
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
