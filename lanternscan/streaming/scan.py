"""Scans of unbounded input. Matching is stateless and appends; only dropping repeats and counting keep state, under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternscan.operators.lines import scan_lines, split_lines
from lanternscan.plans.ruleset import RuleSet


def stream_texts(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def stream_findings(texts: DataFrame, rs: RuleSet, baseline: DataFrame | None = None) -> DataFrame:
    """Findings of (path, text, optional commit) rows of a stream, without those of a static baseline."""
    found = scan_lines(split_lines(texts), rs)
    return found if baseline is None else found.join(baseline.select("fingerprint").distinct(), "fingerprint", "left_anti")


def drop_repeats(findings: DataFrame, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Each fingerprint once within the watermark."""
    return findings.withWatermark(time, delay).dropDuplicatesWithinWatermark(["fingerprint"])


def alerts(findings: DataFrame, time: str = "ts", every: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Findings per rule and tumbling window."""
    window = F.window(F.col(time), every)
    return findings.withWatermark(time, delay).groupBy(window, "rule_id").agg(F.count(F.lit(1)).alias("findings"))
