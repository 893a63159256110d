"""What happens to findings after a scan: subtraction, redaction, limits, tags, summaries."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternscan.functions.decode import decode_all
from lanternscan.functions.text import redact_percent
from lanternscan.operators.lines import match_rules
from lanternscan.plans.ruleset import RuleSet, globally_allowed, rule_allowed
from lanternscan.schema import ORDER, walk_key
from lanternscan.sources.files import shared_folder


def subtract(findings: DataFrame, known: DataFrame) -> DataFrame:
    """Findings whose fingerprint is not among the known ones (a baseline or an ignore list)."""
    return findings.join(known.select("fingerprint").distinct(), "fingerprint", "left_anti").select(findings.columns)


def redact(findings: DataFrame, level: int) -> DataFrame:
    """Level 0 shows secrets, N hides N percent of them; the match becomes the redacted secret."""
    if level <= 0:
        return findings
    return findings.withColumn("_r", redact_percent("secret", 100 - level)).withColumns(
        {"match": F.when(F.col("secret") == "", F.col("match")).otherwise(F.col("_r")), "secret": F.col("_r")}
    ).drop("_r")


def order_keys(findings: DataFrame) -> list[Column]:
    """The order of discovery, as far as the findings have its columns."""
    return [walk_key(c) if c == "file" else F.col(c) for c in ORDER if c in findings.columns]


def in_order(df: DataFrame, group: str, inner: str, name: str = "nth") -> DataFrame:
    """``name``: the number of each row from 1, when groups stand in the order of ``group`` and rows in a group have the numbers ``inner``.

    Groups are counted, their counts summed in order by blocks of a range-partitioned sort, and joined back: no task sees all rows. The
    counts are stored, so that all parts of the plan see the same blocks.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = sizes.repartitionByRange(parts, group).withColumn("_part", F.spark_partition_id())
    inside = Window.partitionBy("_part").orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_before", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    at = f"{shared_folder(df.sparkSession)}/order-{uuid.uuid4().hex}"
    placed.write.parquet(at)
    placed = df.sparkSession.read.schema(placed.schema).parquet(at)
    totals = placed.groupBy("_part").agg(F.sum("_size").alias("_total"))  # one row per partition of the sort
    ahead = totals.withColumn("_ahead", F.coalesce(F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = placed.join(F.broadcast(ahead.select("_part", "_ahead")), "_part").select(group, (F.col("_before") + F.col("_ahead")).alias("_start"))
    return df.join(starts, group).withColumn(name, (F.col("_start") + F.col(inner)).cast("long")).drop("_start")


def limit_findings(findings: DataFrame, most: int) -> DataFrame:
    """The first findings in order of discovery; 0 keeps all."""
    return findings.orderBy(*order_keys(findings)).limit(most) if most > 0 else findings


def union_sources(sources: list[DataFrame]) -> DataFrame:
    """All findings of several sources, with src_ord; a secret found by two sources stays twice."""
    out = None
    for k, s in enumerate(sources):
        s = s.withColumn("src_ord", F.lit(k))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return out


def add_decoded_tags(findings: DataFrame, rs: RuleSet, max_depth: int) -> DataFrame:
    """``decoded:<encoding>`` for each decoded value of the secret in which some rule matches.

    Distinct secrets are decoded once and joined back, so equal secrets cost one decoding.
    """
    if max_depth <= 0:
        return findings
    secrets = findings.select("secret", "file", "commit").distinct().withColumn("d", decode_all(max_depth)(F.col("secret")))
    values = secrets.select("secret", "file", "commit", F.posexplode("d").alias("n", "v")).select(
        "secret", F.col("file").alias("path"), "commit", "n", F.col("v.encoding").alias("encoding"), F.col("v.value").alias("line")
    )
    m = match_rules(values.withColumnRenamed("secret", "owner"), rs)
    args = (F.col("secret"), F.col("full_match"), F.col("line"), F.col("path"), F.col("commit"))
    m = m.filter(~rule_allowed(*args)).filter(~globally_allowed(rs, *args))
    hit = m.groupBy("owner", "path", "commit", "n").agg(F.first("encoding").alias("encoding"))
    tags = hit.groupBy("owner", "path", "commit").agg(F.array_sort(F.collect_list(F.struct("n", "encoding"))).alias("t"))
    tags = tags.select(
        F.col("owner").alias("secret"), F.col("path").alias("file"), "commit",
        F.transform("t", lambda x: F.concat(F.lit("decoded:"), x.encoding)).alias("_more"),
    )
    none = F.array().cast("array<string>")
    joined = findings.join(tags, ["secret", "file", "commit"], "left")
    return joined.withColumn("tags", F.concat("tags", F.coalesce("_more", none))).select(findings.columns)


def rule_summary(findings: DataFrame) -> DataFrame:
    """Per rule, in order of first appearance: findings and their count."""
    keys = order_keys(findings)
    order = F.struct(*(k.alias(f"k{n}") for n, k in enumerate(keys))) if keys else F.struct("fingerprint")
    return (
        findings.groupBy("rule_id")
        .agg(F.count(F.lit(1)).alias("findings"), F.min_by("description", order).alias("description"), F.min(order).alias("first"))
        .select("rule_id", "description", "findings", "first")
    )


def count_status(findings: DataFrame, truncated: bool = False, exit_code: int = 1) -> int:
    """0 when nothing was found, else the exit code."""
    return exit_code if truncated or not findings.isEmpty() else 0
