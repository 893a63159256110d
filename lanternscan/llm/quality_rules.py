"""Quality rules: a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one long of failure bits; a
policy is a versioned mask of rule bits, so verdicts and ablations are bitwise operations on the ledger and never
read a text again.

Null or empty texts have no words: every measurement is 0 and only ``few_words`` fails. Repeated rows get equal
results. A null doc_id is carried through.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import covered, map_documents, table, text_bytes, token_hashes, window_hashes

SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words")

#: Bit, name, failing condition. Integer arithmetic only, so that every engine agrees.
RULES: list[tuple[int, str, str]] = [
    (0, "few_words", "n_words < 10"),
    (1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    (2, "symbol_words", "n_words > 0 and 2 * n_symbols > n_words"),
    (3, "word_length", "n_words >= 10 and (word_chars < 2 * n_words or word_chars > 12 * n_words)"),
    (4, "duplicate_lines", "n_lines > 0 and 10 * n_dup_lines > 6 * n_lines"),
    (5, "few_distinct_words", "n_words >= 40 and 20 * n_distinct_words < n_words"),
    (6, "very_long", "n_words > 1000000"),
]
BIT = {name: 1 << bit for bit, name, _ in RULES}
BASE = BIT["few_words"] | BIT["repeated_windows"]

#: Versioned policies: the rules whose failure rejects a document.
POLICIES: dict[str, int] = {
    "v1": BASE,
    "v2": BASE | BIT["symbol_words"],
    "v3": BASE | BIT["symbol_words"] | BIT["word_length"] | BIT["duplicate_lines"] | BIT["few_distinct_words"],
    "strict": sum(BIT.values()),
}
DEFAULT_POLICY = "v3"


def measure(data: bytes | None, window: int = 5) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    data = data or b""
    words = data.split()
    n = len(words)
    chars = len(data.decode("utf-8", "replace")) - sum(data.count(c) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
    lines = [x for x in data.split(b"\n") if x.strip()]
    tokens = token_hashes(words)
    repeat, h = 0, window_hashes(tokens, window)
    if len(h) > 1:
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        if same.any():
            twice = np.zeros(len(h), dtype=bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            repeat = int(covered(np.flatnonzero(twice), window, n).sum())
    return (
        n, chars, sum(data.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS))), len(lines) - len(set(lines)), repeat,
        len(lines), len(np.unique(tokens)),
    )


def ledger(docs: DataFrame, rules: list[tuple[int, str, str]] = RULES) -> DataFrame:
    """doc_id, the measurements and ``fail_bits`` of every document; one narrow pass, no shuffle."""

    def build():
        def fn(ids, texts):
            return [ids, *map(list, zip(*map(measure, texts)))] if ids else [[] for _ in range(1 + len(MEASURES))]

        return fn

    schema = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)
    out = map_documents(docs, (F.col("doc_id").cast("long"), text_bytes()), schema, build)
    bits = F.lit(0).cast("long")
    for bit, _, fails in rules:
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return out.withColumn("fail_bits", bits)


def passes(mask: int, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask).cast("long")) == 0


def apply_policy(ledger_df: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    return (
        ledger_df.withColumn("base_failed", ~passes(BASE))
        .withColumn("kept", passes(BASE | POLICIES[policy]))
        .withColumn("policy", F.lit(policy))
    )


def ablations(ledger_df: DataFrame, policies: dict[str, int] = POLICIES) -> DataFrame:
    """Per policy and rule: documents that fail the rule, that only this rule rejects, and what is kept without it.

    Documents are first counted by their failure bits (at most 2 ** rules rows); the rest is bitwise.
    """
    spark = ledger_df.sparkSession
    counts = ledger_df.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    grid = [(p, m, name, 1 << bit) for p, m in policies.items() for bit, name, _ in RULES if m >> bit & 1]
    rules = spark.createDataFrame(grid, "policy string, mask long, rule string, bit long")
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(F.lit(0))).alias
    return (
        counts.join(F.broadcast(rules))  # a fixed few rules against the counted patterns, not the documents
        .groupBy("policy", "rule")
        .agg(
            total(F.col("fail_bits").bitwiseAND(F.col("bit")) != 0)("n_failed"),
            total(hit == F.col("bit"))("n_only_this"),
            total(hit == 0)("n_kept"),
            total(hit.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0)("n_kept_without"),
        )
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_policy(ledger(table(spark, sf_dir, "documents")))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits"
    )


_SPLIT = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

MEASURE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, {_SPLIT.format("t")} AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, i, ws[i:i+4] AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
c AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM g) WHERE n > 1),
v AS (SELECT r, count(DISTINCT i + o) AS n_repeat_words FROM c, (SELECT unnest(range(0, 5)) AS o) GROUP BY r),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
  CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(list_distinct(ws)) AS BIGINT) AS n_distinct_words
  FROM w LEFT JOIN v USING (r))"""

ORACLE_SQL = (
    MEASURE_SQL
    + ", b AS (SELECT *, CAST("
    + " + ".join(f"(CASE WHEN {fails} THEN {1 << bit} ELSE 0 END)" for bit, _, fails in RULES)
    + " AS BIGINT) AS fail_bits FROM m)"
    + f" SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {BASE}) <> 0 AS base_failed, "
    + f"(fail_bits & {BASE | POLICIES[DEFAULT_POLICY]}) = 0 AS kept, fail_bits FROM b"
)


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy does to the documents, from the ledger's bits."""
    return ablations(ledger(table(spark, sf_dir, "documents")))


_GRID = ", ".join(f"('{p}', {m}, '{name}', {1 << bit})" for p, m in POLICIES.items() for bit, name, _ in RULES if m >> bit & 1)

ABLATION_SQL = (
    ORACLE_SQL.rsplit(" SELECT ", 1)[0]
    + f""", r(policy, mask, rule, bit) AS (VALUES {_GRID})
SELECT policy, rule, count(*) FILTER (fail_bits & bit <> 0) AS n_failed, count(*) FILTER (fail_bits & mask = bit) AS n_only_this,
  count(*) FILTER (fail_bits & mask = 0) AS n_kept, count(*) FILTER (fail_bits & mask & ~bit = 0) AS n_kept_without
FROM b, r GROUP BY policy, rule"""
)
