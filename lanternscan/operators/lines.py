"""The line path: each line is judged by itself, and a rule finds at most one match on it."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternscan.functions.text import ALLOW_MARKER, fingerprint, has_allow_marker, shannon_entropy
from lanternscan.operators.candidates import candidate_rules, with_candidates
from lanternscan.plans.ruleset import RuleSet, globally_allowed, rule_allowed
from lanternscan.schema import finding


def split_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows (all other columns, line_no, line) of each text; a final line break ends the last line, and one ``\\r`` goes with it."""
    others = [c for c in df.columns if c != text]
    lines = F.split(F.col(text), "\n", -1)
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    return df.select(*others, F.posexplode(lines).alias("pos", "line")).select(
        *others, (F.col("pos") + 1).alias("line_no"), F.regexp_replace("line", r"\r\z", "").alias("line")
    )


def match_rules(lines: DataFrame, rs: RuleSet) -> DataFrame:
    """Lines x rules whose path, keywords and pattern fit, with full_match, secret and entropy.

    Lines without any keyword are cut off first; patterns run on candidates only. No shuffle.
    """
    return _scored(candidate_rules(lines, "line", rs))


def match_distinct(lines: DataFrame, rs: RuleSet) -> DataFrame:
    """The same by content: patterns run once on a text that stands on many lines, in many commits, and what matched is joined back to its lines.

    The guard, which is cheap, runs on each line first, so that only lines which may match are shuffled. Few texts match; they are
    the small side of the join, which Spark broadcasts if it measures them so.
    """
    anywhere = replace(rs, rules=tuple(replace(r, path="") for r in rs.rules))
    lines = with_candidates(lines, "line", anywhere, by_factors=True).drop("rule_ords")
    texts = lines.select("line").distinct().withColumn("path", F.lit(""))
    matched = match_rules(texts, anywhere).select(F.col("line").alias("text"), "rule_ord", "full_match", "secret", "entropy")
    found = lines.join(matched, F.col("line") == F.col("text")).drop("text")
    found = found.join(rs.table(lines.sparkSession), "rule_ord")
    return found.filter(F.col("path_regex").isNull() | F.rlike(F.col("path"), F.col("path_regex")))


def _scored(joined: DataFrame) -> DataFrame:
    full = F.expr("regexp_extract(line, regex, 0)")
    out = joined.withColumn("full_match", full).withColumn("secret", F.expr("regexp_extract(line, regex, grp)"))
    out = out.withColumn("entropy", shannon_entropy("secret"))
    return out.filter((F.col("min_entropy") <= 0) | (F.col("entropy") >= F.col("min_entropy")))


def commit_column(df: DataFrame) -> Column:
    return F.col("commit") if "commit" in df.columns else F.lit("")


def scan_lines(lines: DataFrame, rs: RuleSet, marker: str = ALLOW_MARKER, by_content: bool = False) -> DataFrame:
    """Findings of lines (path, line_no, line, optional commit, author, email, date, message), plus rule_ord and place.

    ``by_content`` matches equal lines once, which pays where texts repeat, as in a history.
    """
    commit, path, line = commit_column(lines), F.col("path"), F.col("line")
    usable = lines.filter(line.isNotNull() & ~has_allow_marker(line, marker))
    m = match_distinct(usable, rs) if by_content else match_rules(usable, rs)
    secret, full = F.col("secret"), F.col("full_match")
    m = m.filter(~rule_allowed(secret, full, line, path, commit))
    m = m.filter(~globally_allowed(rs, secret, full, line, path, commit))
    start = F.octet_length(F.expr("substring_index(line, full_match, 1)"))  # the first place of the match's text
    out = m.select(
        "rule_id", "description", F.col("line_no").alias("start_line"), F.col("line_no").alias("end_line"),
        (start + 1).alias("start_column"), (start + F.octet_length(full)).alias("end_column"), full.alias("match"), "secret",
        path.alias("file"), commit.alias("commit"), *(c for c in ("author", "email", "date", "message", "link") if c in lines.columns),
        "tags", "entropy", fingerprint(commit, path, "rule_id", "line_no").alias("fingerprint"), "rule_ord",
        F.col("line_no").cast("long").alias("place"),
    )
    return finding(out, ("rule_ord", "place"))
