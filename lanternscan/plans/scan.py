"""A whole scan: sources, rules, subtraction, limits, redaction."""

from __future__ import annotations

import os
import sys
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternscan.functions.text import ALLOW_MARKER, check_commits, check_globs, parse_remote, platform_link
from lanternscan.operators.buffers import scan_buffers
from lanternscan.operators.diffs import added_lines
from lanternscan.operators.findings import add_decoded_tags, limit_findings, subtract, union_sources
from lanternscan.operators.lines import scan_lines
from lanternscan.plans.config import Config, load
from lanternscan.plans.ruleset import RuleSet
from lanternscan.sources import git
from lanternscan.sources.archives import archive_lines, zip_lines
from lanternscan.sources.files import qualified, read_baseline, read_files, read_ignore_list, read_lines, read_linked_files, read_pipe, shared_folder

IGNORE_FILE = ".scanignore"


@dataclass
class ScanOptions:
    path: str = "."
    config: str = ""
    baseline: str = ""
    ignore_file: str = ""
    branch: str = ""
    skip_history: bool = False
    staged: bool = False
    stdin: str = ""  # "-" for standard input, or a text file that stands for it
    max_file_mb: int = 0
    max_decode_depth: int = 0
    max_archive_depth: int = 0
    max_findings: int = 0
    enabled_rules: list[str] = field(default_factory=list)
    platform: str = ""
    follow_symlinks: bool = False
    marker: str = ALLOW_MARKER


@dataclass
class ScanResult:
    findings: DataFrame
    truncated: bool
    warnings: list[str]


def compile_rules(config: Config, enabled: list[str]) -> RuleSet:
    return RuleSet.compile(config.rules, config.allowlists, config.use_default, config.disabled_rules, enabled)


def scan(spark: SparkSession, options: ScanOptions) -> ScanResult:
    """Findings with the keys of their discovery; nothing runs on the data until they are used, but for a limit."""
    config = load(options.config) if options.config else Config()
    check_globs(config.exclude_paths)
    check_commits(config.exclude_commits)
    rs = compile_rules(config, options.enabled_rules)
    sources = []
    if options.stdin:
        lines = read_pipe(spark, sys.stdin.buffer, "stdin") if options.stdin == "-" else read_lines(spark, options.stdin, "stdin")
        sources.append(scan_lines(lines, rs, options.marker))
    else:
        has_git = os.path.isdir(os.path.join(options.path, ".git"))
        owner = repo = ""
        if options.platform and has_git:
            url = spark.createDataFrame([(git.remote_url(options.path),)], "url string")
            owner, repo = url.select(parse_remote("url").alias("r")).select("r.*").first()
        read = read_linked_files if options.follow_symlinks else read_files
        files = read(spark, options.path, options.max_file_mb, config.exclude_paths)
        sources.append(scan_buffers(files, rs, options.marker, platform=options.platform, owner=owner, repo=repo))
        if options.max_archive_depth > 0:
            is_zip = F.lower("path").endswith(".zip")
            top = qualified(spark, options.path).rstrip("/")
            zips = files.filter(is_zip).select("path", F.concat_ws("/", F.lit(top), "path").alias("real"))
            inner = archive_lines(files.filter(~is_zip)).unionByName(zip_lines(zips))
            sources[0] = sources[0].unionByName(scan_lines(inner, rs, options.marker))
        if options.staged or (has_git and not options.skip_history):
            patches = git.staged(spark, options.path) if options.staged else git.history(spark, options.path, options.branch)
            lines = added_lines(patches, config.exclude_paths, config.exclude_commits)
            found = scan_lines(lines, rs, options.marker, by_content=not options.staged)
            if owner and repo and not options.staged:
                found = found.withColumn("link", platform_link(options.platform, F.lit(owner), F.lit(repo), F.col("commit"), F.col("file"), F.col("start_line")))
            sources.append(found)
    found = union_sources(sources)
    truncated = False
    if options.max_findings > 0 and not options.stdin:
        # the rows that stay are stored, so that nothing is scanned twice
        at = f"{shared_folder(spark)}/limited-{uuid.uuid4().hex}"
        limited = limit_findings(found, options.max_findings)
        limited.write.parquet(at)
        found = spark.read.schema(limited.schema).parquet(at)
        truncated = found.count() >= options.max_findings
    ignore = options.ignore_file or os.path.join(options.path, IGNORE_FILE)
    if os.path.isfile(ignore):
        found = subtract(found, read_ignore_list(spark, ignore))
    if options.baseline:
        found = subtract(found, read_baseline(spark, options.baseline))
    return ScanResult(add_decoded_tags(found, rs, options.max_decode_depth), truncated, config.warnings)


def scan_table(df: DataFrame, text: str, path, rs: RuleSet, **options) -> DataFrame:
    """Whole texts of any table, by the buffer path."""
    from lanternscan.sources.files import from_table

    return scan_buffers(from_table(df, text, path), rs, **options)
