"""Command line: ``python -m lanternscan.cli [options] [path]``. Exit status 0: nothing found, N: findings, 2: error."""

from __future__ import annotations

import argparse
import os
import sys
import threading
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession

from lanternscan import __version__
from lanternscan.operators.findings import redact
from lanternscan.plans.config import safe_relative
from lanternscan.plans.scan import ScanOptions, scan
from lanternscan.sinks.reports import formats, render, write_document


def _between(low: int, high: int):
    def number(text: str) -> int:
        n = int(text)
        if not low <= n <= high:
            raise argparse.ArgumentTypeError(f"must be from {low} to {high}")
        return n

    return number


def local(path: str) -> str:
    """A path that exists here, made absolute: the JVM's working folder may be another one."""
    return os.path.abspath(path) if path and os.path.exists(path) else path


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lanternscan")
    p.add_argument("path", nargs="?", default=".")
    for flag in ("config", "baseline", "report", "report-template", "branch", "ignore-file"):
        p.add_argument(f"--{flag}", default="")
    for flag in ("skip-history", "staged", "verbose", "follow-symlinks"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("--stdin", nargs="?", const="-", default="", metavar="FILE", help="scan standard input (or a text file) line by line")
    p.add_argument("--version", action="version", version=f"%(prog)s {__version__}")
    p.add_argument("--no-color", action="store_true", help="accepted for scripts; reports have no colours")
    p.add_argument("--format", choices=list(formats()), default="json")
    p.add_argument("--redact", type=_between(0, 100), default=0, help="percent of a secret to hide; 0 shows it")
    p.add_argument("--exit-code", type=_between(0, 255), default=1)
    # a scan that takes longer than --timeout seconds is cancelled and ends as an error
    for flag in ("max-file-size", "max-decode-depth", "max-archive-depth", "max-findings", "timeout"):
        p.add_argument(f"--{flag}", type=int, default=0)
    p.add_argument("--enable-rule", action="append", default=[])
    p.add_argument("--platform", choices=["github", "gitlab", ""], default="")
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    timer = None
    try:
        report = safe_relative(a.report) if a.report else ""
        spark = spark or SparkSession.builder.appName("lanternscan").getOrCreate()
        if a.timeout > 0:
            spark.sparkContext.setJobGroup("scan", "scan", interruptOnCancel=True)
            timer = threading.Timer(a.timeout, spark.sparkContext.cancelJobGroup, ["scan"])
            timer.daemon = True
            timer.start()
        result = scan(spark, ScanOptions(
            path=local(a.path), config=a.config, baseline=local(a.baseline), ignore_file=local(a.ignore_file), branch=a.branch,
            skip_history=a.skip_history, staged=a.staged, stdin=local(a.stdin), max_file_mb=a.max_file_size, max_decode_depth=a.max_decode_depth,
            max_archive_depth=a.max_archive_depth, max_findings=a.max_findings, enabled_rules=a.enable_rule,
            platform=a.platform, follow_symlinks=a.follow_symlinks,
        ))
        found = redact(result.findings, a.redact).persist()
        template = Path(a.report_template).read_text() if a.report_template else ""
        if report:
            write_document(found, a.format, Path(report).absolute().as_uri(), template)
        else:
            sys.stdout.write(render(found, a.format, template))
        if a.verbose:
            print(*result.warnings, f"{found.count()} findings", sep="\n", file=sys.stderr)
        return a.exit_code if result.truncated or not found.isEmpty() else 0
    except Exception as e:  # every failure is reported as status 2
        print(f"error: {e}", file=sys.stderr)
        return 2
    finally:
        if timer:
            timer.cancel()


if __name__ == "__main__":
    sys.exit(main())
