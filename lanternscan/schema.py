"""The finding row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINDING = (
    "rule_id string, description string, start_line int, end_line int, start_column int, end_column int, match string, secret string, "
    "file string, commit string, author string, email string, date string, message string, tags array<string>, entropy double, "
    "fingerprint string, link string"
)
NAMES = [x.split()[0] for x in FINDING.split(", ")]
#: Order of discovery: source, file (in the order of the walk), window or line, rule, offset.
ORDER = ["src_ord", "file", "place", "rule_ord", "start_line", "start_column"]
#: An archive's path and the name of a member.
MEMBER = r"(?i)^(.*?\.(?:tar\.gz|tar\.gzip|tar\.bz2|zip|gz|gzip|tar|tgz|bz2))!(.*)$"


def walk_key(file: str) -> Column:
    """A text that sorts as a walk finds files: those of a folder by name, then its folders, the last name first, each with all below it.

    The walk keeps folders on a stack, so the last one it saw is the next. Bytes of folder names are turned round, with an end that is
    larger than all of them; hexadecimal text sorts as the bytes do.
    """
    outer = F.when(F.rlike(F.col(file), F.lit(MEMBER)), F.regexp_extract(file, MEMBER, 1)).otherwise(F.col(file))
    parts = F.split(outer, "/")
    turned = lambda x: F.concat(F.lit("01"), F.translate(F.hex(x), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("FF"))
    folders = F.array_join(F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turned), "")
    return F.concat(folders, F.lit("00"), F.hex(F.element_at(parts, -1)), F.lit("00"), F.hex(F.regexp_extract(file, MEMBER, 2)))


def finding(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Columns of FINDING in order; absent texts become empty."""
    have = set(df.columns)
    cols = []
    for field in FINDING.split(", "):
        name, kind = field.split(" ", 1)
        cols.append((F.col(name) if name in have else F.lit("")).cast(kind).alias(name))
    return df.select(*cols, *extra)
