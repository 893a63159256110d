"""Scalar functions over findings, as Columns that stay in generated code."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import PatternError, glob_to_java

ALLOW_MARKER = "scan:allow"
NO_COMMIT = "0000000"
REDACTED = "REDACTED"


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def shannon_entropy(c: Column | str) -> Column:
    """Bits per character (code point) of a string; 0 for the empty one: log2(n) - sum(k * log2(k)) / n over the counts k.

    A character is counted by how much shorter the string is without it, which runs over the bytes once per distinct character.
    """
    s = column(c)
    n = F.char_length(s)
    chars = F.array_distinct(F.split(s, ""))
    count = lambda x: (n - F.char_length(F.replace(s, x, F.lit("")))).cast("double")
    total = F.aggregate(chars, F.lit(0.0), lambda acc, x: acc + F.when(x == "", 0.0).otherwise(count(x) * F.log2(count(x))))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.log2(n.cast("double")) - total / n)


def text_entropy() -> Callable[[Column | str], Column]:
    """The same for long texts: a vectorised function that looks at each character once."""

    def bits(s: str) -> float:
        counts = Counter(s).values()
        return math.log2(len(s)) - sum(k * math.log2(k) for k in counts) / len(s) if s else 0.0

    return F.pandas_udf(lambda texts: texts.map(lambda s: None if s is None else bits(s)), "double")


def byte_prefix(c: Column, n: Column) -> Column:
    """The first n bytes; a cut character becomes the replacement character."""
    return F.make_valid_utf8(F.substring(c.cast("binary"), F.lit(1), n.cast("int")).cast("string"))


def redact_percent(secret: Column | str, percent: int) -> Column:
    """Keep the first ``percent`` of the bytes (at least one): 100 keeps all, 0 or less nothing, empty stays empty."""
    s = column(secret)
    if percent >= 100:
        return s
    if percent <= 0:
        return F.when(s == "", s).otherwise(F.lit(REDACTED))
    keep = F.greatest(F.lit(1), F.floor(F.octet_length(s) * percent / 100))
    return F.when(s == "", s).otherwise(F.concat(byte_prefix(s, keep), F.lit("...")))


def redact_ends(secret: Column | str) -> Column:
    """Keep two bytes at either end; up to four bytes nothing is kept."""
    s = column(secret)
    tail = F.make_valid_utf8(F.substring(s.cast("binary"), -2, 2).cast("string"))
    return F.when(s == "", s).when(F.octet_length(s) <= 4, F.lit(REDACTED)).otherwise(F.concat(byte_prefix(s, F.lit(2)), F.lit("..."), tail))


def fingerprint(commit: Column | str, file: Column | str, rule_id: Column | str, line: Column | str) -> Column:
    c = F.coalesce(column(commit), F.lit(""))
    return F.concat_ws(":", F.when(c == "", F.lit(NO_COMMIT)).otherwise(c), column(file), column(rule_id), column(line).cast("string"))


def platform_link(platform: str, owner: Column, repo: Column, commit: Column, file: Column, line: Column) -> Column:
    """Link to a line on a hosting platform; empty for unknown ones."""
    # Path forms of the platforms.
    forms = {"github": ("https://github.com/", "/blob/"), "gitlab": ("https://gitlab.com/", "/-/blob/")}
    if platform.lower() not in forms:
        return F.lit("")
    host, blob = forms[platform.lower()]
    return F.concat(F.lit(host), owner, F.lit("/"), repo, F.lit(blob), F.coalesce(commit, F.lit("")), F.lit("/"), file, F.lit("#L"), line.cast("string"))


def parse_author(raw: Column | str) -> Column:
    """struct<name, email> of ``Name <mail>``: from the last ``<`` to the last ``>``; without them all is the name."""
    r = column(raw)
    whole = r.rlike(r"(?s)^.*<[^<]*>[^>]*\z")
    return F.struct(
        F.when(whole, F.trim(F.regexp_extract(r, r"(?s)^(.*)<[^<]*>[^>]*\z", 1))).otherwise(r).alias("name"),
        F.when(whole, F.regexp_extract(r, r"(?s)^.*<([^<]*)>[^>]*\z", 1)).otherwise(F.lit("")).alias("email"),
    )


def parse_remote(url: Column | str) -> Column:
    """struct<owner, repo> of an SSH or HTTP remote; both empty when it is neither."""
    u = F.regexp_replace(F.trim(column(url)), r"\.git\z", "")
    path = F.when(u.startswith("git@"), F.regexp_extract(u, r"^git@[^:]*:(.*)\z", 1)).otherwise(F.regexp_extract(u, r"^https?://[^/]+/(.*)\z", 1))
    owner = F.regexp_extract(path, r"^([^/]+)/", 1)
    return F.struct(owner.alias("owner"), F.when(owner == "", F.lit("")).otherwise(F.regexp_extract(path, r"^[^/]+/(.*)\z", 1)).alias("repo"))


def hunk_start(hunk: Column | str) -> Column:
    """The first new line number of a hunk header, after its first ``+``; 0 when there is none or it is too large."""
    return F.coalesce(F.regexp_extract(column(hunk), r"^[^+]*\+(\d+)", 1).try_cast("int"), F.lit(0))


def has_allow_marker(line: Column | str, marker: str = ALLOW_MARKER) -> Column:
    return F.contains(column(line), F.lit(marker))


def excluded_path(path: Column | str, patterns: Sequence[str]) -> Column:
    """A glob on the whole path or its last part, or a literal prefix."""
    p, out = column(path), F.lit(False)
    base = F.regexp_extract(p, r"([^/]*)\z", 1)
    for pattern in patterns:
        g = glob_to_java(pattern)
        out = out | p.rlike(g) | base.rlike(g) | p.startswith(pattern)
    return out


def excluded_commit(commit: Column | str, commits: Sequence[str]) -> Column:
    """Equal to, or a prefix of, or prefixed by a listed commit."""
    c, out = column(commit), F.lit(False)
    for x in commits:
        out = out | ((c != "") & (c.startswith(x) | F.lit(x).startswith(c)))
    return out


def check_commits(commits: Sequence[str]) -> None:
    for c in commits:
        if not re.fullmatch("[0-9a-fA-F]{7,}", c):
            raise ValueError(f"commit {c!r} must have at least 7 hexadecimal digits")


def check_globs(patterns: Sequence[str]) -> None:
    for p in patterns:
        try:
            glob_to_java(p)
        except PatternError as e:
            raise ValueError(f"exclude path {p!r}: {e}") from e


def safe_member(name: Column | str) -> Column:
    """An archive member name that is neither absolute nor steps up."""
    n = F.replace(column(name), F.lit("\\"), F.lit("/"))
    return ~n.startswith("/") & ~F.array_contains(F.split(n, "/"), "..")


def printable(c: Column | str) -> Column:
    return column(c).rlike(r"^[\p{L}\p{M}\p{N}\p{P}\p{S} \n\r\t]*\z")


def _decoded(binary: Column) -> Column:
    text = F.make_valid_utf8(binary.cast("string"))
    return F.when(printable(text), text)


def decode_base64(c: Column | str) -> Column:
    """The text behind standard, padded base64 of at least 16 characters; null when it is not that or not printable."""
    s = column(c)
    ok = s.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z") & (F.octet_length(s) >= 16)
    return F.when(ok, _decoded(F.try_to_binary(s, F.lit("base64"))))


def decode_base64url(c: Column | str) -> Column:
    s = column(c)
    ok = s.rlike(r"^(?:[A-Za-z0-9_-]{4})*(?:[A-Za-z0-9_-]{2}==|[A-Za-z0-9_-]{3}=)?\z") & (F.octet_length(s) >= 16)
    return F.when(ok, _decoded(F.try_to_binary(F.translate(s, "-_", "+/"), F.lit("base64"))))


def decode_hex(c: Column | str) -> Column:
    s = column(c)
    return F.when(s.rlike(r"^(?:[0-9A-Fa-f]{2}){16,}\z"), _decoded(F.try_to_binary(s, F.lit("hex"))))


def decode_percent(c: Column | str) -> Column:
    """Query-unescaped text (plus is a space); null without a ``%``, when malformed or unchanged."""
    s = column(c)
    plain = F.try_url_decode(s)
    return F.when(F.contains(s, F.lit("%")) & s.rlike(r"^(?:[^%]|%[0-9A-Fa-f]{2})*\z") & (plain != s), plain)
