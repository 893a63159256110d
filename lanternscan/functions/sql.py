"""The scan from SQL: temporary functions that Catalyst inlines into the query that calls them.

    from lanternscan.functions import sql
    sql.register(spark, RuleSet.compile())
    spark.sql(\"\"\"
        SELECT path, line_no, inline(found) FROM (
            SELECT path, line_no, scan_match(line, path, '') AS found FROM (SELECT path, inline(lines) FROM (SELECT path, scan_lines(text) AS lines FROM docs))
        )\"\"\")

Scalar functions cover entropy, redaction, fingerprints, links, authors, hunks and decoding. Functions that return rows as an array of
structs split a text into lines, match a line (the first match of each rule) or a whole text (every match), and take encoded values
apart. The guard of keywords and factors is a vectorised function; the few rules that it leaves for a text are picked
by number from a constant array, so a query that matches stays one narrow stage. ``diff_view`` makes a view of the added lines of a
view of patches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lanternscan.functions.decode import decode_all
from lanternscan.functions.text import ALLOW_MARKER, NO_COMMIT, REDACTED
from lanternscan.operators.candidates import candidate_lookup
from lanternscan.plans.ruleset import RuleSet

_TIMES = "CAST(char_length(s) - char_length(replace(s, x, '')) AS DOUBLE)"
_VALID = "make_valid_utf8(CAST({} AS STRING))"
_PRINTABLE = r"rlike({0}, r'^[\p{{L}}\p{{M}}\p{{N}}\p{{P}}\p{{S}} \n\r\t]*\z')"


def _decoded(ok: str, binary: str) -> str:
    text = _VALID.format(binary)
    return f"CASE WHEN {ok} AND {_PRINTABLE.format(text)} THEN {text} END"


#: name: (parameters, type of the result, expression)
SCALAR = {
    "entropy": ("s STRING", "DOUBLE", f"CASE WHEN char_length(s) = 0 THEN 0D ELSE log2(CAST(char_length(s) AS DOUBLE)) - aggregate(array_distinct(split(s, '')), 0D, (a, x) -> a + CASE WHEN x = '' THEN 0D ELSE {_TIMES} * log2({_TIMES}) END) / char_length(s) END"),
    "redact": ("s STRING, percent INT", "STRING", f"CASE WHEN percent >= 100 OR s = '' THEN s WHEN percent <= 0 THEN '{REDACTED}' ELSE concat({_VALID.format('substring(CAST(s AS BINARY), 1, CAST(greatest(1, floor(octet_length(s) * percent / 100)) AS INT))')}, '...') END"),
    "redact_ends": ("s STRING", "STRING", f"CASE WHEN s = '' THEN s WHEN octet_length(s) <= 4 THEN '{REDACTED}' ELSE concat({_VALID.format('substring(CAST(s AS BINARY), 1, 2)')}, '...', {_VALID.format('substring(CAST(s AS BINARY), -2, 2)')}) END"),
    "fingerprint": ("commit STRING, file STRING, rule_id STRING, line BIGINT", "STRING", f"concat_ws(':', CASE WHEN coalesce(commit, '') = '' THEN '{NO_COMMIT}' ELSE commit END, file, rule_id, CAST(line AS STRING))"),
    "link": ("platform STRING, owner STRING, repo STRING, commit STRING, file STRING, line BIGINT", "STRING", "CASE lower(platform) WHEN 'github' THEN concat('https://github.com/', owner, '/', repo, '/blob/', coalesce(commit, ''), '/', file, '#L', line) WHEN 'gitlab' THEN concat('https://gitlab.com/', owner, '/', repo, '/-/blob/', coalesce(commit, ''), '/', file, '#L', line) ELSE '' END"),
    "author": ("raw STRING", "STRUCT<name: STRING, email: STRING>", r"named_struct('name', CASE WHEN rlike(raw, r'(?s)^.*<[^<]*>[^>]*\z') THEN trim(regexp_extract(raw, r'(?s)^(.*)<[^<]*>[^>]*\z', 1)) ELSE raw END, 'email', regexp_extract(raw, r'(?s)^.*<([^<]*)>[^>]*\z', 1))"),
    "hunk_start": ("hunk STRING", "INT", r"coalesce(try_cast(regexp_extract(hunk, r'^[^+]*\+(\d+)', 1) AS INT), 0)"),
    "allowed_line": ("line STRING", "BOOLEAN", f"contains(line, '{ALLOW_MARKER}')"),
    "decode_base64": ("s STRING", "STRING", _decoded(r"rlike(s, r'^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z') AND octet_length(s) >= 16", "try_to_binary(s, 'base64')")),
    "decode_base64url": ("s STRING", "STRING", _decoded(r"rlike(s, r'^(?:[A-Za-z0-9_-]{4})*(?:[A-Za-z0-9_-]{2}==|[A-Za-z0-9_-]{3}=)?\z') AND octet_length(s) >= 16", "try_to_binary(translate(s, '-_', '+/'), 'base64')")),
    "decode_hex": ("s STRING", "STRING", _decoded(r"rlike(s, r'^(?:[0-9A-Fa-f]{2}){16,}\z')", "try_to_binary(s, 'hex')")),
    "decode_percent": ("s STRING", "STRING", r"CASE WHEN contains(s, '%') AND rlike(s, r'^(?:[^%]|%[0-9A-Fa-f]{2})*\z') AND try_url_decode(s) <> s THEN try_url_decode(s) END"),
}

def _entropy(text: str) -> str:
    """The expression of ``entropy`` for another one."""
    return SCALAR["entropy"][2].replace("(s)", f"({text})").replace("(s,", f"({text},")


_CHECKS = {
    "size(a.commits) > 0": "(array_contains(a.commits, coalesce(commit, '')) OR (length(coalesce(commit, '')) >= 7 AND array_contains(a.commits, substring(commit, 1, 7))))",
    "size(a.paths) > 0": "exists(a.paths, p -> rlike(path, p))",
    "size(a.regexes) > 0": "exists(a.regexes, p -> rlike(CASE a.target WHEN 'match' THEN y.found WHEN 'line' THEN {line} ELSE y.secret END, p))",
    "size(a.stop_words) > 0": "exists(a.stop_words, w -> contains(lower(y.secret), w))",
}
_ANY = " OR ".join(f"({has} AND {ok})" for has, ok in _CHECKS.items())
_ALL = "(" + " OR ".join(_CHECKS) + ") AND " + " AND ".join(f"(NOT ({has}) OR {ok})" for has, ok in _CHECKS.items())
#: Whether a match y = (r, nth, found, secret) stands: entropy and the rule's allowlists; ``{line}`` is what they see as the line.
_STANDS = f"(y.r.min_entropy <= 0 OR {_entropy('y.secret')} >= y.r.min_entropy) AND NOT exists(y.r.allow, a -> CASE WHEN a.is_and THEN {_ALL} ELSE {_ANY} END)"
_LINES = r"split(text, r'\n', -1)"


def literal(value) -> str:
    """A value of a rule as a SQL literal."""
    if value is None:
        return "CAST(NULL AS STRING)"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r") + "'"
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, list):
        return f"CAST(array({', '.join(map(literal, value))}) AS ARRAY<STRING>)"
    return str(value)


def _rules(rs: RuleSet) -> str:
    """The rules as an array of structs, in order."""
    rows = []
    for row in rs.rows():
        _, rule_id, _, regex, grp, least, path_regex, _, tags, allow, _ = row
        lists = ", ".join(
            f"named_struct('paths', {literal(p)}, 'regexes', {literal(r)}, 'commits', {literal(c)}, 'stop_words', {literal(w)}, 'target', {literal(t)}, 'is_and', {literal(a)})" for p, r, c, w, t, a in allow
        )
        kind = "ARRAY<STRUCT<paths: ARRAY<STRING>, regexes: ARRAY<STRING>, commits: ARRAY<STRING>, stop_words: ARRAY<STRING>, target: STRING, is_and: BOOLEAN>>"
        rows.append(f"named_struct('rule_id', {literal(rule_id)}, 'regex', {literal(regex)}, 'grp', {grp}, 'min_entropy', {literal(least)}, 'path_regex', {literal(path_regex)}, 'tags', {literal(tags)}, 'allow', CAST(array({lists}) AS {kind}))")
    return f"array({', '.join(rows)})"


def _row_functions(prefix: str, rules: str) -> dict[str, tuple[str, str, str]]:
    here = lambda text: f"filter(transform({prefix}candidates({text}), k -> element_at({rules}, k + 1)), r -> (r.path_regex IS NULL OR rlike(path, r.path_regex)) AND rlike({text}, r.regex))"
    start = "octet_length(substring_index(line, y.found, 1))"
    first = f"transform({here('line')}, r -> named_struct('r', r, 'nth', 0, 'found', regexp_extract(line, r.regex, 0), 'secret', regexp_extract(line, r.regex, r.grp)))"
    part = "element_at(regexp_extract_all(text, r.regex, r.grp), i + 1)"
    every = f"filter(flatten(transform({here('text')}, r -> transform(regexp_extract_all(text, r.regex, 0), (m, i) -> named_struct('r', r, 'nth', i, 'found', m, 'secret', CASE WHEN {part} = '' THEN m ELSE {part} END)))), y -> y.found <> '')"
    return {
        "lines": ("text STRING", "ARRAY<STRUCT<line_no: INT, line: STRING>>", rf"transform(CASE WHEN element_at({_LINES}, -1) = '' THEN slice({_LINES}, 1, size({_LINES}) - 1) ELSE {_LINES} END, (x, i) -> named_struct('line_no', i + 1, 'line', regexp_replace(x, r'\r\z', '')))"),
        "match": (
            "line STRING, path STRING, commit STRING",
            "ARRAY<STRUCT<rule_id: STRING, start_column: INT, end_column: INT, found: STRING, secret: STRING, entropy: DOUBLE, tags: ARRAY<STRING>>>",
            f"transform(filter({first}, y -> NOT contains(line, '{ALLOW_MARKER}') AND {_STANDS.replace('{line}', 'line')}), y -> named_struct('rule_id', y.r.rule_id, 'start_column', {start} + 1, 'end_column', {start} + octet_length(y.found), 'found', y.found, 'secret', y.secret, 'entropy', {_entropy('y.secret')}, 'tags', y.r.tags))",
        ),
        "match_all": (
            "text STRING, path STRING, commit STRING",
            "ARRAY<STRUCT<rule_id: STRING, nth: INT, found: STRING, secret: STRING, entropy: DOUBLE, tags: ARRAY<STRING>>>",
            f"transform(filter({every}, y -> {_STANDS.replace('{line}', 'y.found')}), y -> named_struct('rule_id', y.r.rule_id, 'nth', y.nth, 'found', y.found, 'secret', y.secret, 'entropy', {_entropy('y.secret')}, 'tags', y.r.tags))",
        ),
    }


def register(spark: SparkSession, rs: RuleSet, prefix: str = "scan_", max_depth: int = 3) -> list[str]:
    """Create the functions for this session; their names. ``<prefix>decode(value)`` and ``<prefix>candidates(text)`` are vectorised."""
    build = candidate_lookup(rs)

    def candidates(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        look = build()
        for texts in batches:
            yield texts.map(lambda x: [] if x is None else look(x))

    spark.udf.register(f"{prefix}candidates", F.pandas_udf(candidates, "array<int>"))
    spark.udf.register(f"{prefix}decode", decode_all(max_depth))
    rows = _row_functions(prefix, _rules(rs))
    for name, (parameters, kind, body) in (SCALAR | rows).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {kind} RETURN {body}")
    return [prefix + n for n in (*SCALAR, *rows, "candidates", "decode")]


def diff_view(spark: SparkSession, patches: str, name: str) -> None:
    """A view of the added lines of a view of patches (patch_id, seq, line)."""
    from lanternscan.operators.diffs import added_lines

    added_lines(spark.table(patches)).createOrReplaceTempView(name)
