"""Registered queries over the given tables, each with a DuckDB counterpart where SQL can express it.

Many tables hold few secrets, so most queries read the documents with one more line each, derived from the row's id (SPIKED).
DuckDB runs the original patterns with its own engine of their dialect; Spark runs the translated ones.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanternscan.functions import sql
from lanternscan.functions import text as T
from lanternscan.functions.decode import decode_all, decode_tags
from lanternscan.operators.blocks import scan_blocks
from lanternscan.operators.buffers import STEP, WINDOW, first_hits, scan_buffers, window_hits, window_offsets, windows
from lanternscan.operators.candidates import candidate_rules, with_candidates
from lanternscan.operators.diffs import added_lines
from lanternscan.operators.findings import add_decoded_tags, in_order, limit_findings, redact, rule_summary, subtract, union_sources
from lanternscan.operators.lines import match_rules, scan_lines, split_lines
from lanternscan.plans.config import parse as parse_config
from lanternscan.plans.ruleset import RuleSet
from lanternscan.plans.scan import compile_rules
from lanternscan.rules.model import Allowlist, Required, Rule
from lanternscan.rules.samples import samples
from lanternscan.schema import walk_key
from lanternscan.sinks import reports
from lanternscan.sources.archives import archive_lines, zip_lines
from lanternscan.sources.blocks import BlockSource, open_path
from lanternscan.sources.files import qualified, read_baseline, read_ignore_list, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str | Callable[[], str]] = {}

# ---------------------------------------------------------------- corpora

MARKER = T.ALLOW_MARKER
_PATH = "concat(source, '/', cast(doc_id AS {string}), CASE doc_id % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.env' WHEN 2 THEN '.json' WHEN 3 THEN '_test.py' ELSE '.yaml' END)"
_SPIKE = f"""CASE doc_id % 12
WHEN 0 THEN 'key AKIA' || upper(substr(h, 1, 16)) || ' end'
WHEN 1 THEN 'use ghp_' || substr(h, 1, 36)
WHEN 2 THEN 'api_key = "' || substr(h, 1, 32) || '"'
WHEN 3 THEN 'password = "example' || substr(h, 1, 12) || '"'
WHEN 4 THEN 'heroku_api_key: ' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)
WHEN 5 THEN 'api_key = "' || substr(h, 1, 32) || '" # {MARKER}'
WHEN 6 THEN 'db postgres://u' || substr(h, 1, 6) || ':' || substr(h, 7, 12) || '@db.example.org/x'
WHEN 7 THEN 'secret = "' || {{base64}} || '"'
WHEN 8 THEN '-----BEGIN RSA PRIVATE KEY-----'
WHEN 9 THEN 'bot xoxb-1234567890-1234567890' || substr(h, 1, 8)
WHEN 10 THEN 'export MY_TOKEN=' || substr(h, 1, 20)
ELSE 'auth_token = "' || substr(h, 1, 24) || '" and password = "' || substr(h, 30, 14) || '"' END"""
_HIDDEN = "'key AKIA' || upper(substr(h, 1, 16))"
_DUCK_SPIKE = _SPIKE.format(base64=f"to_base64(encode({_HIDDEN}))")
_COMMIT = "substr(h, 1, 40)"

#: CTE of the DuckDB side: spiked(doc_id, path, h, text).
SPIKED = f"""spiked AS (SELECT doc_id, path, h, coalesce(text, '') || chr(10) || {_DUCK_SPIKE} AS text
FROM (SELECT doc_id, text, {_PATH.format(string='VARCHAR')} AS path, sha256(cast(doc_id AS VARCHAR)) AS h FROM documents))"""
LINES = r"""lines AS (SELECT doc_id, path, h, i AS line_no, regexp_replace(ls[i], '\r$', '') AS line FROM (SELECT doc_id, path, h, ls, unnest(range(1, len(ls) + 1)) AS i
FROM (SELECT doc_id, path, h, CASE WHEN l[len(l)] = '' THEN l[1:len(l) - 1] ELSE l END AS ls FROM (SELECT doc_id, path, h, string_split(text, chr(10)) AS l FROM spiked))))"""


def spiked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = docs.select("doc_id", "text", F.expr(_PATH.format(string="STRING")).alias("path"), F.sha2(F.col("doc_id").cast("string"), 256).alias("h"))
    spike = F.expr(_SPIKE.format(base64=f"base64(cast({_HIDDEN} AS BINARY))"))
    return base.select("doc_id", "path", "h", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), spike).alias("text"))


def spiked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_lines(spiked(spark, sf_dir))


def quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def rules_cte(rs: RuleSet) -> str:
    """rules(...) with the patterns as they were written; at most one allowlist check of each kind per rule is used here."""
    rows = []
    for k, r in enumerate(rs.rules):
        stops = [w.lower() for a in r.allowlists for w in a.stop_words]
        paths = [p for a in r.allowlists for p in a.paths]
        strings = lambda xs: "[" + ", ".join(map(quote, xs)) + "]::VARCHAR[]"
        path = quote(r.path) if r.path else "NULL"
        rows.append(f"({k}, {quote(r.id)}, {quote(r.description)}, {quote(r.regex)}, {r.secret_group}, {r.entropy}, {path}, {strings([w.lower() for w in r.keywords])}, {strings(stops)}, {strings(paths)}, {strings(r.tags)})")
    return "rules(rule_ord, rule_id, description, regex, grp, min_entropy, path_regex, keywords, stops, allow_paths, tags) AS (VALUES " + ", ".join(rows) + ")"


_GROUP = "CASE grp WHEN 0 THEN regexp_extract({0}, regex, 0) WHEN 1 THEN regexp_extract({0}, regex, 1) ELSE regexp_extract({0}, regex, 2) END"
ENTROPY = "coalesce(list_aggregate(string_split({0}, ''), 'entropy'), 0)"
_KEYWORD = "(len(keywords) = 0 OR len(list_filter(keywords, lambda k: contains(lower({0}), k))) > 0)"
MATCHED = f"""matched AS (SELECT *, regexp_extract(line, regex, 0) AS full_match, {_GROUP.format('line')} AS secret FROM lines, rules
WHERE CASE WHEN (path_regex IS NULL OR regexp_matches(path, path_regex)) AND {_KEYWORD.format('line')} THEN regexp_matches(line, regex) ELSE false END),
scored AS (SELECT *, {ENTROPY.format('secret')} AS entropy FROM matched)"""
_STOPPED = "len(list_filter(stops, lambda w: contains(lower(secret), w))) > 0"
_PATHED = "len(list_filter(allow_paths, lambda p: regexp_matches(path, p))) > 0"
FOUND = f"""found AS (SELECT *, octet_length(encode(string_split(line, full_match)[1])) AS before FROM scored
WHERE NOT contains(line, '{MARKER}') AND (min_entropy <= 0 OR entropy >= min_entropy) AND NOT ({_STOPPED}) AND NOT ({_PATHED}))"""
_FP = "'0000000:' || path || ':' || rule_id || ':' || line_no"


def with_rules(rs: RuleSet, tail: str, found: bool = True) -> str:
    return f"WITH {SPIKED}, {LINES}, {rules_cte(rs)}, {MATCHED}{', ' + FOUND if found else ''} {tail}"


def query(name: str, oracle: str | Callable[[], str] | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


# ---------------------------------------------------------------- rules

BUILTIN = RuleSet.compile()
TOKEN = Rule(id="corpus-token", description="Token", regex=r'token\s*=\s*"([0-9a-f]{40})"', secret_group=1, entropy=3.0, keywords=("token",), tags=("corpus",))
KEYED = RuleSet.compile([TOKEN]).only("corpus-token", "aws-access-key-id", "github-pat", "generic-api-key", "heroku-api-key", "generic-token-assignment", "generic-password-assignment")
FINDING_SQL = f"SELECT rule_id, path AS file, CAST(line_no AS INTEGER) AS start_line, CAST(before + 1 AS INTEGER) AS start_column, CAST(before + octet_length(encode(full_match)) AS INTEGER) AS end_column, secret, round(entropy, 6) AS entropy, {_FP} AS fingerprint FROM found"


def brief(findings: DataFrame) -> DataFrame:
    return findings.select("rule_id", "file", "start_line", "start_column", "end_column", "secret", F.round("entropy", 6).alias("entropy"), "fingerprint")


@query("scan_lines_first_match", with_rules(BUILTIN, FINDING_SQL))
def scan_lines_first_match(spark, d):
    """All built-in rules over all lines: the first match of each rule on a line."""
    return brief(scan_lines(spiked_lines(spark, d), BUILTIN))


@query("scan_custom_rules", with_rules(KEYED, FINDING_SQL))
def scan_custom_rules(spark, d):
    return brief(scan_lines(spiked_lines(spark, d), KEYED))


@query("keyword_prefilter", f"WITH {SPIKED}, {LINES}, {rules_cte(BUILTIN)} SELECT rule_id, count(*) AS n_lines FROM lines, rules WHERE {_KEYWORD.format('line')} GROUP BY rule_id")
def keyword_prefilter(spark, d):
    """Lines per rule that hold one of its keywords."""
    pairs = with_candidates(spiked_lines(spark, d), "line", BUILTIN).select(F.explode("rule_ords").alias("rule_ord"))
    return pairs.join(BUILTIN.table(spark), "rule_ord").groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_lines"))


@query("path_filter", f"WITH {SPIKED}, {rules_cte(BUILTIN)} SELECT rule_id, count(*) AS n_paths FROM spiked, rules WHERE path_regex IS NOT NULL AND regexp_matches(path, path_regex) GROUP BY rule_id")
def path_filter(spark, d):
    rules = BUILTIN.table(spark).filter(F.col("path_regex").isNotNull())
    return spiked(spark, d).join(rules, F.rlike(F.col("path"), F.col("path_regex"))).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_paths"))


@query("secret_group", with_rules(BUILTIN, "SELECT rule_id, path AS file, CAST(line_no AS INTEGER) AS line_no, full_match, secret FROM matched", found=False))
def secret_group(spark, d):
    """The whole match and the captured secret, before any filter on them."""
    pairs = candidate_rules(spiked_lines(spark, d), "line", BUILTIN)
    return pairs.select("rule_id", F.col("path").alias("file"), "line_no", F.expr("regexp_extract(line, regex, 0)").alias("full_match"), F.expr("regexp_extract(line, regex, grp)").alias("secret"))


@query("entropy_score", f"WITH {SPIKED}, {LINES} SELECT doc_id, count(*) AS n_lines, round(max({ENTROPY.format('line')}), 6) AS max_entropy FROM lines GROUP BY doc_id")
def entropy_score(spark, d):
    """Most bits per character of any line of a document."""
    rows = spiked_lines(spark, d).withColumn("e", T.text_entropy()("line"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.max("e"), 6).alias("max_entropy"))


@query("entropy_filter", with_rules(BUILTIN, "SELECT rule_id, count(*) AS n_matched, count(*) FILTER (min_entropy <= 0 OR entropy >= min_entropy) AS n_kept FROM scored GROUP BY rule_id", found=False))
def entropy_filter(spark, d):
    pairs = candidate_rules(spiked_lines(spark, d), "line", BUILTIN).withColumn("e", T.shannon_entropy(F.expr("regexp_extract(line, regex, grp)")))
    kept = (F.col("min_entropy") <= 0) | (F.col("e") >= F.col("min_entropy"))
    return pairs.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_matched"), F.count(F.when(kept, 1)).alias("n_kept"))


def _sampled_sql() -> str:
    rows = ", ".join(f"({k}, {quote(p)}, {quote(line)})" for k, _, p, line in samples())
    docs = f"spiked AS (SELECT doc_id, doc_id || '/' || p AS path, '' AS h, coalesce(text, '') || chr(10) || l AS text FROM documents JOIN (VALUES {rows}) AS s(k, p, l) ON doc_id % {len(samples())} = k)"
    return with_rules(BUILTIN, "SELECT rule_id, path AS file, CAST(line_no AS INTEGER) AS start_line, secret FROM found").replace(SPIKED, docs)


@query("builtin_samples", _sampled_sql)
def builtin_samples(spark, d):
    """The documents, each with a made-up credential of one built-in rule after another."""
    table = spark.createDataFrame(samples(), "k int, id string, p string, l string")
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("k", (F.col("doc_id") % len(samples())).cast("int"))
    rows = docs.join(F.broadcast(table), "k").select(F.concat_ws("/", F.col("doc_id").cast("string"), "p").alias("path"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), "l").alias("text"))
    return scan_lines(split_lines(rows), BUILTIN).select("rule_id", "file", "start_line", "secret")


# ---------------------------------------------------------------- allowlists

PLAIN = RuleSet.compile().only("aws-access-key-id", "github-pat", "heroku-api-key", "postgresql-connection-string", "slack-bot-token")


def _allow_query(name: str, allow: Allowlist, condition: str) -> None:
    """Rules of PLAIN under one more allowlist; ``condition`` is what it suppresses, in SQL. Once as every rule's, once as a global one."""
    from dataclasses import replace

    tail = "SELECT rule_id, path AS file, CAST(line_no AS INTEGER) AS start_line, secret FROM found"
    own = RuleSet(tuple(replace(r, allowlists=(allow,)) for r in PLAIN.rules))
    for prefix, rs in (("allowlist", own), ("global_allowlist", RuleSet(PLAIN.rules, (allow,)))):
        query(f"{prefix}_{name}", with_rules(PLAIN, f"{tail} WHERE NOT ({condition})"))(
            lambda spark, d, rs=rs: scan_lines(spiked_lines(spark, d).withColumn("commit", F.substring("h", 1, 40)), rs).select("rule_id", "file", "start_line", "secret")
        )


_allow_query("stopwords", Allowlist(stop_words=("AB", "77")), "contains(lower(secret), 'ab') OR contains(secret, '77')")
_allow_query("regex_secret", Allowlist(regexes=("[0-4]$",)), "regexp_matches(secret, '[0-4]$')")
_allow_query("regex_match", Allowlist(regexes=(r"key.*[a-f]\b",), regex_target="match"), r"regexp_matches(full_match, 'key.*[a-f]\b')")
_allow_query("regex_line", Allowlist(regexes=(r"\bend$", r"^db\s"), regex_target="line"), r"regexp_matches(line, '\bend$') OR regexp_matches(line, '^db\s')")
_allow_query("paths", Allowlist(paths=(r"\.env$", "^src1/")), r"regexp_matches(path, '\.env$') OR regexp_matches(path, '^src1/')")
_allow_query("and", Allowlist(paths=(r"\.(env|txt)$",), stop_words=("a",), condition="and"), r"regexp_matches(path, '\.(env|txt)$') AND contains(lower(secret), 'a')")
_allow_query("or", Allowlist(paths=(r"\.json$",), regexes=("f",), condition="OR"), r"regexp_matches(path, '\.json$') OR regexp_matches(secret, 'f')")
_COMMITS = ("5feceb66ffc86f38d952786c6d696c79c2dbc239", "6b86b27", "4b22777")  # of the ids 0, 1 and 4
_allow_query("commits", Allowlist(commits=_COMMITS), f"{_COMMIT} IN {_COMMITS} OR substr(h, 1, 7) IN {_COMMITS}")


@query("inline_allow", with_rules(KEYED, f"SELECT rule_id, count(*) AS n_matched, count(*) FILTER (NOT contains(line, '{MARKER}')) AS n_shown FROM scored GROUP BY rule_id", found=False))
def inline_allow(spark, d):
    pairs = match_rules(spiked_lines(spark, d), RuleSet(tuple(r.__class__(**{**r.__dict__, "entropy": 0.0}) for r in KEYED.rules)))
    return pairs.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_matched"), F.count(F.when(~T.has_allow_marker("line"), 1)).alias("n_shown"))


EXCLUDED = ["src1", "*.env", "src2/*", "src3/?*5.json", "src[4-6]/*_test.py"]


@query("exclude_paths", rf"WITH {SPIKED} SELECT path, starts_with(path, 'src1') OR regexp_matches(path, '\.env$') OR regexp_matches(path, '^src2/[^/]*$') OR regexp_matches(path, '^src3/[^/][^/]*5\.json$') OR regexp_matches(path, '^src[4-6]/[^/]*_test\.py$') AS excluded FROM spiked")
def exclude_paths(spark, d):
    return spiked(spark, d).select("path", T.excluded_path("path", EXCLUDED).alias("excluded"))


@query("exclude_commits", f"WITH {SPIKED} SELECT doc_id, starts_with({_COMMIT}, '6b86b27') OR starts_with({_COMMIT}, 'd4735e3a265e16ee') OR starts_with('{'5feceb66ffc86f38d952786c6d696c79c2dbc239'}00', {_COMMIT}) AS excluded FROM spiked")
def exclude_commits(spark, d):
    return spiked(spark, d).select("doc_id", T.excluded_commit(F.substring("h", 1, 40), ["6b86b27", "d4735e3a265e16ee", _COMMITS[0] + "00"]).alias("excluded"))


# ---------------------------------------------------------------- whole contents

#: CTEs of the DuckDB side: contents as bytes, their windows cut to whole characters, and every match with its byte offset.
BYTES = "bytes AS (SELECT doc_id, path, h, text, encode(text) AS data, strlen(text) AS size FROM spiked)"
WINDOWS_SQL = f"""cuts AS (SELECT *, hex(data[off + 1:off + {WINDOW}]) AS x, row_number() OVER (PARTITION BY path ORDER BY off) - 1 AS win
FROM (SELECT *, unnest(range(0, CASE WHEN size <= {WINDOW} THEN 1 ELSE CAST(ceil((size - {WINDOW}) / {STEP}.0) AS BIGINT) * {STEP} + 1 END, {STEP})) AS off FROM bytes WHERE size > 0)),
heads AS (SELECT *, CASE WHEN off > 0 THEN regexp_replace(x, '^([89AB].){{1,3}}', '') ELSE x END AS y FROM cuts),
tails AS (SELECT *, coalesce(nullif(regexp_extract(y, '^((?:..)*?)(?:[CD].|E.(?:[89AB].)?|F.(?:[89AB].){{0,2}})$', 1), ''), y) AS z FROM heads),
wins AS (SELECT doc_id, path, text, data, size, off, win, off + (length(x) - length(y)) // 2 AS base, decode(from_hex(z)) AS body FROM tails)"""


def contents(spark, d) -> DataFrame:
    return spiked(spark, d).select("doc_id", "path", "h", F.col("text").alias("content"))


_BUF = """hits AS (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM (SELECT wins.*, rules.*, regexp_extract_all(body, regex, 0) AS ms,
CASE grp WHEN 0 THEN regexp_extract_all(body, regex, 0) WHEN 1 THEN regexp_extract_all(body, regex, 1) ELSE regexp_extract_all(body, regex, 2) END AS ss, string_split_regex(body, regex) AS gs
FROM wins, rules WHERE CASE WHEN (path_regex IS NULL OR regexp_matches(path, path_regex)) AND {kw} THEN regexp_matches(body, regex) ELSE false END)),
places AS (SELECT *, ms[k] AS match, CASE WHEN ss[k] = '' THEN ms[k] ELSE ss[k] END AS secret, base + list_sum(list_transform(gs[1:k], lambda x: strlen(x))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: strlen(x))), 0) AS pos FROM hits),
kept AS (SELECT *, decode(data[1:CAST(pos AS BIGINT)]) AS pre, {ent} AS entropy FROM places),
lined AS (SELECT *, 1 + length(pre) - length(replace(pre, chr(10), '')) AS start_line, strlen(string_split(pre, chr(10))[-1]) + 1 AS start_column,
  string_split(text, chr(10))[1 + length(pre) - length(replace(pre, chr(10), ''))] AS line FROM kept),
ok AS (SELECT * FROM lined WHERE (min_entropy <= 0 OR entropy >= min_entropy) AND NOT ({stop}) AND NOT ({pathed}) AND NOT contains(line, '{marker}')),
firsts AS (SELECT *, row_number() OVER (PARTITION BY path, rule_id, pos ORDER BY win) AS n FROM ok)""".format(
    kw=_KEYWORD.format("body"), ent=ENTROPY.format("secret"), stop=_STOPPED, pathed=_PATHED, marker=MARKER
)


@query("scan_buffer_all_matches", f"WITH {SPIKED}, {BYTES}, {WINDOWS_SQL}, {rules_cte(BUILTIN)}, {_BUF} SELECT rule_id, path AS file, CAST(start_line AS INTEGER) AS start_line, CAST(start_column AS INTEGER) AS start_column, match, secret FROM firsts WHERE n = 1")
def scan_buffer_all_matches(spark, d):
    """All built-in rules over whole contents in overlapping windows, every match once."""
    return scan_buffers(contents(spark, d), BUILTIN).select("rule_id", "file", "start_line", "start_column", "match", "secret")


@query("window_offsets", f"WITH {SPIKED}, {BYTES}, {WINDOWS_SQL} SELECT path, CAST(base AS BIGINT) AS base, CAST(strlen(body) AS BIGINT) AS n, CAST(size AS BIGINT) AS size, CAST(off AS BIGINT) AS off FROM wins")
def window_offsets_query(spark, d):
    """Where windows begin, and what is left of them when they are cut to whole characters."""
    c = contents(spark, d)
    offsets = c.select("path", F.octet_length("content").cast("long").alias("size"), F.posexplode(window_offsets(F.octet_length("content"))).alias("win", "off"))
    cut = windows(c).select("path", "win", "base", F.octet_length("body").cast("long").alias("n"))
    return offsets.join(cut, ["path", "win"]).select("path", "base", "n", "size", "off")


@query("window_dedup", f"WITH {SPIKED}, {BYTES}, {WINDOWS_SQL}, {rules_cte(KEYED)}, {_BUF} SELECT rule_id, count(*) AS n_hits, count(*) FILTER (n = 1) AS n_first FROM firsts GROUP BY rule_id")
def window_dedup(spark, d):
    """Matches in all windows, and without those that two windows share."""
    hits = window_hits(contents(spark, d), KEYED)
    every = hits.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_hits"))
    return every.join(first_hits(hits).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_first")), "rule_id")


#: Everything on one line, a global allowlist that looks at that line, and a rule with a required pattern on it.
_LONG = f"long AS (SELECT doc_id, path, h, replace(text, chr(10), ' ') AS text FROM spiked)"
LONG_LINE = RuleSet((*KEYED.rules, Rule(id="near-key", regex=r"AKIA[0-9A-F]{16}", keywords=("akia",), required=(Required("key", r"\bkey\b", 1),))), (Allowlist(regexes=("7f\"? *$", "ab$"), regex_target="line"),))
_LONG_BUF = _BUF.replace("string_split(text, chr(10))[1 + length(pre) - length(replace(pre, chr(10), ''))]", "text")
_LONG_OK = "NOT regexp_matches(text, '7f\"? *$') AND NOT regexp_matches(text, 'ab$') AND (rule_id <> 'near-key' OR regexp_matches(text, '\\bkey\\b'))"


@query("window_long_line", f"WITH {SPIKED}, {_LONG}, {BYTES.replace('FROM spiked', 'FROM long')}, {WINDOWS_SQL}, {rules_cte(LONG_LINE)}, {_LONG_BUF} SELECT rule_id, path AS file, CAST(start_line AS INTEGER) AS start_line, CAST(start_column AS INTEGER) AS start_column, match FROM firsts WHERE n = 1 AND {_LONG_OK}")
def window_long_line(spark, d):
    """Contents of one line each, which reaches through all their windows."""
    one = contents(spark, d).withColumn("content", F.replace("content", F.lit("\n"), F.lit(" ")))
    return scan_buffers(one, LONG_LINE).select("rule_id", "file", "start_line", "start_column", "match")


@query("line_col", f"WITH {SPIKED} SELECT path, CAST(1 + length(pre) - length(replace(pre, chr(10), '')) AS INTEGER) AS line, CAST(strlen(string_split(pre, chr(10))[-1]) + 1 AS INTEGER) AS col FROM (SELECT path, text[1:length(text) // 2] AS pre FROM spiked)")
def line_col_query(spark, d):
    """Line and byte column of the middle character of each content, natively."""
    pre = F.substr("content", F.lit(1), F.floor(F.length("content") / 2).cast("int"))
    parts = F.split(pre, "\n", -1)
    return contents(spark, d).select("path", F.size(parts).alias("line"), (F.octet_length(F.element_at(parts, -1)) + 1).alias("col"))


NEAR = Rule(id="near", regex=r"AKIA[0-9A-F]{16}", keywords=("akia",), required=(Required("the", r"\bthe\b", 1),))
NEAR_COLUMNS = Rule(id="near", regex=r"AKIA[0-9A-F]{16}", keywords=("akia",), required=(Required("end", r"\bend\b", 0, 30), Required("key", "key", 1, 5)))
_NEAR_SQL = "SELECT l.path AS file, CAST(l.line_no AS INTEGER) AS start_line FROM (SELECT *, strpos(line, 'AKIA') - 1 AS c FROM lines) l WHERE regexp_matches(l.line, 'AKIA[0-9A-F]{{16}}') AND {0}"


@query("proximity", f"WITH {SPIKED}, {LINES} " + _NEAR_SQL.format(r"EXISTS (SELECT 1 FROM lines q WHERE q.path = l.path AND abs(q.line_no - l.line_no) <= 1 AND regexp_matches(q.line, '\bthe\b'))"))
def proximity(spark, d):
    return scan_buffers(spiked(spark, d).select("path", F.col("text").alias("content")), RuleSet((NEAR,))).select("file", "start_line")


@query("proximity_columns", f"WITH {SPIKED}, {LINES} " + _NEAR_SQL.format(
    r"EXISTS (SELECT 1 FROM lines q WHERE q.path = l.path AND abs(q.line_no - l.line_no) <= 1 AND regexp_matches(q.line, '\bend\b') AND (q.line_no <> l.line_no OR abs(length(string_split_regex(q.line, '\bend\b')[1]) - l.c) <= 30))"
    " AND EXISTS (SELECT 1 FROM lines q WHERE q.path = l.path AND abs(q.line_no - l.line_no) <= 1 AND contains(q.line, 'key') AND (q.line_no <> l.line_no OR abs(strpos(q.line, 'key') - 1 - l.c) <= 5))"))
def proximity_columns(spark, d):
    return scan_buffers(spiked(spark, d).select("path", F.col("text").alias("content")), RuleSet((NEAR_COLUMNS,))).select("file", "start_line")


# ---------------------------------------------------------------- after the scan

@query("fingerprint", with_rules(KEYED, f"SELECT {_COMMIT} || ':' || path || ':' || rule_id || ':' || line_no AS with_commit, {_FP} AS without FROM found"))
def fingerprint(spark, d):
    found = scan_lines(spiked_lines(spark, d).withColumn("commit", F.substring("h", 1, 40)), KEYED)
    return found.select(F.col("fingerprint").alias("with_commit"), T.fingerprint(F.lit(""), "file", "rule_id", "start_line").alias("without"))


def _known(findings: DataFrame) -> DataFrame:
    return findings.filter(F.col("rule_id").isin("github-pat", "generic-api-key"))


@query("baseline_anti", with_rules(KEYED, f"SELECT {_FP} AS fingerprint FROM found WHERE rule_id NOT IN ('github-pat', 'generic-api-key')"))
def baseline_anti(spark, d):
    """Findings that an earlier report (here of two rules) did not have."""
    found = scan_lines(spiked_lines(spark, d), KEYED)
    return subtract(found, _known(found)).select("fingerprint")


@query("ignore_anti", with_rules(KEYED, f"SELECT {_FP} AS fingerprint FROM found WHERE NOT regexp_matches(path, '[02468]\\.')"))
def ignore_anti(spark, d):
    found = scan_lines(spiked_lines(spark, d), KEYED)
    listed = found.filter(F.col("file").rlike(r"[02468]\.")).select(F.concat(F.lit("  "), "fingerprint").alias("value")).unionByName(
        spark.createDataFrame([("# comment",), ("",)], "value string"))
    ignore = listed.select(F.trim("value").alias("fingerprint")).filter("fingerprint <> '' AND NOT startswith(fingerprint, '#')")
    return subtract(found, ignore).select("fingerprint")


@query("redact_percent", with_rules(KEYED, "SELECT secret AS shown, substr(secret, 1, CAST(greatest(1, length(secret) * 30 // 100) AS INTEGER)) || '...' AS redacted, CASE WHEN secret = '' THEN '' ELSE 'REDACTED' END AS hidden FROM found"))
def redact_percent(spark, d):
    found = scan_lines(spiked_lines(spark, d), KEYED)
    both = found.select(F.col("secret").alias("shown"), T.redact_percent("secret", 30).alias("redacted"), T.redact_percent("secret", 0).alias("hidden"))
    return both


@query("redact_report", with_rules(KEYED, "SELECT rule_id, substr(secret, 1, CAST(greatest(1, length(secret) * 25 // 100) AS INTEGER)) || '...' AS match FROM found"))
def redact_report(spark, d):
    return redact(scan_lines(spiked_lines(spark, d), KEYED), 75).select("rule_id", "match")


@query("redact_headtail", with_rules(KEYED, "SELECT CASE WHEN length(secret) <= 4 THEN 'REDACTED' ELSE substr(secret, 1, 2) || '...' || right(secret, 2) END AS redacted FROM found"))
def redact_headtail(spark, d):
    return scan_lines(spiked_lines(spark, d), KEYED).select(T.redact_ends("secret").alias("redacted"))


@query("platform_link", f"WITH {SPIKED} SELECT 'https://github.com/o/r/blob/' || {_COMMIT} || '/' || path || '#L7' AS hub, 'https://gitlab.com/o/r/-/blob/' || {_COMMIT} || '/' || path || '#L7' AS lab, '' AS none FROM spiked")
def platform_link(spark, d):
    args = (F.lit("o"), F.lit("r"), F.substring("h", 1, 40), F.col("path"), F.lit(7))
    return spiked(spark, d).select(T.platform_link("GitHub", *args).alias("hub"), T.platform_link("gitlab", *args).alias("lab"), T.platform_link("x", *args).alias("none"))


@query("remote_parse", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN '' ELSE 'owner' || c_nationkey END AS owner, CASE WHEN c_custkey % 3 = 2 THEN '' ELSE 'sub/repo' || c_custkey END AS repo FROM customer")
def remote_parse(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    url = F.expr("CASE c_custkey % 3 WHEN 0 THEN concat('git@host:owner', c_nationkey, '/sub/repo', c_custkey, '.git') WHEN 1 THEN concat('https://host.org/owner', c_nationkey, '/sub/repo', c_custkey, '.git') ELSE concat('file:///x/', c_custkey) END")
    return c.select("c_custkey", T.parse_remote(url).alias("r")).select("c_custkey", "r.owner", "r.repo")


@query("author_parse", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE trim(c_name) END AS name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE lower(c_name) || '@example.org' END AS email FROM customer")
def author_parse(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    raw = F.expr("CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN concat(c_name, ' <', lower(c_name), '@example.org>') ELSE concat('  ', c_name, '   <', lower(c_name), '@example.org>') END")
    return c.select("c_custkey", T.parse_author(raw).alias("a")).select("c_custkey", "a.name", "a.email")


@query("hunk_numbers", "SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN o_custkey WHEN 1 THEN 1 ELSE 0 END AS INTEGER) AS start FROM orders")
def hunk_numbers(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    hunk = F.expr("CASE o_orderkey % 4 WHEN 0 THEN concat('@@ -3,7 +', o_custkey, ',9 @@ a +5') WHEN 1 THEN '@@ -0,0 +1 @@' WHEN 2 THEN '@@ -1 @@' ELSE '@@ -1 +99999999999999999999,2 @@' END")
    return o.select("o_orderkey", T.hunk_start(hunk).alias("start"))


# ---------------------------------------------------------------- diffs

def patches(spark, d) -> DataFrame:
    return patches_of(spiked(spark, d), F.col("path"))


def patches_of(docs: DataFrame, patch_id: Column) -> DataFrame:
    """Each document as a patch of one commit that adds its lines in one hunk, one context line before each tenth."""
    head = F.array(
        F.concat(F.lit("commit "), F.substring("h", 1, 40)), F.concat(F.lit("Author: Dev "), F.col("doc_id").cast("string"), F.lit(" <dev@example.org>")),
        F.lit("Date:   Mon Jan 5 10:00:00 2026 +0000"), F.lit(""), F.lit("    Add a"), F.lit("    text"), F.lit(""),
        F.concat(F.lit("diff --git a/"), "path", F.lit(" b/"), "path"), F.lit("--- /dev/null"), F.concat(F.lit("+++ b/"), "path"), F.lit("@@ -0,0 +5,9 @@"),
    )
    body = F.flatten(F.transform(F.split("text", "\n", -1), lambda x, i: F.when(i % 10 == 9, F.array(F.lit(" context"), F.lit("-gone"), F.concat(F.lit("+"), x))).otherwise(F.array(F.concat(F.lit("+"), x)))))
    return docs.select(patch_id.alias("patch_id"), F.posexplode(F.concat(head, body)).alias("seq", "line"))


_DIFF = f"WITH {SPIKED}, added AS (SELECT doc_id, path, h, ls[i] AS line, 4 + i + (i // 10) AS line_no FROM (SELECT doc_id, path, h, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM spiked) WHERE NOT starts_with(ls[i], '++'))"


@query("diff_parse", _DIFF + f" SELECT path, {_COMMIT} AS commit, 'Dev ' || doc_id AS author, 'dev@example.org' AS email, 'Add a text' AS message, count(*) AS n_lines, CAST(sum(line_no) AS BIGINT) AS line_sum, CAST(sum(length(line)) AS BIGINT) AS chars FROM added GROUP BY path, h, doc_id")
def diff_parse(spark, d):
    """Added lines with commit, author, message and line numbers, summed up per file."""
    rows = added_lines(patches(spark, d))
    return rows.groupBy("path", "commit", "author", "email", "message").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("line_no").alias("line_sum"), F.sum(F.length("line")).alias("chars"))


@query("history_distinct", _DIFF + f", lines AS (SELECT * FROM added), {rules_cte(KEYED)}, {MATCHED}, {FOUND} SELECT substr(sha256(h || copy), 1, 40) || ':' || path || ':' || rule_id || ':' || line_no AS fingerprint FROM found, (VALUES ('1'), ('2'), ('3')) AS c(copy)")
def history_distinct(spark, d):
    """A history in which every document is added in three commits: equal lines are matched once, and their findings belong to each commit."""
    docs = spiked(spark, d).withColumn("copy", F.explode(F.array(*map(F.lit, "123"))))
    again = docs.withColumn("h", F.sha2(F.concat("h", "copy"), 256))
    return scan_lines(added_lines(patches_of(again, F.concat("path", F.lit("@"), "copy"))), KEYED, by_content=True).select("fingerprint")


@query("diff_scan", _DIFF + f", lines AS (SELECT * FROM added WHERE NOT starts_with(path, 'src1') AND NOT starts_with(h, '4b22777')), {rules_cte(KEYED)}, {MATCHED}, {FOUND} SELECT {_COMMIT} || ':' || path || ':' || rule_id || ':' || line_no AS fingerprint, 'Dev ' || doc_id AS author FROM found")
def diff_scan(spark, d):
    return scan_lines(added_lines(patches(spark, d), ["src1"], ["4b22777"]), KEYED).select("fingerprint", "author")


# ---------------------------------------------------------------- decoding

def _encoded_sql(kind: str) -> str:
    plain = "'key=' || substr(h, 1, 20) || '/' || substr(h, 21, 7)"
    return {"base64": f"to_base64(encode({plain}))", "base64url": f"translate(to_base64(encode({plain})), '+/', '-_')", "hex": f"lower(hex(encode({plain})))", "percent": "replace(replace(" + plain + ", '=', '%3D'), '/', '+')"}[kind]


def _coded(kind: str):
    plain = F.expr("'key=' || substr(h, 1, 20) || '/' || substr(h, 21, 7)")
    if kind == "hex":
        return F.lower(F.hex(plain.cast("binary")))
    if kind == "percent":
        return F.replace(F.replace(plain, F.lit("="), F.lit("%3D")), F.lit("/"), F.lit("+"))
    coded = F.base64(plain.cast("binary"))
    return F.translate(coded, "+/", "-_") if kind == "base64url" else coded


def _decode_query(kind: str, decode) -> None:
    expect = f"'key=' || substr(h, 1, 20) || '{' ' if kind == 'percent' else '/'}' || substr(h, 21, 7)"
    sql = f"WITH {SPIKED} SELECT doc_id, {_encoded_sql(kind)} AS coded, {expect} AS value, CAST(NULL AS VARCHAR) AS broken FROM spiked"

    @query(f"decode_{kind}", sql)
    def decoded(spark, d):
        rows = spiked(spark, d).select("doc_id", _coded(kind).alias("coded"))
        return rows.select("doc_id", "coded", decode("coded").alias("value"), decode(F.concat("coded", F.lit("%"))).alias("broken"))


for _kind, _fn in (("base64", T.decode_base64), ("base64url", T.decode_base64url), ("hex", T.decode_hex), ("percent", T.decode_percent)):
    _decode_query(_kind, _fn)

SECRETS = RuleSet.compile().only("generic-secret-assignment", "aws-access-key-id")


@query("decode_tags", with_rules(SECRETS, "SELECT rule_id, path AS file, CASE WHEN rule_id = 'generic-secret-assignment' AND doc_id % 12 = 7 THEN array_to_string(list_concat(tags, ['decoded:base64']), ',') ELSE array_to_string(tags, ',') END AS tags FROM found"))
def decode_tags_query(spark, d):
    """Findings whose secret hides another one in base64."""
    found = add_decoded_tags(scan_lines(spiked_lines(spark, d), SECRETS), SECRETS, 2)
    return found.select("rule_id", "file", F.array_join("tags", ",").alias("tags"))


@query("decode_chain", f"WITH {SPIKED} SELECT doc_id, 'decoded:base64,decoded:percent,decode-depth:2' AS tags FROM spiked")
def decode_chain(spark, d):
    """Base64 around percent encoding: two steps of decoding, as tags."""
    coded = F.base64(F.concat(F.lit("a=%20+"), F.substring("h", 1, 18)).cast("binary"))
    rows = spiked(spark, d).select("doc_id", decode_all(2)(coded).alias("d"))
    return rows.select("doc_id", F.array_join(decode_tags("d"), ",").alias("tags"))


# ---------------------------------------------------------------- sources, limits, rule sets

@query("size_filter", f"WITH {SPIKED} SELECT path FROM spiked WHERE strlen(text) <= 2000")
def size_filter(spark, d):
    return spiked(spark, d).filter(F.octet_length("text") <= 2000).select("path")


@query("archive_member_safety", f"WITH {SPIKED} SELECT name, NOT starts_with(name, '/') AND NOT list_contains(string_split(replace(name, '\\', '/'), '/'), '..') AS safe FROM (SELECT CASE doc_id % 5 WHEN 0 THEN '/' || path WHEN 1 THEN '../' || path WHEN 2 THEN 'a\\..\\' || path WHEN 3 THEN 'a..b/' || path ELSE path END AS name FROM spiked)")
def archive_member_safety(spark, d):
    name = F.expr(r"CASE doc_id % 5 WHEN 0 THEN concat('/', path) WHEN 1 THEN concat('../', path) WHEN 2 THEN concat('a\\..\\', path) WHEN 3 THEN concat('a..b/', path) ELSE path END")
    return spiked(spark, d).select(name.alias("name")).select("name", T.safe_member("name").alias("safe"))


@query("archive_scan", with_rules(KEYED, "SELECT path || '.gz!' || regexp_extract(path, '[^/]*$') AS file, rule_id, CAST(line_no AS INTEGER) AS start_line FROM found"))
def archive_scan(spark, d):
    """Each spiked document packed by gzip, unpacked again and scanned line by line."""
    import gzip

    pack = F.pandas_udf(lambda texts: texts.map(lambda t: gzip.compress(t.encode(), 1)), "binary")

    files = spiked(spark, d).select(F.concat("path", F.lit(".gz")).alias("path"), pack("text").alias("content"))
    return scan_lines(archive_lines(files), KEYED).select("file", "rule_id", "start_line")


@query("archive_kinds", with_rules(KEYED, "SELECT path || CASE doc_id % 4 WHEN 0 THEN '.zip!in/a.txt' WHEN 1 THEN '.tar.gz!in/a.txt' WHEN 2 THEN '.bz2!' || regexp_extract(path, '[^/]*$') ELSE '.tar!in/a.txt' END AS file, rule_id, CAST(line_no AS INTEGER) AS start_line FROM found"))
def archive_kinds(spark, d):
    """Each spiked document packed as zip, tar, tar with gzip, or bzip2, beside a member whose name steps out of the archive."""
    import bz2
    import io
    import tarfile
    import zipfile

    suffixes = (".zip", ".tar.gz", ".bz2", ".tar")

    def pack(kind: int, data: bytes) -> bytes:
        out = io.BytesIO()
        if kind == 2:
            return bz2.compress(data, 1)
        if kind == 0:
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("../up.txt", data)
                z.writestr("in/a.txt", data)
        else:
            with tarfile.open(fileobj=out, mode="w:gz" if kind == 1 else "w") as t:
                for name in ("/abs.txt", "in/a.txt"):
                    info = tarfile.TarInfo(name)
                    info.size = len(data)
                    t.addfile(info, io.BytesIO(data))
        return out.getvalue()

    packed = F.pandas_udf(lambda ids, texts: ids.combine(texts, lambda k, t: pack(k % 4, t.encode())), "binary")
    path = F.concat("path", F.element_at(F.array(*map(F.lit, suffixes)), (F.col("doc_id") % 4 + 1).cast("int")))
    files = spiked(spark, d).select(path.alias("path"), packed("doc_id", "text").alias("content"))
    return scan_lines(archive_lines(files), KEYED).select("file", "rule_id", "start_line")


@query("zip_members", with_rules(KEYED, "SELECT path AS member, rule_id, CAST(line_no AS INTEGER) AS start_line FROM found"))
def zip_members_query(spark, d):
    """The spiked documents written into a few zip files, whose members are read by their ranges, each by any task."""
    import uuid
    import zipfile

    at = qualified(spark, f"{shared_folder(spark)}/zips-{uuid.uuid4().hex}")
    system, inner = open_path(at)
    system.create_dir(inner, recursive=True)

    def write(batches):
        import pyarrow as pa

        name = f"part-{uuid.uuid4().hex}.zip"
        system, inner = open_path(at)
        with system.open_output_stream(f"{inner}/{name}") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            for batch in batches:
                for path, text in zip(*[c.to_pylist() for c in batch.columns]):
                    z.writestr(path, text)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([f"{at}/{name}"])], names=["path", "real"])

    spiked(spark, d).select("path", "text").mapInArrow(write, "path string, real string").write.parquet(f"{at}/list")
    found = scan_lines(zip_lines(spark.read.parquet(f"{at}/list")), KEYED)
    return found.select(F.regexp_extract("file", "!(.*)$", 1).alias("member"), "rule_id", "start_line")


@query("source_union", with_rules(KEYED, "SELECT src_ord, rule_id, count(*) AS n FROM found, (VALUES (0), (1)) AS s(src_ord) WHERE src_ord = 0 OR rule_id <> 'github-pat' GROUP BY src_ord, rule_id"))
def source_union(spark, d):
    found = scan_lines(spiked_lines(spark, d), KEYED)
    both = union_sources([found, found.filter("rule_id <> 'github-pat'")])
    return both.groupBy("src_ord", "rule_id").agg(F.count(F.lit(1)).alias("n"))


_NESTED = "CASE doc_id % 3 WHEN 0 THEN path WHEN 1 THEN concat('deep/', cast(doc_id % 7 AS {string}), '/', path) ELSE regexp_replace(path, '^.*/', '') END"
#: At each depth files come first, by name, then folders, the last name first.
_WALK = ", ".join(f"len(p) > {k}, CASE WHEN len(p) > {k} THEN p[{k}] END DESC, CASE WHEN len(p) = {k} THEN p[{k}] END" for k in range(1, 6))


def nested_lines(spark, d) -> DataFrame:
    """The spiked lines with some paths deeper and some without a folder."""
    return split_lines(spiked(spark, d).withColumn("path", F.expr(_NESTED.format(string="STRING"))))


def _nested(tail: str) -> str:
    return with_rules(KEYED, tail).replace(LINES, LINES.replace("FROM spiked", f"FROM (SELECT doc_id, {_NESTED.format(string='VARCHAR')} AS path, h, text FROM spiked)"))


@query("max_findings", _nested(f"SELECT path AS file, CAST(line_no AS INTEGER) AS start_line, rule_id FROM (SELECT *, string_split(path, '/') AS p FROM found) ORDER BY {_WALK}, line_no, rule_ord LIMIT 25"))
def max_findings(spark, d):
    """The first findings in the order of a walk through the folders (the limit is the feature)."""
    return limit_findings(scan_lines(nested_lines(spark, d), KEYED), 25).select("file", "start_line", "rule_id")


@query("walk_order", _nested(f"SELECT path AS file, CAST(line_no AS INTEGER) AS start_line, rule_id, row_number() OVER (ORDER BY {_WALK}, line_no, rule_ord) AS nth FROM (SELECT *, string_split(path, '/') AS p FROM found)"))
def walk_order(spark, d):
    """All findings, numbered as a walk discovers them: numbers within the files, and how many findings the files before have."""
    found = scan_lines(nested_lines(spark, d), KEYED).withColumn("walk", walk_key("file"))
    inner = F.row_number().over(Window.partitionBy("walk").orderBy("place", "rule_ord"))
    return in_order(found.withColumn("inner", inner), "walk", "inner").select("file", "start_line", "rule_id", "nth")


@query("scan_summary", with_rules(BUILTIN, "SELECT rule_id, count(*) AS findings, count(DISTINCT path) AS files FROM found GROUP BY rule_id"))
def scan_summary(spark, d):
    return scan_lines(spiked_lines(spark, d), BUILTIN).groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("file").alias("files"))


ENABLED = RuleSet.compile(enabled=["github-pat", "heroku-api-key", "no-such-rule"])
DISABLED = RuleSet.compile([TOKEN], disabled=["corpus-token", "github-pat", "generic-api-key"])
OVERRIDE = RuleSet.compile([Rule(id="github-pat", description="own", regex=r"ghp_[0-9]+", keywords=("ghp_",)), TOKEN])
_COUNT = "SELECT rule_id, min(description) AS description, count(*) AS n FROM found GROUP BY rule_id"


def _counted(rs: RuleSet) -> Query:
    return lambda spark, d: scan_lines(spiked_lines(spark, d), rs).groupBy("rule_id").agg(F.min("description").alias("description"), F.count(F.lit(1)).alias("n"))


for _name, _rs in (("rules_enabled", ENABLED), ("rules_disabled", DISABLED), ("rule_override", OVERRIDE)):
    query(_name, with_rules(_rs, _COUNT))(_counted(_rs))


CONFIG = """
# rules of a team
extend:
  use_default: true
  disabled_rules: [generic-api-key, "github-pat"]
exclude_paths:
  - "src1"
  - '*.json'
exclude_commits: [6b86b273ff34fce19d6b804eff5a3f5747ada4ea]
allowlists:
  - description: no test values
    stop_words:
      - "00"
      - 'ff'
rules:
  # one of our own
  - id: corpus-token
    description: "Token"
    regex: 'token\\s*=\\s*"([0-9a-f]{40})"'
    secret_group: 1
    entropy: 3.0
    keywords: [token]
    tags:
      - corpus
  - id: heroku-api-key
    description: replaced
    regex: "heroku_api_key: [0-9a-f-]{36}"
    path: '\\.(txt|yaml)$'
    keywords: [heroku]
""".replace("\\\\", "\\")
_CONFIGURED = [TOKEN, Rule(id="heroku-api-key", description="replaced", regex="heroku_api_key: [0-9a-f-]{36}", path=r"\.(txt|yaml)$", keywords=("heroku",))]


@query("config_scan", with_rules(RuleSet.compile(_CONFIGURED, disabled=["generic-api-key", "github-pat"]), rf"SELECT rule_id, description, {_COMMIT} || ':' || path || ':' || rule_id || ':' || line_no AS fingerprint FROM found WHERE NOT (starts_with(path, 'src1') OR regexp_matches(path, '\.json$') OR starts_with(h, '6b86b273ff34fce19d6b804eff5a3f5747ada4ea') OR contains(lower(secret), '00') OR contains(lower(secret), 'ff'))"))
def config_scan(spark, d):
    """A scan as a configuration text asks for it: own, replaced and disabled rules, excluded paths and commits, an allowlist for all."""
    config = parse_config(CONFIG)
    lines = spiked_lines(spark, d).withColumn("commit", F.substring("h", 1, 40))
    lines = lines.filter(~T.excluded_path("path", config.exclude_paths) & ~T.excluded_commit("commit", config.exclude_commits))
    return scan_lines(lines, compile_rules(config, [])).select("rule_id", "description", "fingerprint")


@query("ignore_list", with_rules(KEYED, f"SELECT {_FP} AS fingerprint FROM found WHERE rule_id <> 'heroku-api-key'"))
def ignore_list(spark, d):
    """Findings without those of an ignore list, which is written as a text file with comments, blank and padded lines, and read as a source."""
    import uuid

    found = scan_lines(spiked_lines(spark, d), KEYED)
    at = f"{shared_folder(spark)}/ignore-{uuid.uuid4().hex}"
    listed = found.filter("rule_id = 'heroku-api-key'").select(F.explode(F.array(F.concat(F.lit("# "), "rule_id"), F.lit("  "), F.concat(F.lit("  "), "fingerprint", F.lit(" ")))).alias("value"))
    listed.write.text(at)
    return subtract(found, read_ignore_list(spark, at)).select("fingerprint")


@query("baseline_file", with_rules(KEYED, f"SELECT {_FP} AS fingerprint FROM found WHERE rule_id NOT IN ('github-pat', 'generic-api-key')"))
def baseline_file(spark, d):
    """Findings that an earlier report does not have, which is written as one JSON document by the tasks and read as a baseline."""
    import uuid

    found = scan_lines(spiked_lines(spark, d), KEYED)
    at = f"{shared_folder(spark)}/baseline-{uuid.uuid4().hex}.json"
    reports.write_document(_known(found), "json", at)
    return subtract(found, read_baseline(spark, at)).select("fingerprint")


# ---------------------------------------------------------------- reports

@query("rule_summary", with_rules(KEYED, "SELECT rule_id, description, count(*) AS findings FROM found GROUP BY rule_id, description"))
def rule_summary_query(spark, d):
    return rule_summary(scan_lines(spiked_lines(spark, d), KEYED)).select("rule_id", "description", "findings")


@query("junit_cases", with_rules(KEYED, "SELECT rule_id AS suite, path || ':' || line_no AS name, description AS message, 'Secret detected in ' || path || ' at line ' || line_no || ': ' || secret AS text FROM found"))
def junit_cases(spark, d):
    return reports.junit_rows(scan_lines(spiked_lines(spark, d), KEYED)).select("suite", "name", "message", "text")


@query("sarif_rules", with_rules(KEYED, "SELECT DISTINCT rule_id, description FROM found"))
def sarif_rules(spark, d):
    return reports.sarif_rules(scan_lines(spiked_lines(spark, d), KEYED)).select("rule_id", "description")


@query("sarif_results", with_rules(KEYED, f"SELECT rule_id, path AS uri, CAST(line_no AS INTEGER) AS line, {_FP} AS fingerprint FROM found"))
def sarif_results(spark, d):
    rows = reports.sarif_results(scan_lines(spiked_lines(spark, d), KEYED))
    place = F.col("locations")[0].physicalLocation
    return rows.select(F.col("ruleId").alias("rule_id"), place.artifactLocation.uri.alias("uri"), place.region.startLine.alias("line"), F.col("fingerprints")["fingerprint/v1"].alias("fingerprint"))


@query("sarif_document", with_rules(KEYED, f"SELECT rule_id, path AS uri, CAST(line_no AS BIGINT) AS line, {_FP} AS fingerprint FROM found"))
def sarif_document(spark, d):
    """A whole SARIF document, rendered by the tasks and joined to one file, read back as its results."""
    import uuid

    at = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}.sarif"
    reports.write_document(scan_lines(spiked_lines(spark, d), KEYED), "sarif", at)
    place = "struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: bigint>>>"
    read = spark.read.schema(f"runs array<struct<results: array<struct<ruleId: string, locations: array<{place}>, fingerprints: map<string, string>>>>>").json(at, multiLine=True)
    rows = read.select(F.explode(F.col("runs")[0].results).alias("r"))
    where = F.col("r.locations")[0].physicalLocation
    return rows.select(F.col("r.ruleId").alias("rule_id"), where.artifactLocation.uri.alias("uri"), where.region.startLine.alias("line"), F.col("r.fingerprints")["fingerprint/v1"].alias("fingerprint"))


TEMPLATE = '{{len .}} findings\n{{range .}}{{if eq .RuleID "github-pat"}}PAT{{else}}{{.RuleID}}{{end}} {{printf "%s:%04d" .File .StartLine}}{{range $i, $t := .Tags}}{{if $i}},{{else}} {{end}}{{$t}}{{end}}\n{{end}}end\n'


@query("template_report", with_rules(KEYED, "SELECT value FROM (SELECT CASE rule_id WHEN 'github-pat' THEN 'PAT' ELSE rule_id END || ' ' || path || ':' || lpad(CAST(line_no AS VARCHAR), 4, '0') || CASE WHEN len(tags) > 0 THEN ' ' || array_to_string(tags, ',') ELSE '' END AS value FROM found UNION ALL SELECT count(*) || ' findings' FROM found UNION ALL SELECT 'end')"))
def template_report(spark, d):
    """A report by a template with conditions, nested ranges and formats, applied in the tasks, line by line."""
    import uuid

    at = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}.txt"
    reports.write_document(scan_lines(spiked_lines(spark, d), KEYED), "template", at, TEMPLATE)
    return spark.read.text(at)


@query("csv_projection", with_rules(KEYED, f'SELECT rule_id AS "RuleID", description AS "Description", path AS "File", CAST(line_no AS VARCHAR) AS "StartLine", secret AS "Secret", \'\' AS "Commit", \'\' AS "Author", {_FP} AS "Fingerprint" FROM found'))
def csv_projection(spark, d):
    return reports.csv_rows(scan_lines(spiked_lines(spark, d), KEYED))


@query("json_report", with_rules(KEYED, f"SELECT rule_id, path AS file, CAST(line_no AS INTEGER) AS start_line, secret, {_FP} AS fingerprint FROM found"))
def json_report(spark, d):
    """The JSON report written row by row and read back."""
    rows = reports.json_rows(scan_lines(spiked_lines(spark, d), KEYED))
    parsed = rows.select(F.from_json("value", "rule_id string, file string, start_line int, secret string, fingerprint string").alias("j"))
    return parsed.select("j.*")


_FILED = SPIKED.replace(_PATH.format(string="VARCHAR"), "'part-' || doc_id || '.txt'")


@query("scan_file_blocks", f"WITH {_FILED}, {BYTES}, {WINDOWS_SQL}, {rules_cte(KEYED)}, {_BUF} SELECT rule_id, secret, count(*) AS n FROM firsts WHERE n = 1 GROUP BY rule_id, secret")
def scan_file_blocks(spark, d):
    """The spiked documents written as a few text files, which are read back as byte ranges and scanned block by block."""
    import uuid

    at = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    spiked(spark, d).select("text").write.text(at)
    spark.dataSource.register(BlockSource)
    source = spark.read.format("file_blocks").option("windows", 256)
    blocks, facts = source.load(qualified(spark, at)), source.option("facts", MARKER).load(qualified(spark, at))
    return scan_blocks(blocks, KEYED, facts=facts).groupBy("rule_id", "secret").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- from SQL

def spiked_view(spark, d) -> None:
    """The spiked documents as a view, by SQL alone, and the functions of the rules KEYED."""
    sql.register(spark, KEYED)
    spike = _SPIKE.format(base64=f"base64(cast({_HIDDEN} AS BINARY))")
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY VIEW spiked_documents AS SELECT doc_id, path, h, concat(coalesce(text, ''), '\\n', {spike}) AS text"
        f" FROM (SELECT doc_id, text, {_PATH.format(string='STRING')} AS path, sha2(cast(doc_id AS STRING), 256) AS h FROM parquet.`{d}/documents.parquet`)"
    )


@query("sql_functions", f"WITH {SPIKED} SELECT doc_id, round({ENTROPY.format('h')}, 6) AS bits, substr(h, 1, 19) || '...' AS shown, substr(h, 1, 2) || '...' || right(h, 2) AS ends, '0000000:' || path || ':r:' || doc_id AS fingerprint,"
       f" 'https://gitlab.com/o/r/-/blob/' || {_COMMIT} || '/' || path || '#L7' AS link, 'Dev ' || doc_id AS author, CAST(doc_id AS INTEGER) AS start, {_HIDDEN} AS decoded, 'a b' || h AS unescaped FROM spiked")
def sql_functions(spark, d):
    spiked_view(spark, d)
    return spark.sql(f"""SELECT doc_id, round(scan_entropy(h), 6) AS bits, scan_redact(h, 30) AS shown, scan_redact_ends(h) AS ends, scan_fingerprint('', path, 'r', doc_id) AS fingerprint,
        scan_link('GitLab', 'o', 'r', substring(h, 1, 40), path, 7) AS link, scan_author(concat('Dev ', doc_id, ' <d@e.org>')).name AS author, scan_hunk_start(concat('@@ -1,2 +', doc_id, ',3 @@')) AS start,
        scan_decode_base64(base64(cast({_HIDDEN} AS BINARY))) AS decoded, scan_decode_percent(concat('a%20b', h)) AS unescaped FROM spiked_documents""")


@query("sql_match_explode", with_rules(KEYED, "SELECT rule_id, path AS file, CAST(line_no AS INTEGER) AS start_line, CAST(before + 1 AS INTEGER) AS start_column, secret, round(entropy, 6) AS entropy FROM found"))
def sql_match_explode(spark, d):
    """Lines and their matches as rows, by SQL alone."""
    spiked_view(spark, d)
    return spark.sql("""SELECT rule_id, path AS file, line_no AS start_line, start_column, secret, round(entropy, 6) AS entropy FROM (
        SELECT path, line_no, inline(found) FROM (SELECT path, line_no, scan_match(line, path, '') AS found FROM (SELECT path, inline(lines) FROM (SELECT path, scan_lines(text) AS lines FROM spiked_documents))))""")


# ---------------------------------------------------------------- other tables and streams

PAGE_RULE = RuleSet((Rule(id="page-token", regex=r"token\s*=\s*&quot;([0-9a-f]{40})&quot;", secret_group=1, keywords=("token",)),))


@query("scan_pages", "SELECT url AS file, regexp_extract(line, 'token\\s*=\\s*&quot;([0-9a-f]{40})&quot;', 1) AS secret FROM (SELECT url, unnest(string_split(html, chr(10))) AS line FROM pages) WHERE regexp_matches(line, 'token\\s*=\\s*&quot;([0-9a-f]{40})&quot;')")
def scan_pages(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet").select(F.col("url").alias("path"), F.col("html").alias("text"))
    return scan_lines(split_lines(pages), PAGE_RULE).select("file", "secret")


MAIL = RuleSet((Rule(id="mail", regex=r"[a-z0-9.]+@[a-z0-9]+\.example\.com", keywords=("@",)),))


@query("findings_by_label", """SELECT toxic, quality, count(DISTINCT d.doc_id) AS docs, count(*) AS findings FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) d JOIN labels USING (doc_id)
WHERE regexp_matches(line, '[a-z0-9.]+@[a-z0-9]+\\.example\\.com') GROUP BY toxic, quality""")
def findings_by_label(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), "text")
    found = scan_lines(split_lines(docs), MAIL).select(F.col("file").cast("long").alias("doc_id"))
    return found.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").groupBy("toxic", "quality").agg(F.countDistinct("doc_id").alias("docs"), F.count(F.lit(1)).alias("findings"))


@query("scan_conversations", r"SELECT role, count(*) AS n_lines, count(*) FILTER (regexp_matches(line, '\b[0-9]{4}\b')) AS n_found FROM (SELECT role, unnest(string_split(text, chr(10))) AS line FROM conversations WHERE text <> '') WHERE line <> '' GROUP BY role")
def scan_conversations(spark, d):
    rows = split_lines(spark.read.parquet(f"{d}/conversations.parquet").select("role", F.col("conv_id").cast("string").alias("path"), "text")).filter("line <> ''")
    rs = RuleSet((Rule(id="number", regex=r"\b[0-9]{4}\b"),))
    hits = candidate_rules(rows, "line", rs).groupBy("role").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("n_lines")).join(hits, "role", "left").select("role", "n_lines", F.coalesce("n", F.lit(0)).alias("n_found"))


@query("stream_scan", with_rules(KEYED, "SELECT rule_id, count(*) AS findings FROM found GROUP BY rule_id"))
def stream_scan(spark, d):
    """The documents as a stream of files: findings, counted at the end of the available data."""
    import uuid

    from lanternscan.streaming.scan import stream_findings

    schema = spark.read.parquet(f"{d}/documents.parquet").schema
    docs = spark.readStream.schema(schema).parquet(f"{d}/documents.parquet*")
    base = docs.select("doc_id", "text", F.expr(_PATH.format(string="STRING")).alias("path"), F.sha2(F.col("doc_id").cast("string"), 256).alias("h"))
    spike = F.expr(_SPIKE.format(base64=f"base64(cast({_HIDDEN} AS BINARY))"))
    texts = base.select("path", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), spike).alias("text"))
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    at = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"
    run = stream_findings(texts, KEYED).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings"))


@query("stream_open_findings", """WITH e AS (SELECT *, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS prev FROM events),
s AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev > INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS nth FROM e),
spans AS (SELECT user_id, event_type, nth, min(ts) AS a, max(ts) AS z FROM s GROUP BY user_id, event_type, nth)
SELECT user_id, event_type, CASE nth WHEN 1 THEN 'seen' ELSE 'back' END AS kind, a AS at FROM spans UNION ALL SELECT user_id, event_type, 'gone', z + INTERVAL 6 HOUR FROM spans""")
def stream_open_findings(spark, d):
    """The events replayed in order of time, in a few batches that go on from one checkpoint: what is seen, gone and back."""
    import uuid

    from lanternscan.streaming.tracking import track

    events = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.lit(False).alias("clock"))
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    if first is None:
        return spark.createDataFrame([], "user_id long, event_type string, kind string, at timestamp_ntz")
    edges = [first + (last - first) * k / 3 for k in range(1, 3)]
    bounds = list(zip([None, *edges], [*edges, None]))
    parts = [events.filter((F.lit(True) if a is None else F.col("ts") >= a) & (F.lit(True) if z is None else F.col("ts") < z)) for a, z in bounds]
    # the clock goes on behind the last event, and a batch after that, with rows or without, ends all that is open
    clock = spark.createDataFrame([(None, None, last + 10 * (last - first) + timedelta(days=2), True)], events.schema)
    parts[-1] = parts[-1].union(clock)
    if spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") != "true":
        parts.append(clock)
    for part in parts:
        part.write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{at}/in")
        run = track(stream, ["user_id", "event_type", "clock"], gap="6 hours").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.parquet(f"{at}/out").filter("NOT clock").select("user_id", "event_type", "kind", F.col("at").cast("timestamp_ntz").alias("at"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: sql() if callable(sql) else sql for name, sql in ORACLES.items()}
