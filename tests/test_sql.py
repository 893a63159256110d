"""The functions for SQL give what the column functions and the operators give."""

import pytest
from pyspark.sql import functions as F

from lanternscan.functions import sql
from lanternscan.functions import text as T
from lanternscan.operators.buffers import scan_buffers
from lanternscan.operators.lines import scan_lines, split_lines
from lanternscan.plans.ruleset import RuleSet
from lanternscan.rules.model import Allowlist, Rule

STRINGS = [None, "", "a", "aaaa", "abcd", "éé𝄞", "superlongvalue45", "a2V5PWFiY2RlZmdoaWo=", "a2V5PWFiY2RlZmdo_-o=", "6b65793d6162636465666768696a6b6c6d", "a%20b+c", "100%", "A B <a@b.c>", "<only@x>", "A <b> c <d@e> f", "@@ -1 +20,7 @@", "+x", "x scan:allow"]


@pytest.fixture(scope="module")
def rules(spark):
    own = Rule(id="own", regex=r"k='(it\\'s|[a-z]+)'?", secret_group=1, path=r"\.env$", keywords=("K=",), tags=("x", "y'z"), allowlists=(Allowlist(stop_words=("bad",)), Allowlist(paths=("^no/",), regexes=("q$",), condition="and")))
    rs = RuleSet.compile([own, Rule(id="plain", regex="[0-9]{4}", entropy=1.5)]).only("own", "plain", "github-pat", "generic-api-key", "aws-access-key-id")
    assert set(sql.register(spark, rs, "t_")) >= {"t_entropy", "t_match", "t_decode"}
    return rs


def test_scalar_functions(spark, rules):
    df = spark.createDataFrame([(s,) for s in STRINGS], "s string")
    df.createOrReplaceTempView("strings")
    one = spark.sql("""SELECT t_entropy(s), t_redact(s, 50), t_redact(s, 0), t_redact(s, 100), t_redact_ends(s), t_fingerprint(s, 'f', 'r', 3), t_link('GITHUB', 'o', 'r', s, 'p', 7), t_link('x', 'o', 'r', s, 'p', 7),
        t_author(s), t_hunk_start(s), t_allowed_line(s), t_decode_base64(s), t_decode_base64url(s), t_decode_hex(s), t_decode_percent(s) FROM strings""").collect()
    link = lambda p: T.platform_link(p, F.lit("o"), F.lit("r"), F.col("s"), F.lit("p"), F.lit(7))
    two = df.select(
        T.shannon_entropy("s"), T.redact_percent("s", 50), T.redact_percent("s", 0), T.redact_percent("s", 100), T.redact_ends("s"), T.fingerprint("s", F.lit("f"), F.lit("r"), F.lit(3)), link("github"), link("x"),
        T.parse_author("s"), T.hunk_start("s"), T.has_allow_marker("s"), T.decode_base64("s"), T.decode_base64url("s"), T.decode_hex("s"), T.decode_percent("s"),
    ).collect()
    for s, a, b in zip(STRINGS, one, two):
        if s is not None:
            assert list(map(str, a)) == list(map(str, b)), s


def test_matches(spark, rules):
    line = "ghp_" + "a1B2" * 9 + " and k='abc' k='it\\'s' 1234 1111 é api_key = \"0123456789abcdef0123456789abcdef\""
    texts = [("a.env", f"{line}\r\nk='bad' 5678\n\nk='seq' scan:allow\n"), ("no/b.env", "k='seq'\nk='abc'"), ("c.txt", line), ("d", ""), ("e", None)]
    df = spark.createDataFrame(texts, "path string, text string")
    df.createOrReplaceTempView("files")
    got = spark.sql("""SELECT rule_id, path, line_no, start_column, end_column, found, secret, tags FROM (
        SELECT path, line_no, inline(m) FROM (SELECT path, line_no, t_match(line, path, '') AS m FROM (SELECT path, inline(l) FROM (SELECT path, t_lines(text) AS l FROM files))))""").collect()
    want = scan_lines(split_lines(df), rules).select("rule_id", "file", "start_line", "start_column", "end_column", "match", "secret", "tags").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) >= 6
    every = spark.sql("SELECT rule_id, path, found, secret FROM (SELECT path, inline(m) FROM (SELECT path, t_match_all(text, path, '') AS m FROM files))").collect()
    short = scan_buffers(df.select("path", F.col("text").alias("content")), rules, marker="no such mark").select("rule_id", "file", "match", "secret").collect()
    assert sorted(map(tuple, every)) == sorted(map(tuple, short)) and len(every) > len(got)
    plan = spark.sql("SELECT t_match(text, path, '') AS m FROM files")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_decoding_and_diffs(spark, rules):
    rows = spark.sql("SELECT inline(d) FROM (SELECT t_decode(base64(cast('a=%20+bcdefghijkl' AS BINARY))) AS d)").collect()
    assert [(r.encoding, r.depth) for r in rows] == [("base64", 1), ("percent", 2)] and rows[1].value == "a=  bcdefghijkl"
    spark.createDataFrame([("p", k, x) for k, x in enumerate(["diff --git a/x b/x", "+++ b/x", "@@ -0,0 +5 @@", "+one", "+two"])], "patch_id string, seq int, line string").createOrReplaceTempView("some_patches")
    sql.diff_view(spark, "some_patches", "some_lines")
    assert [tuple(r) for r in spark.sql("SELECT path, line_no, line FROM some_lines ORDER BY line_no").collect()] == [("x", 5, "one"), ("x", 6, "two")]
