"""Scalar functions and the pattern dialect."""

import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lanternscan.functions import text as T
from lanternscan.functions.decode import decode_value
from lanternscan.functions.dialect import PatternError, glob_to_java, groups, to_java


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_entropy(spark):
    cases = {"": 0, "a": 0, "aaaa": 0, "ab": 1, "abcd": 2, "abcdefgh": 3, "ééüü": 1, "😀😁": 1, "aabb": 1}
    got = values(spark, [(s,) for s in cases], "s string", "s", T.shannon_entropy("s"))
    assert {s: round(h, 9) for s, h in got} == cases


def test_redact_percent(spark):
    def one(s, p):
        return values(spark, [(s,)], "s string", T.redact_percent("s", p))[0][0]

    assert one("abcdefghij", 0) == one("abcdefghij", -10) == "REDACTED"
    assert one("abcdefghij", 100) == one("abcdefghij", 150) == "abcdefghij"
    assert one("abcdefghij", 50) == "abcde..." and one("ab", 10) == "a..." and one("", 50) == "" and one("", 0) == ""


def test_redact_ends(spark):
    cases = {"": "", "a": "REDACTED", "abcd": "REDACTED", "abcde": "ab...de", "supersecret12345": "su...45"}
    assert dict(values(spark, [(s,) for s in cases], "s string", "s", T.redact_ends("s"))) == cases


def test_fingerprint_and_links(spark):
    row = values(spark, [("", "f", "r", 3), ("abc", "f", "r", 4)], "c string, f string, r string, n int", T.fingerprint("c", "f", "r", "n"))
    assert row == [("0000000:f:r:3",), ("abc:f:r:4",)]
    args = [F.lit(x) for x in ("o", "r", "c", "f")] + [F.lit(5)]
    links = values(spark, [(1,)], "x int", *(T.platform_link(p, *args) for p in ("GitHub", "gitlab", "other")))
    assert links == [("https://github.com/o/r/blob/c/f#L5", "https://gitlab.com/o/r/-/blob/c/f#L5", "")]


def test_author_hunk_remote(spark):
    authors = {"A B <a@b.c>": ("A B", "a@b.c"), "No Mail": ("No Mail", ""), "": ("", ""), "<x@y>": ("", "x@y"), "  A   <a@b>  ": ("A", "a@b")}
    got = values(spark, [(s,) for s in authors], "s string", "s", T.parse_author("s"))
    assert {s: tuple(a) for s, a in got} == authors
    hunks = {"@@ -10,5 +20,7 @@": 20, "@@ -1 +1 @@": 1, "@@ -0,0 +1,350 @@ x +9": 1, "@@ -1 @@": 0, "@@ +x @@": 0, "@@ +99999999999999999999 @@": 0}
    assert dict(values(spark, [(s,) for s in hunks], "s string", "s", T.hunk_start("s"))) == hunks
    urls = {"git@h.com:o/r.git": ("o", "r"), "https://h.com/o/r": ("o", "r"), "https://h.com/o/s/r.git": ("o", "s/r"), "nonsense": ("", "")}
    assert {u: tuple(r) for u, r in values(spark, [(u,) for u in urls], "u string", "u", T.parse_remote("u"))} == urls


@pytest.mark.parametrize(
    ("path", "patterns", "want"),
    [
        ("vendor/lib.go", ["vendor/lib.go"], True), ("vendor/lib.go", ["vendor/"], True), ("conf/a.yaml", ["*.yaml"], True),
        ("a.yaml", ["*.yaml"], True), ("main.go", ["*.yaml"], False), ("main.go", [], False), ("testdata/x", ["testdata"], True),
        ("a/b/c", ["a/*"], False), ("a/x", ["a/[!x]", "a/[xy]"], True), ("a+b", ["a+?"], True),
    ],
)
def test_exclude_path(spark, path, patterns, want):
    assert values(spark, [(path,)], "p string", T.excluded_path("p", patterns)) == [(want,)]


def test_exclude_commit_and_checks(spark):
    rows = [("abcdef1234",), ("abcdef1",), ("",), ("fff",)]
    assert [r[0] for r in values(spark, rows, "c string", T.excluded_commit("c", ["abcdef123"]))] == [True, True, False, False]
    T.check_commits(["ABCDEF1"])
    for bad in (["abc"], ["ghijklmn"]):
        with pytest.raises(ValueError):
            T.check_commits(bad)
    with pytest.raises(ValueError):
        T.check_globs(["a[b"])


def test_decode_columns(spark):
    import base64

    s = "hello, secret world"
    rows = [(base64.b64encode(s.encode()).decode(), s.encode().hex(), "a%20b+c")]
    got = values(spark, rows, "b string, h string, p string", T.decode_base64("b"), T.decode_hex("h"), T.decode_percent("p"), T.decode_base64("p"))
    assert got == [(s, s, "a b c", None)]
    assert values(spark, [("%zz",), ("plain",)], "s string", T.decode_percent("s")) == [(None,), (None,)]


def test_decode_recursive():
    import base64

    inner = base64.b64encode(b"password=hunter2secret").decode()
    outer = base64.b64encode(inner.encode()).decode()
    assert decode_value(outer, 0) == []
    assert decode_value(outer, 1)[0] == (inner, "base64", 1)
    assert (b"password=hunter2secret".decode(), "base64", 2) in decode_value(outer, 3)
    assert decode_value("short", 2) == []


def test_safe_members(spark):
    cases = {"a/b.txt": True, "/etc/x": False, "../x": False, "a/../b": False, "a..b/c": True, "a\\..\\b": False}
    assert dict(values(spark, [(s,) for s in cases], "s string", "s", T.safe_member("s"))) == cases


def test_dialect(spark):
    def found(pattern, s):
        return values(spark, [(s,)], "s string", F.rlike("s", F.lit(to_java(pattern))))[0][0]

    assert not found(r"a\sb", "a\x0bb") and found(r"a\sb", "a\tb")
    assert found(r"\bkey\b", "ékeyé") and not found(r"\bkey\b", "akey")
    assert found(r"\bab?c", "x ac") and not found(r"\b(?:(a)c)", "xac") and found(r"\ba?-", "x-") and not found(r"\ba?-", " -")
    assert not found("a$", "a\n") and found("a$", "a")
    assert found("a.b", "a\rb") and not found("a.b", "a\nb")
    assert found("(?i)KEY", "Key") and found(r"[^\s]", "\x0b") and found(r"a[\s\S]b", "a\nb")
    assert found("[[]", "[") and groups("(a)(?:b)(c)") == 2
    with pytest.raises(PatternError):
        to_java("(")
    assert re.search("x", glob_to_java("x*"))


@given(st.text(alphabet="ab1 _-.\n", max_size=12))
def test_dialect_keeps_plain_patterns(s):
    for p in (r"[ab]+1", r"(a|b)_?", r"[^\n]-"):
        assert bool(re.search(p, s)) == bool(re.search(to_java(p).replace(r"\z", r"\Z"), s))
