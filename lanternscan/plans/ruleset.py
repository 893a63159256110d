"""Rules become data: a small table with translated patterns that is broadcast to the scans."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternscan.functions.dialect import PatternError, groups, to_java
from lanternscan.rules.catalog import builtin_rules
from lanternscan.rules.model import Allowlist, Rule

ALLOWLIST = "struct<paths: array<string>, regexes: array<string>, commits: array<string>, stop_words: array<string>, target: string, is_and: boolean>"
RULE = (
    "rule_ord int, rule_id string, description string, regex string, grp int, min_entropy double, path_regex string, keywords array<string>, "
    f"tags array<string>, allow array<{ALLOWLIST}>, required array<struct<id: string, regex: string, lines: int, columns: int>>"
)
DEFAULT_RADIUS = 5


class RuleError(ValueError):
    """A rule or allowlist that cannot be compiled: rule id, field and reason."""

    def __init__(self, rule_id: str, field: str, reason: Exception | str):
        super().__init__(f"rule {rule_id!r}: {field}: {reason}")
        self.rule_id, self.field = rule_id, field


def _translate(rule_id: str, field: str, pattern: str) -> str:
    try:
        return to_java(pattern)
    except PatternError as e:
        raise RuleError(rule_id, field, e) from e


def compile_allowlist(a: Allowlist, owner: str = "global") -> tuple:
    return (
        [_translate(owner, "allowlist path", p) for p in a.paths], [_translate(owner, "allowlist regex", p) for p in a.regexes],
        list(a.commits), [w.lower() for w in a.stop_words], a.regex_target.lower(), a.condition.upper() == "AND",
    )


@dataclass(frozen=True)
class RuleSet:
    """Ordered rules and the allowlists that hold for all of them."""

    rules: tuple[Rule, ...]
    allowlists: tuple[Allowlist, ...] = ()

    @classmethod
    def compile(
        cls,
        rules: Iterable[Rule] = (),
        allowlists: Iterable[Allowlist] = (),
        use_default: bool = True,
        disabled: Sequence[str] = (),
        enabled: Sequence[str] = (),
    ) -> RuleSet:
        """Built-in rules, then own ones (the same id replaces in place), without the disabled, and only the enabled if any are named."""
        table: dict[str, Rule] = {r.id: r for r in builtin_rules()} if use_default else {}
        for r in rules:
            table[r.id] = r
        kept = [r for r in table.values() if r.id not in set(disabled) and (not enabled or r.id in set(enabled))]
        out = cls(tuple(kept), tuple(allowlists))
        out.rows()  # errors show at once
        [compile_allowlist(a) for a in out.allowlists]
        return out

    def only(self, *ids: str) -> RuleSet:
        return replace(self, rules=tuple(r for r in self.rules if r.id in ids))

    @property
    def radius(self) -> int:
        """Lines around a match that proximity conditions may look at."""
        return max([0, *(max(q.within_lines for q in r.required) or DEFAULT_RADIUS for r in self.rules if r.required)])

    def required_patterns(self) -> dict[str, list[tuple[str, ...]]]:
        """Distinct required patterns, translated, with the keywords of each rule that asks for one."""
        out: dict[str, list[tuple[str, ...]]] = {}
        for r in self.rules:
            for q in r.required:
                out.setdefault(_translate(r.id, "required", q.regex), []).append(tuple(w.lower() for w in r.keywords))
        return out

    def rows(self) -> list[tuple]:
        out = []
        for k, r in enumerate(self.rules):
            if not r.id:
                raise RuleError("", "id", "is missing")
            regex = _translate(r.id, "regex", r.regex)
            group = r.secret_group if 0 < r.secret_group <= groups(r.regex) else 0
            out.append((
                k, r.id, r.description, regex, group, float(r.entropy), _translate(r.id, "path", r.path) if r.path else None,
                [w.lower() for w in r.keywords], list(r.tags), [compile_allowlist(a, r.id) for a in r.allowlists],
                [(q.id, _translate(r.id, "required", q.regex), q.within_lines, q.within_columns) for q in r.required],
            ))
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per rule; a few hundred rows, whatever the input."""
        return F.broadcast(spark.createDataFrame(self.rows(), RULE))


def allowed(a: Column, secret: Column, match: Column, line: Column, path: Column, commit: Column, found: Column | None = None) -> Column:
    """Whether one allowlist (a struct) suppresses: any of its present checks, or all of them. ``found``: whether a pattern fits, if known."""
    target = F.when(a.target == "match", match).when(a.target == "line", line).otherwise(secret)
    low = F.lower(secret)
    commit = F.coalesce(commit, F.lit(""))
    checks = [
        (F.size(a.commits) > 0, F.array_contains(a.commits, commit) | ((F.length(commit) >= 7) & F.array_contains(a.commits, F.substring(commit, 1, 7)))),
        (F.size(a.paths) > 0, F.exists(a.paths, lambda p: F.rlike(path, p))),
        (F.size(a.regexes) > 0, F.exists(a.regexes, lambda p: F.rlike(target, p)) if found is None else found),
        (F.size(a.stop_words) > 0, F.exists(a.stop_words, lambda w: F.contains(low, w))),
    ]
    some, every, passed = F.lit(False), F.lit(True), F.lit(False)
    for present, ok in checks:
        some = some | present
        every = every & (~present | ok)
        passed = passed | (present & ok)
    return F.when(a.is_and, some & every).otherwise(passed)


def rule_allowed(secret: Column, match: Column, line: Column, path: Column, commit: Column) -> Column:
    return F.exists(F.col("allow"), lambda a: allowed(a, secret, match, line, path, commit))


def globally_allowed(
    rs: RuleSet, secret: Column, match: Column, line: Column, path: Column, commit: Column, on_line: dict[int, Column] | None = None
) -> Column:
    """``on_line``: by number of the allowlist, whether one of its patterns fits the line, where that is known already."""
    out = F.lit(False)
    for k, a in enumerate(rs.allowlists):
        paths, regexes, commits, stops, target, is_and = compile_allowlist(a)
        strings = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
        row = F.struct(
            strings(paths).alias("paths"), strings(regexes).alias("regexes"), strings(commits).alias("commits"),
            strings(stops).alias("stop_words"), F.lit(target).alias("target"), F.lit(is_and).alias("is_and"),
        )
        found = (on_line or {}).get(k)
        out = out | F.exists(F.array(row), lambda x: allowed(x, secret, match, line, path, commit, found))  # noqa: B023
    return out
