"""The keyword guard: which rules may match a text at all.

One or two keywords become plain ``contains`` expressions. More (the built-in catalogue has hundreds) are looked up by one
automaton pass over each text in Arrow batches, which costs the same for one rule or a thousand. Either way a text comes
out with the numbers of its candidate rules, so that rules join by number instead of by a nested loop. An empty text has the
rules without keywords as candidates, a null text has none. Before patterns are tried, rules whose further conditions a text does not
meet (``factors``) are taken out.

Patterns are tested as literals, chosen by the rule's number: a literal is compiled once a task, a pattern in a column for each row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternscan.operators.factors import guard
from lanternscan.plans.ruleset import RuleSet

NATIVE_KEYWORDS = 2
#: Rules that one level of the choice of a pattern tells apart.
FAN_OUT = 16


def keyword_lookup(words: dict[str, list[int]], always: list[int]) -> Callable[[str], list[int]]:
    """A function from a lower-case text to the sorted numbers of rules with a keyword in it."""
    try:
        import ahocorasick
    except ImportError:

        def slow(text: str) -> list[int]:
            return sorted({k for w, ks in words.items() if w in text for k in ks}.union(always))

        return slow
    automaton = ahocorasick.Automaton()
    for w, ks in words.items():
        automaton.add_word(w, ks)
    automaton.make_automaton()

    def fast(text: str) -> list[int]:
        found = set(always)
        for _, ks in automaton.iter(text):
            found.update(ks)
        return sorted(found)

    return fast if words else lambda text: list(always)


def keywords_of(rs: RuleSet) -> tuple[dict[str, list[int]], list[int]]:
    """Rule numbers by keyword, and those of rules without any."""
    words: dict[str, list[int]] = {}
    for k, r in enumerate(rs.rules):
        for w in {w.lower() for w in r.keywords}:
            words.setdefault(w, []).append(k)
    return words, [k for k, r in enumerate(rs.rules) if not r.keywords]


def candidate_lookup(rs: RuleSet, by_factors: bool = True) -> Callable[[], Callable[[str], list[int]]]:
    """What a task calls to get its function from a text to the numbers of the rules that may match it."""
    words, always = keywords_of(rs)
    patterns = [r.regex for r in rs.rules]

    def build() -> Callable[[str], list[int]]:
        look = keyword_lookup(words, always)
        if not by_factors:
            return lambda text: look(text.lower())
        passed = guard(patterns)

        def both(text: str) -> list[int]:
            low = text.lower()
            return passed(low, look(low))

        return both

    return build


def with_candidates(df: DataFrame, text: str, rs: RuleSet, by_factors: bool = False) -> DataFrame:
    """The rows whose text has a candidate rule, with ``rule_ords``: by keywords alone, or by all conditions."""
    words, _ = keywords_of(rs)
    if len(words) <= NATIVE_KEYWORDS:
        low = F.lower(text)
        hits = []
        for k, r in enumerate(rs.rules):
            cond = F.lit(not r.keywords)
            for w in r.keywords:
                cond = cond | F.contains(low, F.lit(w.lower()))
            hits.append(F.when(cond, F.lit(k)))
        ords = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<int>")
        return df.filter(F.col(text).isNotNull()).withColumn("rule_ords", ords).filter(F.size("rule_ords") > 0)

    at, names = df.columns.index(text), [*df.columns, "rule_ords"]
    schema = T.StructType(df.schema.fields + [T.StructField("rule_ords", T.ArrayType(T.IntegerType()))])
    build = candidate_lookup(rs, by_factors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = build()
        for batch in batches:
            found = [[] if x is None else look(x) for x in batch.column(at).to_pylist()]
            keep = [bool(f) for f in found]
            if any(keep):
                out = batch.filter(pa.array(keep))
                ords = pa.array([f for f in found if f], type=pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*out.columns, ords], names=names)

    return df.mapInArrow(run, schema)


def by_number(number: Column, values: list[Column], first: int = 0) -> Column:
    """``values[number - first]``, of which only that one is evaluated; chosen in steps, so that many values cost few comparisons."""
    if len(values) > FAN_OUT:
        step = -(-len(values) // FAN_OUT)
        parts = [(first + k, values[k : k + step]) for k in range(0, len(values), step)]
        out = F.when(number < parts[0][0] + step, by_number(number, parts[0][1], parts[0][0]))
        for at, part in parts[1:]:
            out = out.when(number < at + step, by_number(number, part, at))
        return out
    out = F.when(number == first, values[0])
    for k, value in enumerate(values[1:], first + 1):
        out = out.when(number == k, value)
    return out


def matching_rules(df: DataFrame, text: str, rs: RuleSet) -> DataFrame:
    """Rows (with ``rule_ords``) x rules whose path filter fits and whose pattern is found in the text; the rules are a broadcast table."""
    pairs = df.withColumn("rule_ord", F.explode("rule_ords")).drop("rule_ords")
    if rs.rules:
        hits = []
        for row in rs.rows():
            regex, path_regex = row[3], row[6]
            found = F.rlike(F.col(text), F.lit(regex))
            hits.append(F.rlike(F.col("path"), F.lit(path_regex)) & found if path_regex else found)
        pairs = pairs.filter(by_number(F.col("rule_ord"), hits))
    return pairs.join(rs.table(df.sparkSession), "rule_ord")


def candidate_rules(df: DataFrame, text: str, rs: RuleSet) -> DataFrame:
    """Rows x rules that match their text, with the rules' columns."""
    return matching_rules(with_candidates(df, text, rs, by_factors=True), text, rs)
