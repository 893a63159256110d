"""License scans: fuzzy search for short notices.

A text is reduced to its words, joined by single spaces. A notice that may differ by k characters is split into k + 1
pieces; by the pigeonhole principle one piece stands unchanged in every occurrence. One automaton finds all pieces, each
find gives a candidate region, and the ``regex`` library's bounded-error matching verifies the edits there and reports
the span. A match begins and ends where words do, so what a word has more counts as edits. Exact phrases (the base) are
counted on the same words. Places are looked up in the table of word starts, so long texts cost in proportion to their length.

Null and empty texts have no words, no places and score 0. Repeated rows get equal results. One narrow pass, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import item_words, map_documents, table, text_bytes

# The base phrases with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Opening words of common license notices, as lower-case words, with their labels.
NOTICES = [
    ("apache", "licensed under the apache license"),
    ("apache", "www apache org licenses license 2 0"),
    ("mit", "under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("bsd", "redistribution and use in source and binary forms with or without modification"),
    ("gpl", "under the terms of the gnu general public license"),
    ("gpl", "licensed under the gnu general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("cc", "licensed under a creative commons attribution"),
    ("cc-by", "licensed under cc by"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "reproduction without written permission is prohibited"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented"),
    ("boost", "distributed under the boost software license"),
    ("epl", "made available under the terms of the eclipse public license"),
    ("cddl", "common development and distribution license"),
    ("artistic", "under the terms of the artistic license"),
    ("ofl", "licensed under the sil open font license"),
    ("cc0", "to the extent possible under law the author has waived all copyright"),
    ("gfdl", "under the terms of the gnu free documentation license"),
]


@dataclass(frozen=True)
class Match:
    label: str
    start: int  # character span in the joined words
    end: int
    edits: int
    length: int


def allowed_errors(notice: str) -> int:
    """One edit for each 12 characters, from 1 to 5."""
    return max(1, min(5, len(notice) // 12))


def split_pieces(notice: str, parts: int) -> list[tuple[int, str]]:
    """The notice as ``parts`` consecutive pieces of nearly equal length, with their offsets."""
    edges = [len(notice) * i // parts for i in range(parts + 1)]
    return [(a, notice[a:b]) for a, b in zip(edges, edges[1:])]


def merged(spans: list[list[int]]) -> list[list[int]]:
    """Spans in order, those that meet as one."""
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return out


class NoticeFinder:
    def __init__(self, notices: list[tuple[str, str]] = NOTICES):
        import ahocorasick
        import regex

        self.notices = []
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, (label, notice) in enumerate(notices):
            errors = allowed_errors(notice)
            self.notices.append((label, len(notice), errors, regex.compile(rf"(?e)(?<![^ ])(?:{regex.escape(notice)}){{e<={errors}}}(?![^ ])")))
            for offset, piece in split_pieces(notice, errors + 1):
                seeds.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in seeds.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def regions(self, joined: str) -> dict[int, list[list[int]]]:
        """Candidate regions per notice, merged where they overlap."""
        found: dict[int, list[list[int]]] = {}
        for end, (size, places) in self.automaton.iter(joined):
            for k, offset in places:
                _, length, errors, _ = self.notices[k]
                start = end - size + 1 - offset - errors
                stop = start + length + 2 * errors
                have = found.setdefault(k, [])
                have.append([start, stop])
        return {k: merged(spans) for k, spans in found.items()}

    def search(self, joined: str) -> list[Match]:
        out = []
        for k, spans in self.regions(joined).items():
            label, length, _, pattern = self.notices[k]
            for a, b in spans:
                begin, end = joined.rfind(" ", 0, max(0, a)) + 1, joined.find(" ", b)  # whole words
                for m in pattern.finditer(joined, begin, len(joined) if end < 0 else end):
                    out.append(Match(label, m.start(), m.end(), sum(m.fuzzy_counts), length))
        return sorted(out, key=lambda m: (m.start, m.end, m.label))


def word_starts(words: list[str]) -> np.ndarray:
    """Where each word begins in the words joined by single spaces."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    return np.cumsum(sizes) - sizes


def phrase_places(joined: str, starts: np.ndarray, phrases: dict[str, str] = PHRASES) -> list[tuple[int, str]]:
    """First word and label of each place where a phrase's words stand consecutively."""
    padded, out = f" {joined} ", []
    for phrase, label in phrases.items():
        at = padded.find(f" {phrase} ")
        while at >= 0:
            out.append((int(np.searchsorted(starts, at)), label))
            at = padded.find(f" {phrase} ", at + 1)
    return out


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, span_labels array<string>, span_starts array<long>, span_ends array<long>, span_edits array<long>"
)


def scan_licenses(docs: DataFrame, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """Base places and fuzzy notices of every document; spans are in words, the end exclusive."""

    def build():
        finder = NoticeFinder(notices)

        def fn(ids, texts):
            rows = []
            for doc_id, data in zip(ids, texts):
                words = item_words(data or b"")
                joined = b" ".join(words).decode("utf-8", "replace")
                begins = word_starts(joined.split(" ")) if words else np.empty(0, dtype=np.int64)
                base = phrase_places(joined, begins)
                found = finder.search(joined)
                starts = [p for p, _ in base]
                base_labels = {label for _, label in base}
                score = max([1.0 if base else 0.0, *(1 - m.edits / m.length for m in found)])
                word = lambda at: int(np.searchsorted(begins, at, side="right"))  # noqa: B023, E731
                spans = [(m.label, word(m.start) - 1, word(m.end - 1), m.edits) for m in found]
                rows.append((
                    doc_id, len(words), len(base), min(starts, default=None), max(starts, default=None),
                    ",".join(sorted(base_labels)), ",".join(sorted(base_labels | {m.label for m in found})), score,
                    *([s[i] for s in spans] for i in range(4)),
                ))
            return list(zip(*rows)) if rows else [[]] * 12

        return fn

    return map_documents(docs, (F.col("doc_id").cast("long"), text_bytes()), SCHEMA, build)


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact part of the scan alone."""
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_PLACES = " UNION ALL ".join(
    f"SELECT r, i, '{label}' AS label FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM d) WHERE ws[i:i + {len(phrase.split()) - 1}] = {phrase.split()!r}"
    for phrase, label in PHRASES.items()
)

PHRASES_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
p AS ({_PLACES}),
g AS (SELECT r, count(*) AS n, min(i) - 1 AS lo, max(i) - 1 AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(lo AS BIGINT) AS first_word,
  CAST(hi AS BIGINT) AS last_word, coalesce(labels, '') AS base_labels
FROM d LEFT JOIN g USING (r)"""
