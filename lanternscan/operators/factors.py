"""What a text must contain for a pattern to match: literal factors and long unbroken runs, read off the pattern's syntax tree.

The keyword guard lets through every text with a common word such as ``key``. A pattern asks for more than its keyword: further
literals (an equals sign, a quote, a prefix), and mostly a run of some twenty characters without white space. Both are looked up in
a text at the speed of a substring search, long before the pattern is tried. All conditions are necessary ones, so nothing is
lost; a pattern that cannot be read has no conditions.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as op
from re import _parser as parser

#: White space that ends a run; ``\\s`` of the patterns' dialect.
SPACE = frozenset("\t\n\f\r ")
#: A class of up to so many characters is a choice of literals.
FEW = 4
#: Characters that match an ASCII letter when case is ignored, but are not that letter in lower case.
FOLDED = re.compile("[ſİıK]")


@dataclass(frozen=True)
class Factors:
    """``clauses``: of each, one literal must occur in the lower-case text. ``run``: the text has so many characters without white space in a row."""

    clauses: tuple[tuple[str, ...], ...] = ()
    run: int = 0


@dataclass
class _Part:
    """A piece of a pattern: clauses; whether it has no white space, its least length; else the runs that it begins and ends with, and its best."""

    clauses: list[frozenset[str]]
    solid: bool
    length: int = 0
    head: int = 0
    best: int = 0
    tail: int = 0


def _is_solid(items: list) -> bool:
    """Whether a class never matches white space."""
    negated = bool(items) and items[0][0] is op.NEGATE
    hit = set()
    for kind, value in items[negated:]:
        if kind is op.LITERAL:
            hit |= {chr(value)} & SPACE
        elif kind is op.RANGE:
            hit |= {c for c in SPACE if value[0] <= ord(c) <= value[1]}
        elif kind is op.CATEGORY and value is op.CATEGORY_SPACE:
            hit |= SPACE
        elif kind is op.CATEGORY and value in (op.CATEGORY_NOT_WORD, op.CATEGORY_NOT_DIGIT):
            hit |= set() if negated else SPACE  # a negated class may still let white space through
    return hit == SPACE if negated else not hit


def _sequence(tree) -> _Part:
    clauses: list[frozenset[str]] = []
    word, solid, length, head, best, running = "", True, 0, None, 0, 0

    def flush():
        nonlocal word
        if word:
            clauses.append(frozenset([word]))
        word = ""

    for kind, value in tree:
        if kind is op.LITERAL:
            c = chr(value)
            if c.isascii():
                word += c.lower()
            else:  # may match in several forms when case is ignored
                flush()
            part = _Part([], c not in SPACE, 1)
        elif kind is op.AT:
            continue
        else:
            flush()
            part = _piece(kind, value)
            clauses += part.clauses
        if part.solid:
            running += part.length
            length += part.length
            best = max(best, running)
        else:
            best = max(best, running + part.head, part.best)
            head = running + part.head if head is None else head
            running, solid = part.tail, False
    flush()
    return _Part(clauses, solid, length, running if head is None else head, max(best, running), running)


def _piece(kind, value) -> _Part:
    if kind is op.SUBPATTERN:
        return _sequence(value[3])
    if kind is op.BRANCH:
        parts = [_sequence(x) for x in value[1]]
        # of each alternative the clause whose shortest literal is longest
        best = [max(p.clauses, key=lambda c: min(map(len, c)), default=None) for p in parts]
        clauses = [frozenset().union(*best)] if all(best) else []
        ends = {n: min(p.length if p.solid else getattr(p, n) for p in parts) for n in ("head", "best", "tail")}
        return _Part(clauses, all(p.solid for p in parts), min(p.length for p in parts), **ends)
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        least, _, tree = value
        part = _sequence(tree)
        if part.solid:
            return _Part(part.clauses if least else [], True, least * part.length)
        return part if least else _Part([], False)
    if kind is op.IN:
        choice = {chr(v).lower() for k, v in value if k is op.LITERAL} if all(k is op.LITERAL for k, _ in value) and len(value) <= FEW else None
        return _Part([frozenset(choice)] if choice else [], _is_solid(value), 1)
    return _Part([], False)


@lru_cache(maxsize=4096)
def factors(pattern: str) -> Factors:
    """Necessary conditions of a pattern in the rules' own dialect."""
    if re.search(r"\[:\^?\w+:\]|\\[QpP]", pattern):  # what Python's parser reads in another way
        return Factors()
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            part = _sequence(parser.parse(re.sub(r"\(\?P?<(?![=!])", "(?P<", pattern).replace(r"\z", r"\Z")))
    except (re.error, OverflowError, RecursionError):
        return Factors()
    single = {next(iter(c)) for c in part.clauses if len(c) == 1}
    # a clause says nothing if a longer literal that must occur contains one of its own
    kept = {c for c in part.clauses if not any(x != w and x in w for w in single for x in c)}
    return Factors(tuple(tuple(sorted(c)) for c in sorted(kept, key=lambda c: (-min(map(len, c)), sorted(c)))), part.length if part.solid else part.best)


def guard(patterns: list[str]) -> Callable[[str, list[int]], list[int]]:
    """A function of a lower-case text and numbers of patterns, to those numbers whose conditions hold."""
    needs = [factors(p) for p in patterns]

    def passed(low: str, numbers: list[int]) -> list[int]:
        if not numbers or (not low.isascii() and FOLDED.search(low)):
            return numbers
        data = low.encode("utf-8", "replace")
        if b"\x0b" in data:  # no white space in this dialect
            data = data.replace(b"\x0b", b"x")
        longest = max(map(len, data.split()), default=0)  # bytes, which are at least as many as characters
        seen: dict[str, bool] = {}

        def holds(clause: tuple[str, ...]) -> bool:
            for w in clause:
                found = seen.get(w)
                if found is None:
                    found = seen[w] = w in low
                if found:
                    return True
            return False

        return [k for k in numbers if needs[k].run <= longest and all(map(holds, needs[k].clauses))]

    return passed
