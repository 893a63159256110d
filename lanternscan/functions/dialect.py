"""Patterns are written in the RE2 dialect; Spark runs Java's. This module turns one into the other.

Differences that matter here: ``\\s`` has no vertical tab, ``\\b`` looks at ASCII only, ``$`` is the very end, ``.`` stops at a
line feed only, case folding covers Unicode, and ``[`` or ``&&`` mean nothing special inside a class.
"""

from __future__ import annotations

import re
import warnings
from functools import lru_cache

SPACE = r"\t\n\f\r "
WORD = "[0-9A-Za-z_]"
BOUNDARY = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
#: A boundary before a word character, where one look back is enough.
WORD_START = f"(?<!{WORD})"
STARTS_WORD = re.compile(r"\\b(?:\(\?:|\()*[0-9A-Za-z_](?![?*{])")
NO_BOUNDARY = f"(?:(?<={WORD})(?={WORD})|(?<!{WORD})(?!{WORD}))"


class PatternError(ValueError):
    """A pattern that is not valid."""


def _class(p: str, i: int) -> tuple[str, int]:
    """Translate the bracket class that starts at p[i]; returns it with the index after it."""
    start = i
    i += 1
    negated = i < len(p) and p[i] == "^"
    i += negated
    body, items = "", set()
    first = True
    while i < len(p) and (p[i] != "]" or first):
        first = False
        if p[i] == "\\" and i + 1 < len(p):
            c = p[i + 1]
            items.add(c)
            body += SPACE if c == "s" else p[i : i + 2]
            i += 2
        elif p.startswith("[:", i) and ":]" in p[i:]:
            end = p.index(":]", i) + 2
            body += r"\p{" + p[i + 2 : end - 2].capitalize() + "}"
            i = end
        else:
            body += "\\" + p[i] if p[i] in "[&^" else p[i]
            i += 1
    if i >= len(p):
        raise PatternError(f"missing ] in {p[start:]!r}")
    if {"s", "S"} <= items or {"w", "W"} <= items or {"d", "D"} <= items:
        return ("(?!)" if negated else r"(?s:.)"), i + 1
    if "S" in items:  # everything but the five white-space characters, plus what else the class has
        rest = body.replace("\\S", "")
        return (f"(?:(?![^{SPACE}]){f'[^{rest}]' if rest else '(?s:.)'})" if negated else f"(?:[^{SPACE}]" + (f"|[{rest}])" if rest else ")")), i + 1
    return f"[{'^' if negated else ''}{body}]", i + 1


@lru_cache(maxsize=4096)
def to_java(pattern: str) -> str:
    """The pattern for Java's engine with the same matches."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", FutureWarning)
            re.compile(re.sub(r"\(\?P?<", "(?P<", pattern).replace(r"\z", r"\Z"))
    except re.error as e:
        raise PatternError(f"bad pattern {pattern!r}: {e}") from e
    out, i, multi = "", 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            d = pattern[i + 1]
            if "|" not in pattern and "(?i" not in pattern and STARTS_WORD.match(pattern, i):
                out += WORD_START
                i += 2
                continue
            out += {"s": f"[{SPACE}]", "S": f"[^{SPACE}]", "b": BOUNDARY, "B": NO_BOUNDARY, "z": r"\z"}.get(d, pattern[i : i + 2])
            i += 2
        elif c == "[":
            part, i = _class(pattern, i)
            out += part
        elif c == "$":
            out += "(?=\\n|\\z)" if multi else r"\z"
            i += 1
        elif c == ".":
            out += r"[^\n]"
            i += 1
        elif m := re.match(r"\(\?([imsU]+)(\)|:)", pattern[i:]):
            flags = m[1]
            multi |= "m" in flags
            if "U" in flags:
                raise PatternError("ungreedy patterns are not supported")
            out += f"(?{flags.replace('i', 'iu')}{m[2]}"
            i += m.end()
        elif pattern.startswith("(?P<", i):
            out += "(?<"
            i += 4
        else:
            out += c
            i += 1
    return out


def groups(pattern: str) -> int:
    """The number of capture groups."""
    return re.compile(re.sub(r"\(\?P?<(?![=!])", "(?P<", pattern)).groups


def glob_to_java(glob: str) -> str:
    """A shell glob whose ``*`` and ``?`` do not cross ``/``, anchored at both ends; raises PatternError when malformed."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\":
            i += 1
            if i >= len(glob):
                raise PatternError(f"glob {glob!r} ends with a backslash")
            out += "\\Q" + glob[i] + "\\E"
        elif c == "[":
            end = i + 1 + (glob[i + 1 : i + 2] == "^")
            end = glob.find("]", end + 1)
            if end < 0:
                raise PatternError(f"glob {glob!r} has no closing bracket")
            out += "[" + glob[i + 1 : end].replace("[", "\\[").replace("&", "\\&") + "&&[^/]]"
            i = end
        else:
            out += re.escape(c) if not c.isalnum() and c.isascii() else c
        i += 1
    return rf"\A{out}\z"
