"""A made-up text for each pattern, so that every rule can be seen to match. Characters vary along the text."""

from __future__ import annotations

import re
from functools import lru_cache

from .catalog import builtin_rules

FILLER = "kR7mZ2qXw9TbN4cVh6LsJ8dPf3GyKa5"
EXAMPLE_PATHS = {
    "gcp-service-account-key": "a/key.json", "docker-config-auth": "a/.docker/config.json", "kubernetes-secret-yaml": "a/secret.yaml",
    "dotenv-secret": "a/prod.env", "npmrc-auth": "a/.npmrc",
}
PRINTABLE = [*FILLER, *(chr(c) for c in range(33, 127) if chr(c) not in FILLER)]
REPEAT = re.compile(r"\{(\d+)(?:,\d*)?\}|[*+?]")
CLASS = re.compile(r"\[\^?\]?(?:\\.|[^\]\\])*\]")


def example(pattern: str) -> str:
    """A text that the pattern matches: first alternatives, least repeats (five of a group that may be absent for ever), varied characters."""
    out: list[str] = []

    def atom(i: int) -> int:
        """The end of the atom that starts at i."""
        if pattern[i] == "\\":
            return i + 2
        if pattern[i] == "[":
            return CLASS.match(pattern, i).end()
        if pattern[i] != "(":
            return i + 1
        depth, i = 1, i + 1
        while depth:
            depth += {"(": 1, ")": -1}.get(pattern[i], 0)
            i = atom(i) if pattern[i] in "\\[" else i + 1
        return i

    def walk(i: int, end: int) -> None:
        """Text of the first alternative between i and end."""
        while i < end and pattern[i] != "|":
            stop = atom(i)
            m = REPEAT.match(pattern, stop) if stop < end else None
            least = 1 if m is None else int(m[1]) if m[1] else int(m[0] == "+")
            if m is not None and m[0] == "*" and pattern[i] == "(":
                least = 5
            for _ in range(least):
                one(i, stop)
            i = m.end() if m else stop
            i += m is not None and pattern.startswith("?", i)

    def one(i: int, stop: int) -> None:
        part = pattern[i:stop]
        if part[0] == "(":
            head = re.match(r"\((?:\?(?:[a-zA-Z]*:|P?<\w+>|[a-zA-Z]+(?=\))))?", part).end()
            walk(i + head, stop - 1)
        elif part[0] == "[" or part in (r"\s", r"\S", r"\w", r"\d", "."):
            fits = re.compile(part)
            chars = [c for c in PRINTABLE if fits.match(c)] or [" "]
            few = [c for c in chars if c in FILLER] or chars
            out.append(few[len(out) % len(few)])
        elif part not in (r"\b", r"\z", "^", "$"):
            out.append(part[-1])

    walk(0, len(pattern))
    return "".join(out)


@lru_cache(maxsize=1)
def samples() -> list[tuple[int, str, str, str]]:
    """Number, rule id, path and line for every built-in rule; the line names the first keyword."""
    rows = []
    for k, r in enumerate(builtin_rules()):
        text = example(r.regex)
        end = "x" if r.regex.endswith(r"=)\b") or r.regex.endswith(r"=))\b") else ""  # a boundary after a sign needs a word character
        line = text if r.id == "dotenv-secret" else f"{r.keywords[0]} {text}{end} ."
        rows.append((k, r.id, EXAMPLE_PATHS.get(r.id, "a/b.txt"), line))
    return rows
