"""Rules, allowlists and required patterns as plain values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Allowlist:
    """Suppresses a finding. The checks that are present must pass: any of them, or all with condition AND."""

    description: str = ""
    paths: tuple[str, ...] = ()
    regexes: tuple[str, ...] = ()
    commits: tuple[str, ...] = ()
    stop_words: tuple[str, ...] = ()
    regex_target: str = "secret"  # secret, match or line
    condition: str = "OR"


@dataclass(frozen=True)
class Required:
    """A pattern that must stand near a match: within so many lines (0: any line around it) and, on the same line, columns."""

    id: str
    regex: str
    within_lines: int = 0
    within_columns: int = 0


@dataclass(frozen=True)
class Rule:
    id: str
    regex: str
    description: str = ""
    secret_group: int = 0
    entropy: float = 0.0
    path: str = ""
    keywords: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    allowlists: tuple[Allowlist, ...] = ()
    required: tuple[Required, ...] = ()
