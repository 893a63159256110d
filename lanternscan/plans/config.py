"""Configuration files: a small subset of YAML (block and inline lists, quotes, comments), with errors and warnings by line.

Differences from a lenient reading, on purpose: ``required`` conditions of rules are kept, and an allowlist entry may begin with
any of its keys.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field, replace
from pathlib import Path

from lanternscan.rules.model import Allowlist, Required, Rule

LIMIT_BYTES = 2 << 30

# The keys of each block.
TOP = {"exclude_commits", "exclude_paths", "rules", "allowlists", "extend"}
RULE_KEYS = {"id", "description", "regex", "secret_group", "entropy", "path", "keywords", "tags", "allowlists", "required"}
ALLOW_KEYS = {"description", "paths", "regexes", "commits", "stop_words", "regex_target", "condition"}
REQUIRED_KEYS = {"id", "regex", "within_lines", "within_columns"}
EXTEND_KEYS = {"use_default", "path", "disabled_rules"}


class ConfigError(ValueError):
    """A configuration value that cannot be used, with its line."""


@dataclass
class Config:
    exclude_commits: list[str] = field(default_factory=list)
    exclude_paths: list[str] = field(default_factory=list)
    rules: list[Rule] = field(default_factory=list)
    allowlists: list[Allowlist] = field(default_factory=list)
    use_default: bool = True
    extend_path: str = ""
    disabled_rules: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


@dataclass
class _Line:
    no: int
    indent: int
    text: str


def _unquote(value: str) -> str:
    value = value.strip()
    if len(value) >= 2 and value[0] == value[-1] == '"':
        try:
            return ast.literal_eval(value)
        except (ValueError, SyntaxError):
            return value[1:-1]
    return value[1:-1] if len(value) >= 2 and value[0] == value[-1] == "'" else value


def _lines(text: str) -> list[_Line]:
    out = []
    for no, raw in enumerate(text.splitlines(), 1):
        body = raw.lstrip(" \t")
        if body and not body.startswith("#"):
            out.append(_Line(no, len(raw[: len(raw) - len(body)].replace("\t", "  ")), body.rstrip()))
    return out


def _inline_list(value: str) -> list[str]:
    return [_unquote(x) for x in re.findall(r"\"(?:[^\"\\]|\\.)*\"|'[^']*'|[^,\[\]]+", value[1:-1]) if x.strip()]


class _Parser:
    def __init__(self, text: str):
        self.lines, self.at, self.warnings = _lines(text), 0, []

    def block(self, indent: int):
        """The value at this indentation: a mapping of key -> (line, value), or a list."""
        if self.lines[self.at].text.startswith("- ") or self.lines[self.at].text == "-":
            return self.items(self.lines[self.at].indent)
        out = {}
        while self.at < len(self.lines) and self.lines[self.at].indent == indent:
            line = self.lines[self.at]
            if line.text.startswith("- "):
                break
            self.at += 1
            out.update(self.entry(line, indent))
        return out

    def entry(self, line: _Line, indent: int) -> dict:
        key, sep, value = line.text.partition(":")
        if not sep:
            raise ConfigError(f"line {line.no}: expected 'key: value'")
        value = value.strip()
        if value.startswith("[") and value.endswith("]"):
            return {key.strip(): (line.no, _inline_list(value))}
        if value:
            return {key.strip(): (line.no, _unquote(value))}
        deeper = self.at < len(self.lines) and (
            self.lines[self.at].indent > indent or self.lines[self.at].indent == indent and self.lines[self.at].text.startswith("-")
        )
        return {key.strip(): (line.no, self.block(self.lines[self.at].indent) if deeper else [])}

    def items(self, indent: int) -> list:
        out = []
        while self.at < len(self.lines) and self.lines[self.at].indent == indent and self.lines[self.at].text.startswith("-"):
            line = self.lines[self.at]
            body = line.text[1:].lstrip()
            inner = indent + len(line.text) - len(body)
            if re.match(r"[A-Za-z_]+:(\s|$)", body):
                self.lines[self.at] = _Line(line.no, inner, body)
                out.append(self.block(inner))
            else:
                self.at += 1
                out.append(_unquote(body))
        return out

    def known(self, block: dict, keys: set[str], where: str) -> dict:
        for key, (no, _) in block.items():
            if key not in keys:
                self.warnings.append(f"line {no}: unknown key {key!r} in {where}")
        return {k: v for k, v in block.items() if k in keys}


def _number(kind, entry, name: str):
    no, value = entry
    try:
        return kind(value)
    except (TypeError, ValueError) as e:
        raise ConfigError(f"line {no}: {name} must be a number, not {value!r}") from e


def _strings(entry, name: str) -> tuple[str, ...]:
    no, value = entry
    if isinstance(value, dict) or any(not isinstance(x, str) for x in value):
        raise ConfigError(f"line {no}: {name} must be a list of strings")
    return tuple([value] if isinstance(value, str) else value)


def _text(entry) -> str:
    return entry[1] if isinstance(entry[1], str) else ""


def _allowlist(p: _Parser, block) -> Allowlist:
    b = p.known(block, ALLOW_KEYS, "allowlist")
    lists = {k: _strings(b[k], k) for k in ("paths", "regexes", "commits", "stop_words") if k in b}
    target = _text(b["regex_target"]) if "regex_target" in b else "secret"
    condition = _text(b["condition"]) if "condition" in b else "OR"
    if target.lower() not in ("secret", "match", "line"):
        raise ConfigError(f"line {b['regex_target'][0]}: regex_target must be secret, match or line")
    if condition.upper() not in ("AND", "OR"):
        raise ConfigError(f"line {b['condition'][0]}: condition must be AND or OR")
    return Allowlist(description=_text(b["description"]) if "description" in b else "", regex_target=target, condition=condition, **lists)


def _blocks(entry, name: str) -> list[dict]:
    no, value = entry
    if not isinstance(value, list) or any(not isinstance(x, dict) for x in value):
        raise ConfigError(f"line {no}: {name} must be a list of blocks")
    return value


def _rule(p: _Parser, block: dict) -> Rule:
    b = p.known(block, RULE_KEYS, "rule")
    required = []
    for q in _blocks(b["required"], "required") if "required" in b else ():
        q = p.known(q, REQUIRED_KEYS, "required")
        numbers = {k: _number(int, q[k], k) for k in ("within_lines", "within_columns") if k in q}
        required.append(Required(id=_text(q["id"]) if "id" in q else "", regex=_text(q["regex"]) if "regex" in q else "", **numbers))
    return Rule(
        **{k: _text(b[k]) for k in ("id", "description", "regex", "path") if k in b} | ({} if "regex" in b else {"regex": ""}) | ({} if "id" in b else {"id": ""}),
        secret_group=_number(int, b["secret_group"], "secret_group") if "secret_group" in b else 0,
        entropy=_number(float, b["entropy"], "entropy") if "entropy" in b else 0.0,
        **{k: _strings(b[k], k) for k in ("keywords", "tags") if k in b},
        allowlists=tuple(_allowlist(p, a) for a in _blocks(b["allowlists"], "allowlists")) if "allowlists" in b else (),
        required=tuple(required),
    )


def parse(text: str) -> Config:
    p = _Parser(text)
    top = p.known(p.block(p.lines[0].indent) if p.lines else {}, TOP, "configuration")
    c = Config()
    for key in ("exclude_commits", "exclude_paths"):
        if key in top:
            setattr(c, key, list(_strings(top[key], key)))
    c.rules = [_rule(p, b) for b in _blocks(top["rules"], "rules")] if "rules" in top else []
    c.allowlists = [_allowlist(p, b) for b in _blocks(top["allowlists"], "allowlists")] if "allowlists" in top else []
    if "extend" in top:
        e = p.known(top["extend"][1] or {}, EXTEND_KEYS, "extend")
        flag = _text(e["use_default"]).lower() if "use_default" in e else "false"  # a block without it turns built-in rules off
        if flag not in ("true", "false"):
            raise ConfigError(f"line {e['use_default'][0]}: use_default must be true or false")
        c.use_default, c.extend_path = flag == "true", _text(e["path"]) if "path" in e else ""
        c.disabled_rules = list(_strings(e["disabled_rules"], "disabled_rules")) if "disabled_rules" in e else []
    c.warnings = p.warnings
    return c


def safe_relative(path: str) -> str:
    """A relative path that does not step up."""
    if path.startswith("/") or ".." in path.replace("\\", "/").split("/"):
        raise ConfigError(f"path {path!r} must be relative and without '..'")
    return path


def load(path: str) -> Config:
    """A configuration file, with the one it extends put before it (one level)."""
    file = Path(path)
    if file.stat().st_size > LIMIT_BYTES:
        raise ConfigError(f"{path} is larger than 2 GB")
    own = parse(file.read_text(encoding="utf-8"))
    if not own.extend_path:
        return own
    base = parse((file.parent / safe_relative(own.extend_path)).read_text(encoding="utf-8"))
    return replace(
        own, rules=base.rules + own.rules, allowlists=base.allowlists + own.allowlists, exclude_paths=base.exclude_paths + own.exclude_paths,
        exclude_commits=base.exclude_commits + own.exclude_commits, disabled_rules=base.disabled_rules + own.disabled_rules,
        warnings=base.warnings + own.warnings,
    )
