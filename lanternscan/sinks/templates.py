"""Report templates: text with actions in double braces, parsed once into a tree and applied to findings in the tasks.

Actions: ``.Field`` and ``.``, variables (``$x := ...``), ``if``/``else if``/``else``, ``range`` with ``else`` and with variables, ``with``, ``len``, ``not``,
``and``, ``or``, ``eq``, ``ne``, ``lt``, ``le``, ``gt``, ``ge``, ``index``, ``print``, ``printf``, ``html``, ``js``, brackets and pipes; a dash inside the braces trims white
space. Outside a range the dot is the list of all findings, of which a template may ask the length and whether there are any.
``$rule_id`` in plain text is a field, too.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

ACTION = re.compile(r"\{\{(-\s)?(.*?)(\s-)?\}\}", re.S)
TOKEN = re.compile(r'\s*("(?:[^"\\]|\\.)*"|`[^`]*`|-?\d+(?:\.\d+)?|\$\w*(?:\.\w+)*|\.\w+(?:\.\w+)*|\.|:=|[(),|]|\w+)')


class TemplateError(ValueError):
    """A template that cannot be parsed, or an action that does not apply."""


class Findings:
    """What the dot is outside a range: all findings, of which only the number is at hand."""

    def __init__(self, count: Callable[[], int]):
        self.count = count

    def __len__(self) -> int:
        return self.count()


@dataclass
class Node:
    kind: str
    text: str = ""
    body: list[Node] = field(default_factory=list)
    other: list[Node] = field(default_factory=list)


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z])(?=[A-Z])", "_", name).lower()


def pieces(template: str) -> Iterator[tuple[str, str]]:
    """Texts and actions in turn, trimmed where a dash asks for it."""
    at, trim = 0, False
    for m in ACTION.finditer(template):
        text = template[at : m.start()]
        text = text.lstrip() if trim else text
        yield "text", text.rstrip() if m[1] else text
        yield "action", m[2].strip()
        at, trim = m.end(), bool(m[3])
    yield "text", template[at:].lstrip() if trim else template[at:]


def parse(template: str) -> list[Node]:
    """The tree of a template."""
    top: list[Node] = []
    stack: list[tuple[Node | None, list[Node]]] = [(None, top)]
    for kind, text in pieces(template):
        here = stack[-1][1]
        if kind == "text":
            if text:
                here.append(Node("text", text))
            continue
        word, _, rest = text.partition(" ")
        if text.startswith("/*"):
            continue
        if word in ("if", "range", "with"):
            node = Node(word, rest.strip())
            here.append(node)
            stack.append((node, node.body))
        elif word == "else" and stack[-1][0]:
            node = stack.pop()[0]
            if rest.strip():  # else if: a condition in the other branch, which the same end closes
                inner = Node(rest.split()[0], rest.strip().partition(" ")[2].strip())
                node.other.append(inner)
                stack.append((inner, inner.body))
            else:
                stack.append((node, node.other))
        elif word == "end" and stack[-1][0]:
            stack.pop()
        elif word in ("else", "end"):
            raise TemplateError(f"{word} without a beginning")
        else:
            here.append(Node("value", text))
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0].kind} without an end")
    return top


def tokens(text: str) -> list[str]:
    out, at = [], 0
    while at < len(text.rstrip()):
        m = TOKEN.match(text, at)
        if not m:
            raise TemplateError(f"cannot read {text[at:]!r}")
        out.append(m[1])
        at = m.end()
    return out


def shown(value) -> str:
    if value is None:
        return "<no value>"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (list, tuple)):
        return f"[{' '.join(map(shown, value))}]"
    if isinstance(value, float):
        return f"{value:g}" if value != int(value) or abs(value) >= 1e21 else str(int(value))
    return str(value)


def printf(form: str, *args) -> str:
    """The verbs s, v, d, q, t, f, g, e, x with flags, and %%."""
    left = list(args)

    def put(m: re.Match) -> str:
        if m[2] == "%":
            return "%"
        if not left:
            return f"%!{m[2]}(MISSING)"
        value = left.pop(0)
        if m[2] == "q":
            return json.dumps(shown(value), ensure_ascii=False)
        if m[2] in "svt":
            return ("%" + m[1] + "s") % shown(value)
        return ("%" + m[1] + m[2]) % value

    return re.sub(r"%([-+ 0#]*\d*(?:\.\d+)?)([svdqtfgex%])", put, form)


def _compare(op: Callable) -> Callable:
    return lambda a, *bs: any(op(a, b) for b in bs)


FUNCTIONS: dict[str, Callable] = {
    "len": len, "not": lambda x: not x, "print": lambda *a: "".join(map(shown, a)), "printf": printf, "html": lambda *a: html.escape("".join(map(shown, a))).replace("&#x27;", "&#39;").replace("&quot;", "&#34;"),
    "js": lambda *a: json.dumps("".join(map(shown, a)), ensure_ascii=False)[1:-1], "index": lambda x, *ks: index(x, ks), "eq": _compare(lambda a, b: a == b), "ne": lambda a, b: a != b,
    "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b,
    "and": lambda *a: next((x for x in a if not x), a[-1]), "or": lambda *a: next((x for x in a if x), a[-1]),
}


def index(value, keys):
    for k in keys:
        value = value[k]
    return value


def evaluate(text: str, dot, names: dict):
    """The value of a pipeline; ``$x := ...`` binds it and gives nothing."""
    parts = tokens(text)
    bound = None
    if len(parts) > 2 and parts[1] == ":=":
        bound, parts = parts[0], parts[2:]

    def fields(value, path: str):
        for name in filter(None, path.split(".")):
            if not isinstance(value, dict) or snake(name) not in value:
                raise TemplateError(f"no field {name}")
            value = value[snake(name)]
        return value

    def operand(at: int):
        x = parts[at]
        if x == "(":
            value, at = pipeline(at + 1)
            if at >= len(parts) or parts[at] != ")":
                raise TemplateError(f"a bracket is open in {text!r}")
            return value, at + 1
        if x[0] in '"`':
            return (json.loads(x) if x[0] == '"' else x[1:-1]), at + 1
        if re.fullmatch(r"-?\d+", x):
            return int(x), at + 1
        if re.fullmatch(r"-?\d+\.\d+", x):
            return float(x), at + 1
        if x in ("true", "false"):
            return x == "true", at + 1
        if x == "nil":
            return None, at + 1
        if x[0] == "$":
            name, _, path = x.partition(".")
            if name not in names:
                raise TemplateError(f"no variable {name}")
            return fields(names[name], path), at + 1
        if x[0] == ".":
            return fields(dot, x), at + 1
        raise TemplateError(f"unknown function {x!r}")

    def command(at: int, *last):
        if parts[at] in FUNCTIONS:
            name, args = parts[at], []
            at += 1
            while at < len(parts) and parts[at] not in ("|", ")"):
                value, at = operand(at)
                args.append(value)
            try:
                return FUNCTIONS[name](*args, *last), at
            except (TypeError, IndexError, KeyError, ValueError) as e:
                raise TemplateError(f"{name}: {e}") from e
        return operand(at)

    def pipeline(at: int):
        value, at = command(at)
        while at < len(parts) and parts[at] == "|":
            value, at = command(at + 1, value)
        return value, at

    if not parts:
        raise TemplateError("an empty action")
    value, at = pipeline(0)
    if at != len(parts):
        raise TemplateError(f"cannot read the end of {text!r}")
    if bound:
        names[bound] = value
        return ""
    return value


def truth(value) -> bool:
    return len(value) > 0 if isinstance(value, Findings) else bool(value)


def loop_of(node: Node) -> tuple[list[str], str]:
    """Names and list of a range: ``$i, $x := list``, ``$x := list`` or ``list``."""
    m = re.match(r"\s*(\$\w+)\s*(?:,\s*(\$\w+)\s*)?:=\s*(.*)", node.text, re.S)
    return ([n for n in (m[1], m[2]) if n], m[3]) if m else ([], node.text)


def render(nodes: list[Node], dot, names: dict) -> str:
    """What a tree gives for a dot. Plain text has ``$field`` placeholders when the dot is a finding."""
    out = []
    for n in nodes:
        if n.kind == "text":
            out.append(re.sub(r"\$(\w+)|\$\{(\w+)\}", lambda m: shown(dot[m[1] or m[2]]) if (m[1] or m[2]) in dot else m[0], n.text) if isinstance(dot, dict) else n.text)
        elif n.kind == "value":
            alone = re.fullmatch(r"\.(\w+)", n.text)
            if alone and isinstance(dot, dict) and snake(alone[1]) not in dot:
                out.append("${" + snake(alone[1]) + "}")  # a field that findings do not have stays visible
            else:
                out.append(shown(evaluate(n.text, dot, names)))
        elif n.kind in ("if", "with"):
            inner = dict(names)
            value = evaluate(n.text.partition(":=")[2] if ":=" in n.text else n.text, dot, inner)
            if ":=" in n.text:
                inner[n.text.partition(":=")[0].strip()] = value
            out.append(render(n.body if truth(value) else n.other, value if n.kind == "with" and truth(value) else dot, inner))
        else:
            bound, over = loop_of(n)
            values = evaluate(over, dot, dict(names))
            if isinstance(values, Findings):
                raise TemplateError("findings are listed outside other actions only")
            for k, value in enumerate(values or []):
                inner = names | dict(zip(bound, (k, value) if len(bound) == 2 else (value,)))
                out.append(render(n.body, value, inner))
            if not values:
                out.append(render(n.other, dot, dict(names)))
    return "".join(out)


def lists_findings(node: Node) -> bool:
    """Whether a node at the top is the range over all findings."""
    return node.kind == "range" and loop_of(node)[1].strip() in (".", "$")
