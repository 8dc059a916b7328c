"""A small sandboxed template language, compiled to Python closures.

A template is parsed into a syntax tree, constants are folded, and each node becomes a closure
that appends to a list of parts; no Python source is made or run. Templates reach only the
values they are given, by key or index: there are no attributes, calls or imports, and a missing
key is an empty text. Marks ``{% generation %} ... {% endgeneration %}`` record which characters
of the output the model is to learn.

    {{ expression }}                         a value as text
    {% for x in expression %} ... {% endfor %}   with loop.index, loop.first, loop.last, loop.length
    {% if a %} ... {% elif b %} ... {% else %} ... {% endif %}
    {% set name = expression %}

Expressions are texts, whole numbers, true, false, none, names, ``a.key``, ``a[i]``, ``not``,
``and``, ``or``, the comparisons with ``in``, ``+ - * %`` on numbers, ``~`` to join texts, and
filters: ``x | trim``. White space next to ``{%-``, ``-%}``, ``{{-`` and ``-}}`` is removed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

TAGS = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\})", re.DOTALL)
TOKENS = re.compile(
    r"""\s*(?:(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)"""
    r"""|(?P<sign>==|!=|<=|>=|[=<>|.\[\]()+*%~-]))""",
    re.DOTALL,
)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
CONSTANTS = {"true": True, "false": False, "none": None}
COMPARE: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
}
SUM = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "~": lambda a, b: as_text(a) + as_text(b)}
PRODUCT = {"*": lambda a, b: a * b, "%": lambda a, b: a % b}
FILTERS: dict[str, Callable[[Any], Any]] = {
    "trim": lambda x: as_text(x).strip(),
    "upper": lambda x: as_text(x).upper(),
    "lower": lambda x: as_text(x).lower(),
    "length": lambda x: len(x),
}


class TemplateError(ValueError):
    """The template is not well formed, or asks for what the sandbox does not give."""


def as_text(value: Any) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (str, int)):
        return str(value)
    raise TemplateError("only texts, numbers and truth values can be written")


# ---------------------------------------------------------------- syntax tree


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Apply:
    """A function without effects; ``lazy`` is "and" or "or" where not all parts may be evaluated."""

    function: Callable[..., Any]
    parts: tuple
    lazy: str = ""


@dataclass(frozen=True)
class Write:
    value: Any


@dataclass(frozen=True)
class Set:
    name: str
    value: Any


@dataclass(frozen=True)
class If:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


def _key(holder: Any, key: Any) -> Any:
    if isinstance(holder, Mapping):
        return holder.get(key)
    if isinstance(holder, (list, tuple, str)) and isinstance(key, int) and not isinstance(key, bool):
        return holder[key] if -len(holder) <= key < len(holder) else None
    if holder is None:
        return None
    raise TemplateError("only keys of records and places of lists can be read")


class Expressions:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, source: str, filters: Mapping[str, Callable]):
        self.filters, self.tokens, at = filters, [], 0
        while source[at:].strip():
            found = TOKENS.match(source, at)
            if not found:
                raise TemplateError(f"cannot read {source[at:].strip()[:20]!r}")
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            at = found.end()
        self.at = 0

    def take(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] in ("sign", "name") and self.tokens[self.at][1] in values:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing")

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} is not expected")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def expression(self) -> Any:
        left = self.both()
        while self.take("or"):
            left = Apply(lambda a, b: a or b, (left, self.both()), "or")
        return left

    def both(self) -> Any:
        left = self.negation()
        while self.take("and"):
            left = Apply(lambda a, b: a and b, (left, self.negation()), "and")
        return left

    def negation(self) -> Any:
        return Apply(lambda a: not a, (self.negation(),)) if self.take("not") else self.comparison()

    def comparison(self) -> Any:
        left = self.chain(SUM, lambda: self.chain(PRODUCT, self.filtered))
        sign = self.take(*COMPARE)
        if not sign:
            return left
        return Apply(COMPARE[sign], (left, self.chain(SUM, lambda: self.chain(PRODUCT, self.filtered))))

    def chain(self, signs: Mapping[str, Callable], operand: Callable[[], Any]) -> Any:
        left = operand()
        while sign := self.take(*signs):
            left = Apply(signs[sign], (left, operand()))
        return left

    def filtered(self) -> Any:
        value = self.value()
        while self.take("|"):
            name = self.name()
            if name not in self.filters:
                raise TemplateError(f"no filter {name!r}")
            value = Apply(self.filters[name], (value,))
        return value

    def value(self) -> Any:
        if self.take("("):
            value = self.expression()
            self.need(")")
        elif self.at >= len(self.tokens):
            raise TemplateError("a value is missing")
        else:
            kind, token = self.tokens[self.at]
            self.at += 1
            if kind == "number":
                value = Const(int(token))
            elif kind == "text":
                value = Const(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.DOTALL))
            elif kind == "name":
                value = Const(CONSTANTS[token]) if token in CONSTANTS else Name(token)
            else:
                raise TemplateError(f"{token!r} is not expected")
        while sign := self.take(".", "["):
            if sign == ".":
                value = Apply(_key, (value, Const(self.name())))
            else:
                value = Apply(_key, (value, self.expression()))
                self.need("]")
        return value


@dataclass
class Parser:
    filters: Mapping[str, Callable]
    parts: list[str] = field(default_factory=list)
    at: int = 0

    def parse(self, source: str) -> tuple:
        self.parts = TAGS.split(source)
        for i in range(1, len(self.parts), 2):
            if self.parts[i][2] == "-":
                self.parts[i - 1] = self.parts[i - 1].rstrip()
            if self.parts[i][-3] == "-":
                self.parts[i + 1] = self.parts[i + 1].lstrip()
        body, closing, _ = self.block(())
        if closing:
            raise TemplateError(f"{closing!r} is not expected")
        return body

    def block(self, until: tuple[str, ...]) -> tuple[tuple, str, Expressions | None]:
        """Nodes up to one of the closing words, that word, and what follows it in its tag."""
        nodes: list[Any] = []
        while self.at < len(self.parts):
            part, tag = self.parts[self.at], self.at % 2 == 1
            self.at += 1
            if not tag:
                if part:
                    nodes.append(Write(Const(part)))
                continue
            rest = Expressions(part[2:-2].strip("-"), self.filters)
            if part.startswith("{{"):
                nodes.append(Write(rest.expression()))
                rest.end()
                continue
            word = rest.name()
            if word in until:
                return tuple(nodes), word, rest
            nodes.append(self.statement(word, rest))
        if until:
            raise TemplateError(f"{until[-1]!r} is missing")
        return tuple(nodes), "", None

    def statement(self, word: str, rest: Expressions) -> Any:
        if word == "if":
            return self.condition(rest)
        if word == "for":
            name = rest.name()
            rest.need("in")
            over = rest.expression()
            rest.end()
            return For(name, over, self.block(("endfor",))[0])
        if word == "set":
            name = rest.name()
            rest.need("=")
            value = rest.expression()
            rest.end()
            return Set(name, value)
        if word == "generation":
            rest.end()
            return Generation(self.block(("endgeneration",))[0])
        raise TemplateError(f"{word!r} is not a statement")

    def condition(self, rest: Expressions) -> If:
        test = rest.expression()
        rest.end()
        then, word, rest = self.block(("elif", "else", "endif"))
        other: tuple = ()
        if word == "elif":
            other = (self.condition(rest),)
        elif word == "else":
            other = self.block(("endif",))[0]
        return If(test, then, other)


# ---------------------------------------------------------------- folding and closures


def fold(node: Any) -> Any:
    """The same tree with constant expressions evaluated, dead branches dropped and texts joined."""
    if isinstance(node, Apply):
        parts = tuple(map(fold, node.parts))
        if node.lazy and isinstance(parts[0], Const):
            decided = bool(parts[0].value) == (node.lazy == "or")
            return parts[0] if decided else parts[1]
        if all(isinstance(p, Const) for p in parts):
            return Const(node.function(*(p.value for p in parts)))
        return Apply(node.function, parts, node.lazy)
    if isinstance(node, Write):
        return Write(fold(node.value))
    if isinstance(node, Set):
        return Set(node.name, fold(node.value))
    if isinstance(node, If):
        test = fold(node.test)
        if isinstance(test, Const):
            return fold_all(node.then if test.value else node.other)
        return If(test, fold_all(node.then), fold_all(node.other))
    if isinstance(node, For):
        return For(node.name, fold(node.over), fold_all(node.body))
    if isinstance(node, Generation):
        return Generation(fold_all(node.body))
    return node


def fold_all(nodes: tuple) -> tuple:
    out: list[Any] = []
    for node in map(fold, nodes):
        for n in node if isinstance(node, tuple) else (node,):
            both = isinstance(n, Write) and isinstance(n.value, Const)
            if both and out and isinstance(out[-1], Write) and isinstance(out[-1].value, Const):
                out[-1] = Write(Const(as_text(out[-1].value.value) + as_text(n.value.value)))
            else:
                out.append(n)
    return tuple(out)


class Output:
    """The parts written so far, their length, and the spans under the marks."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


Values = dict[str, Any]


def _value(node: Any) -> Callable[[Values], Any]:
    if isinstance(node, Const):
        return lambda values, constant=node.value: constant
    if isinstance(node, Name):
        return lambda values, name=node.name: values.get(name)
    parts = tuple(map(_value, node.parts))
    if node.lazy == "and":
        return lambda values: parts[0](values) and parts[1](values)
    if node.lazy == "or":
        return lambda values: parts[0](values) or parts[1](values)
    if len(parts) == 1:
        return lambda values, f=node.function, a=parts[0]: f(a(values))
    return lambda values, f=node.function, a=parts[0], b=parts[1]: f(a(values), b(values))


def _run(nodes: tuple) -> Callable[[Values, Output], None]:
    steps = tuple(map(_step, nodes))

    def run(values: Values, out: Output) -> None:
        for step in steps:
            step(values, out)

    return run


def _step(node: Any) -> Callable[[Values, Output], None]:
    if isinstance(node, Write):
        if isinstance(node.value, Const):
            return lambda values, out, text=as_text(node.value.value): out.write(text)
        return lambda values, out, value=_value(node.value): out.write(as_text(value(values)))
    if isinstance(node, Set):
        value = _value(node.value)
        return lambda values, out: values.__setitem__(node.name, value(values))
    if isinstance(node, If):
        test, then, other = _value(node.test), _run(node.then), _run(node.other)
        return lambda values, out: (then if test(values) else other)(values, out)
    if isinstance(node, For):
        return _loop(node)
    body = _run(node.body)

    def generation(values: Values, out: Output) -> None:
        start = out.length
        body(values, out)
        if out.length > start:
            out.spans.append((start, out.length))

    return generation


def _loop(node: For) -> Callable[[Values, Output], None]:
    over, body = _value(node.over), _run(node.body)

    def loop(values: Values, out: Output) -> None:
        items = over(values) or ()
        if not isinstance(items, (list, tuple)):
            raise TemplateError("only lists can be looped over")
        outer = {name: values.get(name) for name in (node.name, "loop")}
        for i, item in enumerate(items):
            values[node.name] = item
            values["loop"] = {"index": i + 1, "first": i == 0, "last": i == len(items) - 1, "length": len(items)}
            body(values, out)
        values.update(outer)

    return loop


def compiled(source: str, filters: Mapping[str, Callable] | None = None) -> Callable[..., tuple[str, list[tuple[int, int]]]]:
    """A function of the template's values that gives the text and its learned spans."""
    run = _run(fold_all(Parser({**FILTERS, **(filters or {})}).parse(source)))

    def render(**values: Any) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        run(dict(values), out)
        return "".join(out.parts), out.spans

    return render
