"""A sandboxed template language, compiled to Python closures.

Text stands for itself; {{ expression }} prints; {% for x in e %} .. {% endfor %},
{% if e %} .. {% elif e %} .. {% else %} .. {% endif %}, {% set x = e %} and
{% generation %} .. {% endgeneration %} control; {# .. #} is dropped.  A '-' inside a mark trims
white space beside it.  Expressions have literals, names, dict fields (a.b, a['b']), comparisons,
and, or, not, +, - and filters (e | name).  There are no calls, attributes of objects or imports,
so a template reaches only what it is given.

parse() makes a syntax tree, fold() evaluates its constant parts, compile_template() makes closures.
Rendering streams: a loop may run over any iterator, and pieces come out as they are made.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: Any
    key: Any


@dataclass(frozen=True)
class Apply:
    """An operator or a filter on its operands."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Print:
    value: Any


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class If:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Set:
    name: str
    value: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


_PARTS = re.compile(r"\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\}", re.DOTALL)
_TOKEN = re.compile(r"""\s*(?:(?P<number>\d+)|(?P<string>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<name>[A-Za-z]\w*)|(?P<op>==|!=|<=|>=|[<>+\-|.\[\]()]))""", re.DOTALL)
_WORDS = {"true": True, "false": False, "none": None}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "+": lambda a, b: _text(a) + _text(b) if isinstance(a, str) or isinstance(b, str) else a + b, "-": lambda a, b: a - b,
}
FILTERS: dict[str, Callable] = {"upper": lambda v: _text(v).upper(), "lower": lambda v: _text(v).lower(), "trim": lambda v: _text(v).strip(), "length": lambda v: len(v or "")}


class _Expression:
    """A recursive-descent parser of one expression."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unreadable expression: {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    def take(self, *wanted: str) -> str:
        if self.peek() in wanted and self.tokens[self.at][0] != "string":
            self.at += 1
            return self.tokens[self.at - 1][1]
        return ""

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"expected {wanted!r} at {self.peek()!r}")

    def whole(self):
        e = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.peek()!r}")
        return e

    def either(self):
        e = self.both()
        while self.take("or"):
            e = Apply("or", (e, self.both()))
        return e

    def both(self):
        e = self.negated()
        while self.take("and"):
            e = Apply("and", (e, self.negated()))
        return e

    def negated(self):
        return Apply("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self):
        e = self.added()
        while op := self.take("==", "!=", "<", "<=", ">", ">="):
            e = Apply(op, (e, self.added()))
        return e

    def added(self):
        e = self.filtered()
        while op := self.take("+", "-"):
            e = Apply(op, (e, self.filtered()))
        return e

    def filtered(self):
        e = self.field()
        while self.take("|"):
            e = Apply("|" + self.name(), (e,))
        return e

    def name(self) -> str:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if kind != "name":
            raise TemplateError(f"expected a name at {value!r}")
        self.at += 1
        return value

    def field(self):
        e = self.atom()
        while op := self.take(".", "["):
            if op == ".":
                e = Field(e, Literal(self.name()))
            else:
                e = Field(e, self.either())
                self.need("]")
        return e

    def atom(self):
        if self.take("("):
            e = self.either()
            self.need(")")
            return e
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        self.at += 1
        if kind == "number":
            return Literal(int(value))
        if kind == "string":
            return Literal(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.DOTALL))
        if kind == "name":
            return Literal(_WORDS[value]) if value in _WORDS else Name(value)
        raise TemplateError(f"unexpected {value!r}")


def _marks(source: str) -> list[tuple[str, str]]:
    """(kind, content) of the template's parts: text, {{ or {%."""
    out, at, trim = [], 0, False
    for m in [*_PARTS.finditer(source), None]:
        text = source[at : m.start() if m else len(source)]
        text = text.lstrip() if trim else text
        mark = m[0] if m else ""
        inner = mark[2:-2]
        if inner.startswith("-"):
            text, inner = text.rstrip(), inner[1:]
        trim = inner.endswith("-")
        if text:
            out.append(("text", text))
        if mark and mark[:2] != "{#":
            out.append((mark[:2], inner[:-1].strip() if trim else inner.strip()))
        at = m.end() if m else at
    return out


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    parts, at = _marks(source), 0

    def body(*ends: str) -> tuple[tuple, str]:
        nonlocal at
        nodes = []
        while at < len(parts):
            kind, inner = parts[at]
            at += 1
            if kind == "text":
                nodes.append(Print(Literal(inner)))
            elif kind == "{{":
                nodes.append(Print(_Expression(inner).whole()))
            else:
                word, _, rest = inner.partition(" ")
                if word in ends:
                    return tuple(nodes), inner
                nodes.append(statement(word, rest))
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return tuple(nodes), ""

    def branch(test: str) -> If:
        then, end = body("elif", "else", "endif")
        word, _, rest = end.partition(" ")
        other = (branch(rest),) if word == "elif" else body("endif")[0] if word == "else" else ()
        return If(_Expression(test).whole(), then, other)

    def statement(word: str, rest: str):
        if word == "for":
            m = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest, re.DOTALL)
            if not m:
                raise TemplateError(f"unreadable for: {rest!r}")
            return For(m[1], _Expression(m[2]).whole(), body("endfor")[0])
        if word == "if":
            return branch(rest)
        if word == "set":
            m = re.fullmatch(r"([A-Za-z]\w*)\s*=\s*(.+)", rest, re.DOTALL)
            if not m:
                raise TemplateError(f"unreadable set: {rest!r}")
            return Set(m[1], _Expression(m[2]).whole())
        if word == "generation":
            return Generation(body("endgeneration")[0])
        raise TemplateError(f"unknown statement {word!r}")

    return body()[0]


def fold(node, filters: dict[str, Callable] = FILTERS):
    """The tree with constant expressions evaluated, dead branches gone and neighbouring texts joined."""
    f = lambda x: fold(x, filters)
    if isinstance(node, tuple):
        out: list = []
        for x in map(f, node):
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Print) and isinstance(y.value, Literal) and out and isinstance(out[-1], Print) and isinstance(out[-1].value, Literal):
                    out[-1] = Print(Literal(_text(out[-1].value.value) + _text(y.value.value)))
                else:
                    out.append(y)
        return tuple(out)
    if isinstance(node, Field):
        return Field(f(node.of), f(node.key))
    if isinstance(node, Apply):
        args = tuple(map(f, node.args))
        if all(isinstance(a, Literal) for a in args):
            return Literal(_operation(node.name, filters)(*(lambda v=a.value: v for a in args)))
        return Apply(node.name, args)
    if isinstance(node, Print):
        return Print(f(node.value))
    if isinstance(node, Set):
        return Set(node.name, f(node.value))
    if isinstance(node, Generation):
        return Generation(f(node.body))
    if isinstance(node, For):
        return For(node.name, f(node.over), f(node.body))
    if isinstance(node, If):
        test = f(node.test)
        if isinstance(test, Literal):
            return f(node.then if test.value else node.other)
        return If(test, f(node.then), f(node.other))
    return node


def _operation(name: str, filters: dict[str, Callable]) -> Callable:
    """An operation on operands that are called when they are needed."""
    if name == "and":
        return lambda a, b: a() and b()
    if name == "or":
        return lambda a, b: a() or b()
    if name == "not":
        return lambda a: not a()
    table, key = (filters, name[1:]) if name[0] == "|" else (BINARY, name)
    if key not in table:
        raise TemplateError(f"unknown filter {key!r}")
    run = table[key]
    return lambda *args: run(*(a() for a in args))


def _value(node, filters) -> Callable[[dict], Any]:
    if isinstance(node, Literal):
        return lambda env, v=node.value: v
    if isinstance(node, Name):
        return lambda env, n=node.name: env.get(n)
    if isinstance(node, Field):
        of, key = _value(node.of, filters), _value(node.key, filters)

        def field(env: dict):
            held = of(env)
            return held.get(key(env)) if isinstance(held, dict) else None

        return field
    run, args = _operation(node.name, filters), [_value(a, filters) for a in node.args]
    return lambda env: run(*(lambda a=a: a(env) for a in args))


def _look_ahead(items: Iterable) -> Iterator[tuple[Any, bool]]:
    it = iter(items)
    for held in it:
        for x in it:
            yield held, False
            held = x
        yield held, True


def _block(nodes: tuple, filters) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    """A closure that yields (text, whether it is inside a generation)."""
    made = [_node(n, filters) for n in nodes]

    def run(env: dict):
        for one in made:
            yield from one(env)

    return run


def _node(node, filters) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    if isinstance(node, Print):
        value = _value(node.value, filters)
        return lambda env: ((_text(value(env)), False),)
    if isinstance(node, Set):
        value = _value(node.value, filters)

        def put(env: dict):
            env[node.name] = value(env)
            return ()

        return put
    if isinstance(node, Generation):
        inner = _block(node.body, filters)
        return lambda env: ((text, True) for text, _ in inner(env))
    if isinstance(node, If):
        test, then, other = _value(node.test, filters), _block(node.then, filters), _block(node.other, filters)
        return lambda env: then(env) if test(env) else other(env)
    over, inner = _value(node.over, filters), _block(node.body, filters)

    def loop(env: dict):
        for n, (x, last) in enumerate(_look_ahead(over(env) or ())):
            env |= {node.name: x, "loop": {"index": n + 1, "index0": n, "first": n == 0, "last": last}}
            yield from inner(env)

    return loop


def compile_template(source: str, filters: dict[str, Callable] | None = None) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    """Closures of a template: called with the names it may use, they yield (text, in a generation)."""
    known = FILTERS | (filters or {})
    run = _block(fold(parse(source), known), known)
    return lambda names: run(dict(names))
