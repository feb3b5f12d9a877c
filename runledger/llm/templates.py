"""A small template language for chats: parsed to a tree, folded, compiled to closures.

Text stands for itself; ``{{ expression }}`` writes a value; the statements are
``{% for name in expression %} .. {% endfor %}``, ``{% if %} .. {% elif %} ..
{% else %} .. {% endif %}``, ``{% set name = expression %}`` and ``{% generation %}
.. {% endgeneration %}``, which marks what it writes. ``-`` at the inner side of
a delimiter strips white space next to it; ``{# .. #}`` is a comment.

Expressions have strings, integers, true, false, none, names, ``a.b`` and ``a['b']``
on mappings, ``+``, ``==``, ``!=``, ``in``, ``and``, ``or``, ``not``, parentheses and
``| filter`` for the filters given. There are no calls and no attributes of
Python objects: a template reaches the values it is given and nothing else.
Inside a loop ``loop.first`` and ``loop.last`` are known. Messages may be any
iterable; they are taken one at a time, one ahead.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping

Piece = tuple[str, bool]  # text, and whether it is generated

_BLOCK = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?).*?(-?)#\}", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[+|.()\[\]]))")
_CONSTANTS = {"true": True, "false": False, "none": None}
_ESCAPES = {"n": "\n", "t": "\t"}


class TemplateError(ValueError):
    pass


def _tokens(source: str) -> list[tuple[str, object]]:
    found, at, end = [], 0, len(source.rstrip())
    while at < end:
        match = _TOKEN.match(source, at)
        if not match:
            raise TemplateError(f"cannot read {source[at:]!r}")
        text, number, name, sign = match.groups()
        if text:
            found.append(("value", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S)))
        elif number:
            found.append(("value", int(number)))
        elif name in _CONSTANTS:
            found.append(("value", _CONSTANTS[name]))
        else:
            found.append(("sign", sign) if sign else ("name", name))
        at = match.end()
    return found


class _Expression:
    """Recursive descent over the tokens of one expression; yields tuples as nodes."""

    def __init__(self, source: str):
        self.tokens, self.at = _tokens(source), 0

    def whole(self):
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def take(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at] in [(k, w) for w in wanted for k in ("name", "sign")]:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} expected")

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("name expected")

    def either(self):
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self):
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        node = self.summed()
        while sign := self.take("==", "!=", "in"):
            node = (sign, node, self.summed())
        return node

    def summed(self):
        node = self.filtered()
        while self.take("+"):
            node = ("+", node, self.filtered())
        return node

    def filtered(self):
        node = self.reached()
        while self.take("|"):
            node = ("filter", self.name(), node)
        return node

    def reached(self):
        node = self.atom()
        while sign := self.take(".", "["):
            if sign == ".":
                node = ("item", node, ("value", self.name()))
            else:
                node = ("item", node, self.either())
                self.need("]")
        return node

    def atom(self):
        if self.take("("):
            node = self.either()
            self.need(")")
            return node
        if self.at >= len(self.tokens):
            raise TemplateError("expression expected")
        kind, value = self.tokens[self.at]
        if kind == "sign":
            raise TemplateError(f"unexpected {value!r}")
        self.at += 1
        return (kind, value)


def parse(source: str) -> list[tuple]:
    """Nodes: ("text", s), ("write", e), ("set", name, e), ("if", [(e, body)..]), ("for", name, e, body), ("mark", body)."""
    parts, at, strip = [], 0, False
    for match in _BLOCK.finditer(source):
        text = source[at : match.start()]
        text = text.lstrip() if strip else text
        left, right = match[1] or match[4] or match[7], match[3] or match[6] or match[8]
        parts.append(("text", text.rstrip() if left else text))
        if match[2] is not None:
            parts.append(("write", match[2]))
        elif match[5] is not None:
            parts.append(("do", match[5].strip()))
        at, strip = match.end(), bool(right)
    parts.append(("text", source[at:].lstrip() if strip else source[at:]))
    place = 0

    def body(*ends: str) -> tuple[list, str]:
        nonlocal place
        nodes = []
        while place < len(parts):
            kind, text = parts[place]
            place += 1
            if kind == "text":
                nodes.append(("text", text))
            elif kind == "write":
                nodes.append(("write", _Expression(text).whole()))
            else:
                word, _, rest = text.partition(" ")
                if word in ends:
                    return nodes, text
                nodes.append(statement(word, rest.strip()))
        if ends:
            raise TemplateError(f"{ends[0]} expected")
        return nodes, ""

    def statement(word: str, rest: str) -> tuple:
        if word == "for":
            match = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
            if not match:
                raise TemplateError(f"cannot read for {rest!r}")
            return ("for", match[1], _Expression(match[2]).whole(), body("endfor")[0])
        if word == "if":
            branches, test = [], _Expression(rest).whole()
            while True:
                nodes, end = body("endif", "elif", "else")
                branches.append((test, nodes))
                if end == "endif":
                    return ("if", branches)
                if end == "else":
                    branches.append((("value", True), body("endif")[0]))
                    return ("if", branches)
                test = _Expression(end.partition(" ")[2]).whole()
        if word == "set":
            name, sign, value = rest.partition("=")
            if not sign or not re.fullmatch(r"[A-Za-z_]\w*", name.strip()):
                raise TemplateError(f"cannot read set {rest!r}")
            return ("set", name.strip(), _Expression(value).whole())
        if word == "generation":
            return ("mark", body("endgeneration")[0])
        raise TemplateError(f"unknown statement {word!r}")

    return body()[0]


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _add(a, b):
    return a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b)


def _item(value, key):
    return value.get(key) if isinstance(value, Mapping) else None


_BINARY = {"+": _add, "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": lambda a, b: a in b if b else False, "item": _item}


def fold_expression(node: tuple, filters: Mapping[str, Callable]) -> tuple:
    """Parts without names become their values."""
    kind = node[0]
    if kind in ("value", "name"):
        return node
    if kind == "filter":
        if node[1] not in filters:
            raise TemplateError(f"unknown filter {node[1]!r}")
        inner = fold_expression(node[2], filters)
        return ("value", filters[node[1]](inner[1])) if inner[0] == "value" else ("filter", node[1], inner)
    inner = [fold_expression(x, filters) for x in node[1:]]
    if kind in ("and", "or") and inner[0][0] == "value":
        return inner[1] if bool(inner[0][1]) == (kind == "and") else inner[0]
    if kind == "not" and inner[0][0] == "value":
        return ("value", not inner[0][1])
    if kind in _BINARY and all(x[0] == "value" for x in inner):
        return ("value", _BINARY[kind](inner[0][1], inner[1][1]))
    return (kind, *inner)


def fold(nodes: list[tuple], filters: Mapping[str, Callable]) -> list[tuple]:
    """Constant expressions become text, neighbouring texts one, and branches that are settled go."""
    out: list[tuple] = []

    def add(node: tuple) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in nodes:
        if node[0] == "write":
            value = fold_expression(node[1], filters)
            add(("text", _text(value[1])) if value[0] == "value" else ("write", value))
        elif node[0] == "set":
            add(("set", node[1], fold_expression(node[2], filters)))
        elif node[0] == "for":
            add(("for", node[1], fold_expression(node[2], filters), fold(node[3], filters)))
        elif node[0] == "mark":
            add(("mark", fold(node[1], filters)))
        elif node[0] == "if":
            branches = []
            for test, body in node[1]:
                test = fold_expression(test, filters)
                if test[0] == "value" and not test[1]:
                    continue
                branches.append((test, fold(body, filters)))
                if test[0] == "value":
                    break
            if branches and branches[0][0][0] == "value":
                for inner in branches[0][1]:
                    add(inner)
            elif branches:
                add(("if", branches))
        else:
            add(node)
    return out


def _value(node: tuple, filters: Mapping[str, Callable]) -> Callable:
    kind = node[0]
    if kind == "value":
        return lambda names, value=node[1]: value
    if kind == "name":
        return lambda names, name=node[1]: names.get(name)
    if kind == "filter":
        apply, inner = filters[node[1]], _value(node[2], filters)
        return lambda names: apply(inner(names))
    parts = [_value(x, filters) for x in node[1:]]
    if kind == "not":
        return lambda names: not parts[0](names)
    if kind == "and":
        return lambda names: parts[0](names) and parts[1](names)
    if kind == "or":
        return lambda names: parts[0](names) or parts[1](names)
    apply = _BINARY[kind]
    return lambda names: apply(parts[0](names), parts[1](names))


def _writer(nodes: list[tuple], filters: Mapping[str, Callable]) -> Callable[[dict, bool], Iterator[Piece]]:
    steps = [_step(node, filters) for node in nodes]

    def write(names: dict, marked: bool) -> Iterator[Piece]:
        for step in steps:
            yield from step(names, marked)

    return write


def _step(node: tuple, filters: Mapping[str, Callable]) -> Callable[[dict, bool], Iterator[Piece]]:
    kind = node[0]
    if kind == "text":

        def text(names, marked, value=node[1]):
            yield value, marked

        return text
    if kind == "write":
        value = _value(node[1], filters)

        def write(names, marked):
            yield _text(value(names)), marked

        return write
    if kind == "set":
        value = _value(node[2], filters)

        def assign(names, marked, name=node[1]):
            names[name] = value(names)
            yield from ()

        return assign
    if kind == "mark":
        inner = _writer(node[1], filters)
        return lambda names, marked: inner(names, True)
    if kind == "if":
        branches = [(_value(test, filters), _writer(body, filters)) for test, body in node[1]]

        def choose(names, marked):
            for test, body in branches:
                if test(names):
                    yield from body(names, marked)
                    return

        return choose
    values, body = _value(node[2], filters), _writer(node[3], filters)

    def repeat(names, marked, name=node[1]):
        ahead, first = iter(values(names) or ()), True
        done = object()
        item = next(ahead, done)
        while item is not done:
            following = next(ahead, done)
            yield from body({**names, name: item, "loop": {"first": first, "last": following is done}}, marked)
            item, first = following, False

    return repeat


def compile_template(source: str, filters: Mapping[str, Callable] | None = None) -> Callable[..., Iterator[Piece]]:
    """A function of the values a template names; it yields (text, generated) pieces."""
    filters = filters or {}
    write = _writer(fold(parse(source), filters), filters)
    return lambda **names: write(names, False)
