"""Sandboxed template language, compiled to Python closures.

Source -> tokens -> syntax tree -> constant folding -> closures.  The language
has no calls, no attributes of Python objects and no names but the data given:

* ``{{ expr }}``; ``{% if %}/{% elif %}/{% else %}/{% endif %}``;
  ``{% for x in expr %}/{% endfor %}`` (with ``loop.index``, ``loop.index0``, ``loop.first``);
  ``{% set x = expr %}``; ``{% generation %}/{% endgeneration %}`` marks the
  output that the loss covers; ``{# comment #}``.  ``-`` inside a tag's border
  strips white space on that side.
* expressions: strings, integers, ``true``/``false``/``none``, names, ``a.b``
  and ``a['b']`` on dictionaries, ``+ ~ == != < > <= >= in not and or``,
  ``x if c else y``, parentheses, filters ``upper lower trim length escape`` and ``default(x)``.

A loop takes any iterable, one item at a time, and output goes out piece by
piece, so a conversation of any length renders in constant memory.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import regex

_TAG = regex.compile(r"(\{\{-?|\{%-?|\{#-?)(.*?)(-?\}\}|-?%\}|-?#\})", regex.S)
_LEX = regex.compile(
    r"\s*(?:(?P<str>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~<>()\[\].|=,]))")
_ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}


class TemplateError(ValueError):
    """The template is malformed or uses something that the sandbox does not offer."""


# Syntax tree: tuples whose first item is the kind.
Node = tuple


def _lex(code: str) -> list[tuple[str, Any]]:
    out, at, code = [], 0, code.rstrip()
    while at < len(code):
        found = _LEX.match(code, at)
        if not found:
            raise TemplateError(f"unexpected {code[at:at + 20]!r}")
        kind, at = found.lastgroup, found.end()
        text = found[kind]
        if kind == "str":
            body = regex.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=regex.S)
            out.append(("const", body))
        else:
            out.append(("const", int(text)) if kind == "int" else (kind, text))
    return out


class _Expr:
    def __init__(self, code: str):
        self.items, self.at = _lex(code), 0

    def peek(self, *texts: str) -> bool:
        return self.at < len(self.items) and self.items[self.at][0] != "const" and self.items[self.at][1] in texts

    def take(self, *texts: str) -> str:
        if not self.peek(*texts):
            raise TemplateError(f"expected {' or '.join(texts)}")
        self.at += 1
        return self.items[self.at - 1][1]

    def name(self) -> str:
        if self.at >= len(self.items) or self.items[self.at][0] != "name":
            raise TemplateError("expected a name")
        self.at += 1
        return self.items[self.at - 1][1]

    def whole(self) -> Node:
        node = self.choice()
        if self.at != len(self.items):
            raise TemplateError(f"unexpected {self.items[self.at][1]!r}")
        return node

    def choice(self) -> Node:
        node = self.either()
        if self.peek("if"):
            self.take("if")
            test = self.either()
            self.take("else")
            return ("choice", test, node, self.choice())
        return node

    def either(self) -> Node:
        node = self.both()
        while self.peek("or"):
            self.take("or")
            node = ("or", node, self.both())
        return node

    def both(self) -> Node:
        node = self.negation()
        while self.peek("and"):
            self.take("and")
            node = ("and", node, self.negation())
        return node

    def negation(self) -> Node:
        if self.peek("not"):
            self.take("not")
            return ("not", self.negation())
        node = self.sum()
        while self.peek("==", "!=", "<", ">", "<=", ">=", "in"):
            node = ("op", self.take("==", "!=", "<", ">", "<=", ">=", "in"), node, self.sum())
        return node

    def sum(self) -> Node:
        node = self.filtered()
        while self.peek("+", "~"):
            node = ("op", self.take("+", "~"), node, self.filtered())
        return node

    def filtered(self) -> Node:
        node = self.atom()
        while self.peek("|", ".", "["):
            sign = self.take("|", ".", "[")
            if sign == ".":
                node = ("item", node, ("const", self.name()))
            elif sign == "[":
                node = ("item", node, self.choice())
                self.take("]")
            else:
                name, args = self.name(), []
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                if self.peek("("):
                    self.take("(")
                    args.append(self.choice())
                    self.take(")")
                node = ("filter", name, node, *args)
        return node

    def atom(self) -> Node:
        if self.peek("("):
            self.take("(")
            node = self.choice()
            self.take(")")
            return node
        if self.at < len(self.items):
            kind, value = self.items[self.at]
            if kind == "const":
                self.at += 1
                return ("const", value)
            if kind == "name":
                self.at += 1
                words = {"true": True, "false": False, "none": None}
                return ("const", words[value]) if value in words else ("name", value)
        raise TemplateError("expected a value")


def _text(value: Any) -> str:
    return "" if value is None else str(value)


FILTERS: dict[str, Callable] = {
    "upper": lambda x: _text(x).upper(), "lower": lambda x: _text(x).lower(), "trim": lambda x: _text(x).strip(),
    "length": len, "default": lambda x, y: y if x is None else x, "escape": _text,  # ``escape`` is bound at compile time
}

_OPS: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b,
    "+": lambda a, b: a + b, "~": lambda a, b: _text(a) + _text(b),
}


def parse(source: str) -> list[Node]:
    """The template's statements."""
    pieces: list[tuple[str, str]] = []
    at, strip = 0, False
    for tag in _TAG.finditer(source):
        text = source[at:tag.start()]
        text = text.lstrip() if strip else text
        pieces.append(("text", text.rstrip() if tag[1].endswith("-") else text))
        if tag[1][1] != "#":
            pieces.append(("show" if tag[1][1] == "{" else "do", tag[2].strip()))
        at, strip = tag.end(), tag[3].startswith("-")
    pieces.append(("text", source[at:].lstrip() if strip else source[at:]))
    pos = 0

    def block(*ends: str) -> tuple[list[Node], str, str]:
        nonlocal pos
        body: list[Node] = []
        while pos < len(pieces):
            kind, code = pieces[pos]
            pos += 1
            if kind == "text":
                if code:
                    body.append(("show", ("const", code)))
            elif kind == "show":
                body.append(("show", _Expr(code).whole()))
            else:
                word, _, rest = code.partition(" ")
                if word in ends:
                    return body, word, rest
                body.append(statement(word, rest))
        if ends:
            raise TemplateError(f"expected {' or '.join(ends)}")
        return body, "", ""

    def statement(word: str, rest: str) -> Node:
        if word == "if":
            arms, other, test = [], [], rest
            while True:
                body, end, more = block("elif", "else", "endif")
                arms.append((_Expr(test).whole(), body))
                if end == "elif":
                    test = more
                    continue
                if end == "else":
                    other, _, _ = block("endif")
                return ("if", arms, other)
        if word == "for":
            e = _Expr(rest)
            name = e.name()
            e.take("in")
            over = e.whole()
            return ("for", name, over, block("endfor")[0])
        if word == "set":
            e = _Expr(rest)
            name = e.name()
            e.take("=")
            return ("set", name, e.whole())
        if word == "generation":
            return ("generation", block("endgeneration")[0])
        raise TemplateError(f"no statement {word!r}")

    return block()[0]


def fold(node: Any) -> Any:
    """The tree with constant expressions computed, dead branches gone and neighbouring text joined."""
    if isinstance(node, list):
        out: list[Node] = []
        for x in map(fold, node):
            if x[0] == "block":
                parts = x[1]
            else:
                parts = [x]
            for p in parts:
                if p[0] == "show" and p[1][0] == "const":
                    if not _text(p[1][1]):
                        continue
                    if out and out[-1][0] == "show" and out[-1][1][0] == "const":
                        out[-1] = ("show", ("const", _text(out[-1][1][1]) + _text(p[1][1])))
                        continue
                out.append(p)
        return out
    kind = node[0]
    if kind in ("const", "name"):
        return node
    if kind == "show":
        return ("show", fold(node[1]))
    if kind == "set":
        return ("set", node[1], fold(node[2]))
    if kind == "for":
        return ("for", node[1], fold(node[2]), fold(node[3]))
    if kind == "generation":
        return ("generation", fold(node[1]))
    if kind == "if":
        arms = []
        for test, body in node[1]:
            test = fold(test)
            if test[0] == "const" and not test[1]:
                continue
            if test[0] == "const":
                return ("if", arms, fold(body)) if arms else ("block", fold(body))
            arms.append((test, fold(body)))
        other = fold(node[2])
        return ("if", arms, other) if arms else ("block", other)
    if kind == "op":
        a, b = fold(node[2]), fold(node[3])
        return ("const", _OPS[node[1]](a[1], b[1])) if a[0] == b[0] == "const" else ("op", node[1], a, b)
    if kind == "not":
        a = fold(node[1])
        return ("const", not a[1]) if a[0] == "const" else ("not", a)
    if kind in ("and", "or"):
        a, b = fold(node[1]), fold(node[2])
        if a[0] == "const":
            return b if bool(a[1]) == (kind == "and") else a
        return (kind, a, b)
    if kind == "choice":
        test, yes, no = map(fold, node[1:])
        return (yes if test[1] else no) if test[0] == "const" else ("choice", test, yes, no)
    if kind == "filter":
        args = [fold(x) for x in node[2:]]
        if node[1] != "escape" and all(x[0] == "const" for x in args):
            return ("const", FILTERS[node[1]](*[x[1] for x in args]))
        return ("filter", node[1], *args)
    return ("item", fold(node[1]), fold(node[2]))


class Output:
    """Receives rendered text; ``marked`` tells whether the loss covers it."""

    def __init__(self, write: Callable[[str, bool], None]):
        self.write, self.marked = write, False


Run = Callable[[dict, Output], None]
Value = Callable[[dict], Any]


def _value(node: Node, filters: dict[str, Callable]) -> Value:
    kind = node[0]
    if kind == "const":
        return lambda names, x=node[1]: x
    if kind == "name":
        return lambda names, n=node[1]: names.get(n)
    if kind == "item":
        of, key = _value(node[1], filters), _value(node[2], filters)

        def item(names: dict) -> Any:
            held = of(names)
            return held.get(key(names)) if isinstance(held, dict) else None

        return item
    if kind == "op":
        op, a, b = _OPS[node[1]], _value(node[2], filters), _value(node[3], filters)
        return lambda names: op(a(names), b(names))
    if kind == "not":
        a = _value(node[1], filters)
        return lambda names: not a(names)
    if kind in ("and", "or"):
        a, b = _value(node[1], filters), _value(node[2], filters)
        return (lambda names: a(names) and b(names)) if kind == "and" else (lambda names: a(names) or b(names))
    if kind == "choice":
        test, yes, no = (_value(x, filters) for x in node[1:])
        return lambda names: yes(names) if test(names) else no(names)
    fn, args = filters[node[1]], [_value(x, filters) for x in node[2:]]
    return lambda names: fn(*[a(names) for a in args])


def _run(nodes: list[Node], filters: dict[str, Callable]) -> Run:
    steps = [_step(n, filters) for n in nodes]
    if len(steps) == 1:
        return steps[0]

    def block(names: dict, out: Output) -> None:
        for step in steps:
            step(names, out)

    return block


def _step(node: Node, filters: dict[str, Callable]) -> Run:
    kind = node[0]
    if kind == "show":
        if node[1][0] == "const":
            return lambda names, out, text=_text(node[1][1]): out.write(text, out.marked)
        value = _value(node[1], filters)
        return lambda names, out: out.write(_text(value(names)), out.marked)
    if kind == "set":
        value, name = _value(node[2], filters), node[1]

        def assign(names: dict, out: Output) -> None:
            names[name] = value(names)

        return assign
    if kind == "if":
        arms, other = [(_value(t, filters), _run(b, filters)) for t, b in node[1]], _run(node[2], filters)

        def branch(names: dict, out: Output) -> None:
            for test, body in arms:
                if test(names):
                    return body(names, out)
            return other(names, out)

        return branch
    if kind == "for":
        over, body, name = _value(node[2], filters), _run(node[3], filters), node[1]

        def loop(names: dict, out: Output) -> None:
            inner = dict(names)
            for i, x in enumerate(over(names) or ()):
                inner[name], inner["loop"] = x, {"index0": i, "index": i + 1, "first": i == 0}
                body(inner, out)

        return loop
    body = _run(node[1], filters)

    def generation(names: dict, out: Output) -> None:
        before, out.marked = out.marked, True
        body(names, out)
        out.marked = before

    return generation


class Template:
    """A compiled template.  ``escape`` is what the filter of that name does."""

    def __init__(self, source: str, escape: Callable[[str], str] = _text):
        self.tree = fold(parse(source))
        self._render = _run(self.tree, FILTERS | {"escape": lambda x: escape(_text(x))})

    def stream(self, data: dict[str, Any], write: Callable[[str, bool], None]) -> None:
        """Hand each piece of output, with its mark, to ``write``."""
        self._render(dict(data), Output(write))

    def render(self, data: dict[str, Any]) -> tuple[str, list[tuple[int, int]]]:
        """The text and the marked spans (touching ones are kept apart by their writes)."""
        parts: list[str] = []
        spans: list[tuple[int, int]] = []
        at = 0

        def write(text: str, marked: bool) -> None:
            nonlocal at
            if marked and text:
                spans.append((at, at + len(text)))
            parts.append(text)
            at += len(text)

        self.stream(data, write)
        return "".join(parts), spans
