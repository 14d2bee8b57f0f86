"""A small sandboxed template language, compiled to Python closures.

    {{ expression }}                      text of an expression
    {% for m in messages %} {% endfor %}  loop; loop.first, loop.last, loop.index
    {% if e %} {% elif e %} {% else %} {% endif %}
    {% generation %} {% endgeneration %}  marks what a model is trained to produce

Expressions know names, keys (`m.role`, `m['role']`), strings, integers, true, false, `+`, `==`,
`!=`, `and`, `or`, `not`, brackets and filters (`| trim`). There are no calls, and a key only ever
looks into a mapping, so a template reaches nothing but the values it is given.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any


class TemplateError(ValueError):
    """The template does not follow the language."""


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Key:
    of: Any
    key: str


@dataclass(frozen=True)
class Op:
    kind: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    of: Any


@dataclass(frozen=True)
class Show:
    value: Any


@dataclass(frozen=True)
class Loop:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Branch:
    test: Any
    yes: tuple
    no: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


BINARY = {
    "+": operator.add, "==": operator.eq, "!=": operator.ne,
    "and": lambda a, b: a and b, "or": lambda a, b: a or b,
}
TOKEN = re.compile(r"""\s*(?:("[^"]*"|'[^']*')|(\d+)|([A-Za-z_]\w*)|(==|!=|[+|.()\[\]]))""")
TAG = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)


class _Expression:
    def __init__(self, source: str) -> None:
        self.tokens, at, source = [], 0, source.rstrip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unreadable expression: {source!r}")
            self.tokens.append(m.group(m.lastindex) if m.lastindex != 1 else ("'", m[1][1:-1]))
            at = m.end()
        self.at = 0

    def peek(self) -> Any:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self, wanted: str | None = None) -> Any:
        token = self.peek()
        if token is None or wanted is not None and token != wanted:
            raise TemplateError(f"expected {wanted or 'a value'}, found {token!r}")
        self.at += 1
        return token

    def whole(self) -> Any:
        tree = self.either()
        if self.peek() is not None:
            raise TemplateError(f"unexpected {self.peek()!r}")
        return tree

    def _chain(self, below: Callable[[], Any], kinds: tuple[str, ...]) -> Any:
        tree = below()
        while self.peek() in kinds:
            tree = Op(self.take(), (tree, below()))
        return tree

    def either(self) -> Any:
        return self._chain(lambda: self._chain(self.negation, ("and",)), ("or",))

    def negation(self) -> Any:
        if self.peek() == "not":
            self.take()
            return Op("not", (self.negation(),))
        return self._chain(lambda: self._chain(self.filtered, ("+",)), ("==", "!="))

    def filtered(self) -> Any:
        tree = self.atom()
        while self.peek() in (".", "[", "|"):
            kind = self.take()
            if kind == "[":
                key = self.take()
                if not isinstance(key, tuple):
                    raise TemplateError("a key in brackets is a string")
                tree = Key(tree, key[1])
                self.take("]")
            else:
                word = self.take()
                if not isinstance(word, str) or not word.isidentifier():
                    raise TemplateError(f"a name must follow {kind!r}")
                tree = Key(tree, word) if kind == "." else Filter(word, tree)
        return tree

    def atom(self) -> Any:
        token = self.take()
        if isinstance(token, tuple):
            return Const(token[1])
        if token.isdigit():
            return Const(int(token))
        if token == "(":
            tree = self.either()
            self.take(")")
            return tree
        if token in ("true", "false"):
            return Const(token == "true")
        if not token.isidentifier() or token in ("and", "or", "not"):
            raise TemplateError(f"unexpected {token!r}")
        return Name(token)


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    parts = [p for p in TAG.split(source) if p]

    def block(at: int, ends: tuple[str, ...]) -> tuple[list, int, str]:
        body: list = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{{"):
                body.append(Show(_Expression(part[2:-2].strip()).whole()))
                continue
            if not part.startswith("{%"):
                body.append(Show(Const(part)))
                continue
            word, _, rest = part[2:-2].strip().partition(" ")
            if word in ends:
                return body, at, f"{word} {rest}"
            if word == "for":
                name, _, over = rest.strip().partition(" in ")
                if not name.strip().isidentifier():
                    raise TemplateError(f"unreadable loop: {part}")
                inner, at, _ = block(at, ("endfor",))
                body.append(Loop(name.strip(), _Expression(over.strip()).whole(), tuple(inner)))
            elif word == "generation":
                inner, at, _ = block(at, ("endgeneration",))
                body.append(Generation(tuple(inner)))
            elif word == "if":
                branch, at = choice(at, rest)
                body.append(branch)
            else:
                raise TemplateError(f"unknown tag: {part}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return body, at, ""

    def choice(at: int, test: str) -> tuple[Branch, int]:
        tree = _Expression(test.strip()).whole()
        yes, at, end = block(at, ("elif", "else", "endif"))
        no: list = []
        if end.startswith("elif"):
            branch, at = choice(at, end[4:])
            no = [branch]
        elif end.startswith("else"):
            no, at, _ = block(at, ("endif",))
        return Branch(tree, tuple(yes), tuple(no)), at

    return tuple(block(0, ())[0])


def fold(node: Any, filters: Mapping[str, Callable]) -> Any:
    """The tree with constant expressions computed, decided branches chosen and texts joined."""
    if isinstance(node, tuple):
        done: list = []
        for part in (fold(x, filters) for x in node):
            for x in part if isinstance(part, tuple) else (part,):
                last = done[-1] if done else None
                if isinstance(x, Show) and isinstance(x.value, Const):
                    if isinstance(last, Show) and isinstance(last.value, Const):
                        x = Show(Const(_shown(last.value.value) + _shown(x.value.value)))
                        done.pop()
                done.append(x)
        return tuple(done)
    if isinstance(node, Op):
        args = tuple(fold(x, filters) for x in node.args)
        if all(isinstance(x, Const) for x in args):
            values = [x.value for x in args]
            return Const(not values[0] if node.kind == "not" else BINARY[node.kind](*values))
        return Op(node.kind, args)
    if isinstance(node, Filter):
        if node.name not in filters:
            raise TemplateError(f"unknown filter: {node.name}")
        of = fold(node.of, filters)
        return Const(filters[node.name](of.value)) if isinstance(of, Const) else Filter(node.name, of)
    if isinstance(node, Key):
        return Key(fold(node.of, filters), node.key)
    if isinstance(node, Show):
        return Show(fold(node.value, filters))
    if isinstance(node, Loop):
        return Loop(node.name, fold(node.over, filters), fold(node.body, filters))
    if isinstance(node, Generation):
        return Generation(fold(node.body, filters))
    if isinstance(node, Branch):
        test = fold(node.test, filters)
        if isinstance(test, Const):
            return fold(node.yes if test.value else node.no, filters)
        return Branch(test, fold(node.yes, filters), fold(node.no, filters))
    return node


def _shown(value: Any) -> str:
    return "" if value is None else str(value)


class _Out:
    """What a rendering has written: parts, their length in characters, and marked spans."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def _value(node: Any, filters: Mapping[str, Callable]) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):
        return lambda env, n=node.name: env.get(n)
    if isinstance(node, Key):
        of = _value(node.of, filters)

        def look(env: dict, key: str = node.key) -> Any:
            found = of(env)
            return found.get(key) if isinstance(found, Mapping) else None

        return look
    if isinstance(node, Filter):
        of, run = _value(node.of, filters), filters[node.name]
        return lambda env: run(of(env))
    args = [_value(x, filters) for x in node.args]
    if node.kind == "not":
        return lambda env: not args[0](env)
    if node.kind == "and":
        return lambda env: args[0](env) and args[1](env)
    if node.kind == "or":
        return lambda env: args[0](env) or args[1](env)
    run = BINARY[node.kind]
    return lambda env: run(args[0](env), args[1](env))


def _block(body: tuple, filters: Mapping[str, Callable]) -> Callable[[dict, _Out], None]:
    steps = [_step(x, filters) for x in body]

    def run(env: dict, out: _Out) -> None:
        for step in steps:
            step(env, out)

    return run


def _step(node: Any, filters: Mapping[str, Callable]) -> Callable[[dict, _Out], None]:
    if isinstance(node, Show):
        if isinstance(node.value, Const):
            return lambda env, out, t=_shown(node.value.value): out.write(t)
        value = _value(node.value, filters)
        return lambda env, out: out.write(_shown(value(env)))
    if isinstance(node, Branch):
        test, yes, no = _value(node.test, filters), _block(node.yes, filters), _block(node.no, filters)
        return lambda env, out: yes(env, out) if test(env) else no(env, out)
    body = _block(node.body, filters)
    if isinstance(node, Generation):

        def marked(env: dict, out: _Out) -> None:
            start = out.length
            body(env, out)
            out.spans.append((start, out.length))

        return marked
    over = _value(node.over, filters)

    def loop(env: dict, out: _Out) -> None:
        items = list(over(env) or ())
        for i, item in enumerate(items):
            place = {"first": i == 0, "last": i == len(items) - 1, "index": i + 1}
            body({**env, node.name: item, "loop": place}, out)

    return loop


def compile_template(source: str, filters: Mapping[str, Callable] | None = None,
                     ) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from variables to the text and the spans of its generation blocks."""
    known = {"trim": lambda x: _shown(x).strip(), **(filters or {})}
    run = _block(fold(parse(source), known), known)

    def render(env: dict) -> tuple[str, list[tuple[int, int]]]:
        out = _Out()
        run(env, out)
        return "".join(out.parts), out.spans

    return render
