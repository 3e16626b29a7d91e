"""A compiler of chat templates: text to a syntax tree, folded, to Python closures.

The language, a small sandbox. Text stands for itself; ``{{ e }}`` gives a value; ``{% %}`` holds statements: ``for x in e`` /
``endfor``, ``if e`` / ``elif e`` / ``else`` / ``endif``, ``set x = e``, ``generation`` / ``endgeneration``; ``{# #}`` is a
comment, and ``{%-``, ``-%}``, ``{{-``, ``-}}`` strip the white space beside them. An expression has strings, integers,
true, false, none, names, ``x.key``, ``x[e]``, ``x | filter``, ``not``, ``and``, ``or``, ``+``, ``~``, ``in``, comparisons,
and ``a if c else b``. A loop sets ``loop.index0``, ``loop.index``, ``loop.first`` and ``loop.last`` and its names end with it.
There are no calls; a key is looked up in a mapping or a list only, never in an object, and what is missing is none, which
gives no text.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

_TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?).*?(-?)#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z][A-Za-z0-9_]*)|(?P<op>==|!=|<=|>=|[<>=+~|.()\[\]]))""", re.S)
_COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
_CONSTANTS = {"true": True, "false": False, "none": None}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
#: A generation marker in what a template gives: the masked text begins, ends.
OPEN, CLOSE = object(), object()


class TemplateError(ValueError):
    """A template that the language does not allow."""


@dataclass
class Node:
    kind: str
    value: Any = None
    parts: list = field(default_factory=list)


def text_of(x: Any) -> str:
    return "" if x is None else str(x)


def _look(x: Any, key: Any) -> Any:
    if isinstance(x, dict):
        return x.get(key)
    if isinstance(x, (list, str)) and isinstance(key, int) and -len(x) <= key < len(x):
        return x[key]
    return None


FILTERS: dict[str, Callable[[Any], Any]] = {
    "trim": lambda x: text_of(x).strip(), "upper": lambda x: text_of(x).upper(), "lower": lambda x: text_of(x).lower(),
    "length": lambda x: len(x) if isinstance(x, (str, list, dict)) else 0,
}


class _Expression:
    """A parser of one expression by descent."""

    def __init__(self, source: str, filters: dict[str, Callable]):
        self.tokens, self.at, self.filters = [], 0, filters
        at, source = 0, source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unreadable: {source[at:at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") else ""

    def take(self, *words: str) -> str:
        w = self.peek()
        if w and w in words:
            self.at += 1
            return w
        return ""

    def need(self, word: str) -> None:
        if not self.take(word):
            raise TemplateError(f"{word!r} expected")

    def name(self) -> str:
        kind, w = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if kind != "name":
            raise TemplateError("a name expected")
        self.at += 1
        return w

    def whole(self) -> Node:
        e = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return e

    def choice(self) -> Node:
        e = self.either()
        if self.take("if"):
            c = self.either()
            e = Node("choice", None, [c, e, self.choice() if self.take("else") else Node("constant")])
        return e

    def either(self) -> Node:
        e = self.both()
        while self.take("or"):
            e = Node("or", None, [e, self.both()])
        return e

    def both(self) -> Node:
        e = self.inverse()
        while self.take("and"):
            e = Node("and", None, [e, self.inverse()])
        return e

    def inverse(self) -> Node:
        return Node("not", None, [self.inverse()]) if self.take("not") else self.comparison()

    def comparison(self) -> Node:
        e = self.sum()
        while w := self.take(*_COMPARE, "in"):
            e = Node("in" if w == "in" else "compare", w, [e, self.sum()])
        return e

    def sum(self) -> Node:
        e = self.piped()
        while w := self.take("+", "~"):
            e = Node("add" if w == "+" else "joined", None, [e, self.piped()])
        return e

    def piped(self) -> Node:
        e = self.looked()
        while self.take("|"):
            w = self.name()
            if w not in self.filters:
                raise TemplateError(f"no filter {w!r}")
            e = Node("filter", w, [e])
        return e

    def looked(self) -> Node:
        e = self.atom()
        while w := self.take(".", "["):
            if w == ".":
                e = Node("look", None, [e, Node("constant", self.name())])
            else:
                e = Node("look", None, [e, self.choice()])
                self.need("]")
        return e

    def atom(self) -> Node:
        if self.take("("):
            e = self.choice()
            self.need(")")
            return e
        if self.at == len(self.tokens):
            raise TemplateError("a value expected")
        kind, w = self.tokens[self.at]
        if kind == "op":
            raise TemplateError(f"unexpected {w!r}")
        self.at += 1
        if kind == "str":
            return Node("constant", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), w[1:-1], flags=re.S))
        if kind == "int":
            return Node("constant", int(w))
        return Node("constant", _CONSTANTS[w]) if w in _CONSTANTS else Node("name", w)


def _statements(source: str) -> list[tuple[str, str]]:
    """(kind, source) of the template's texts, values and statements in order."""
    out, at, strip = [], 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        text = text.rstrip() if m[1] or m[4] or m[7] else text
        if text:
            out.append(("text", text))
        if m[2] is not None:
            out.append(("value", m[2]))
        elif m[5] is not None:
            out.append(("statement", m[5].strip()))
        at, strip = m.end(), bool(m[3] or m[6] or m[8])
    rest = source[at:].lstrip() if strip else source[at:]
    return out + [("text", rest)] if rest else out


def parse(source: str, filters: dict[str, Callable] = FILTERS) -> list[Node]:
    """The syntax tree: a list of nodes."""
    items, at = _statements(source), 0

    def block(*ends: str) -> tuple[list[Node], str]:
        nonlocal at
        nodes: list[Node] = []
        while at < len(items):
            kind, s = items[at]
            at += 1
            if kind == "text":
                nodes.append(Node("text", s))
                continue
            if kind == "value":
                nodes.append(Node("value", None, [_Expression(s, filters).whole()]))
                continue
            word, _, rest = s.partition(" ")
            if word in ends:
                return nodes, s
            if word == "for":
                e = _Expression(rest, filters)
                name = e.name()
                e.need("in")
                over = e.whole()
                nodes.append(Node("for", name, [over, block("endfor")[0]]))
            elif word == "if":
                cases, test = [], _Expression(rest, filters).whole()
                while True:
                    inner, end = block("elif", "else", "endif")
                    cases.append((test, inner))
                    if end == "endif":
                        break
                    test = Node("constant", True) if end == "else" else _Expression(end.partition(" ")[2], filters).whole()
                nodes.append(Node("if", None, cases))
            elif word == "set":
                e = _Expression(rest, filters)
                name = e.name()
                e.need("=")
                nodes.append(Node("set", name, [e.whole()]))
            elif word == "generation":
                nodes.append(Node("generation", None, block("endgeneration")[0]))
            else:
                raise TemplateError(f"unexpected {word!r}")
        if ends:
            raise TemplateError(f"{ends[-1]!r} expected")
        return nodes, ""

    return block()[0]


def _operate(e: Node, filters: dict[str, Callable]) -> Callable[[list], Any]:
    """What an expression does with the values of its parts, for those that read them all."""
    if e.kind == "compare":
        f = _COMPARE[e.value]
        return lambda v: f(v[0], v[1]) if e.value in ("==", "!=") or type(v[0]) is type(v[1]) and v[0] is not None else False
    if e.kind == "filter":
        f = filters[e.value]
        return lambda v: f(v[0])
    return {
        "not": lambda v: not v[0], "look": lambda v: _look(v[0], v[1]), "joined": lambda v: text_of(v[0]) + text_of(v[1]),
        "add": lambda v: v[0] + v[1] if type(v[0]) is int and type(v[1]) is int else text_of(v[0]) + text_of(v[1]),
        "in": lambda v: v[0] in v[1] if isinstance(v[1], (list, dict)) else isinstance(v[1], str) and text_of(v[0]) in v[1],
    }[e.kind]


def folded(e: Node, filters: dict[str, Callable] = FILTERS) -> Node:
    """The expression with every part that is constant as its value."""
    if e.kind in ("constant", "name"):
        return e
    parts = [folded(p, filters) for p in e.parts]
    fixed = parts[0].kind == "constant"
    if e.kind == "choice":
        return parts[1 if parts[0].value else 2] if fixed else Node(e.kind, None, parts)
    if e.kind in ("and", "or"):
        return (parts[1] if bool(parts[0].value) == (e.kind == "and") else parts[0]) if fixed else Node(e.kind, None, parts)
    if all(p.kind == "constant" for p in parts):
        return Node("constant", _operate(e, filters)([p.value for p in parts]))
    return Node(e.kind, e.value, parts)


def folded_all(nodes: list[Node], filters: dict[str, Callable] = FILTERS) -> list[Node]:
    """Nodes with constants folded: values of constants become text, cases that cannot be go, and texts side by side are one."""
    out: list[Node] = []
    for n in nodes:
        made = [n]
        if n.kind == "value":
            e = folded(n.parts[0], filters)
            made = [Node("text", text_of(e.value))] if e.kind == "constant" else [Node("value", None, [e])]
        elif n.kind == "set":
            made = [Node("set", n.value, [folded(n.parts[0], filters)])]
        elif n.kind == "for":
            made = [Node("for", n.value, [folded(n.parts[0], filters), folded_all(n.parts[1], filters)])]
        elif n.kind == "generation":
            made = [Node("generation", None, folded_all(n.parts, filters))]
        elif n.kind == "if":
            cases = []
            for test, inner in n.parts:
                test = folded(test, filters)
                if test.kind == "constant" and not test.value:
                    continue
                cases.append((test, folded_all(inner, filters)))
                if test.kind == "constant":
                    break
            made = cases[0][1] if cases and cases[0][0].kind == "constant" else [Node("if", None, cases)] if cases else []
        for m in made:
            if m.kind == "text" and out and out[-1].kind == "text":
                out[-1] = Node("text", out[-1].value + m.value)
            elif m.kind != "text" or m.value:
                out.append(m)
    return out


def evaluator(e: Node, filters: dict[str, Callable] = FILTERS) -> Callable[[dict], Any]:
    """An expression as a closure over the names."""
    if e.kind == "constant":
        return lambda names, value=e.value: value
    if e.kind == "name":
        return lambda names, key=e.value: names.get(key)
    parts = [evaluator(p, filters) for p in e.parts]
    a, b = parts[0], parts[-1]
    if e.kind == "choice":
        then = parts[1]
        return lambda names: then(names) if a(names) else b(names)
    if e.kind == "and":
        return lambda names: a(names) and b(names)
    if e.kind == "or":
        return lambda names: a(names) or b(names)
    do = _operate(e, filters)
    return (lambda names: do([a(names)])) if len(parts) == 1 else lambda names: do([a(names), b(names)])


Render = Callable[[dict], Iterator[Any]]


def with_last(rows: Iterable) -> Iterator[tuple[Any, bool]]:
    """Each row, and whether it is the last, one row ahead."""
    it = iter(rows)
    for row in it:
        break
    else:
        return
    for later in it:
        yield row, False
        row = later
    yield row, True


def loop(index: int, last: bool) -> dict:
    return {"index0": index, "index": index + 1, "first": index == 0, "last": last}


def renderer(nodes: list[Node], filters: dict[str, Callable] = FILTERS) -> Render:
    """Nodes as a closure that gives texts, OPEN and CLOSE one after the other."""
    steps: list[Render] = []
    for n in nodes:
        if n.kind == "text":
            steps.append(lambda names, out=(n.value,): iter(out))
        elif n.kind == "value":
            steps.append(lambda names, e=evaluator(n.parts[0], filters): iter((text_of(e(names)),)))
        elif n.kind == "set":

            def put(names: dict, e=evaluator(n.parts[0], filters), key=n.value) -> Iterator:
                names[key] = e(names)
                return iter(())

            steps.append(put)
        elif n.kind == "generation":

            def masked(names: dict, inner=renderer(n.parts, filters)) -> Iterator:
                yield OPEN
                yield from inner(names)
                yield CLOSE

            steps.append(masked)
        elif n.kind == "if":

            def cases(names: dict, all_=[(evaluator(t, filters), renderer(i, filters)) for t, i in n.parts]) -> Iterator:
                return next((inner(names) for test, inner in all_ if test(names)), iter(()))

            steps.append(cases)
        else:

            def each(names: dict, over=evaluator(n.parts[0], filters), inner=renderer(n.parts[1], filters), key=n.value) -> Iterator:
                rows = over(names)
                for i, (row, last) in enumerate(with_last(rows if isinstance(rows, (list, Iterator)) else [])):
                    yield from inner({**names, key: row, "loop": loop(i, last)})

            steps.append(each)

    def run(names: dict) -> Iterator[Any]:
        for s in steps:
            yield from s(names)

    return run


class Template:
    """A template over a conversation: it begins, passes once over ``messages``, and ends.

    As a turn is rendered from itself, its place and what was set before the loop, one conversation can be rendered in
    pieces by many tasks, and none needs it whole. A template that reads ``messages`` elsewhere is refused.
    """

    def __init__(self, source: str, filters: dict[str, Callable] | None = None):
        filters = FILTERS | (filters or {})
        nodes = folded_all(parse(source, filters), filters)
        at = [i for i, n in enumerate(nodes) if n.kind == "for" and n.parts[0].kind == "name" and n.parts[0].value == "messages"]
        if len(at) != 1 or sum(_reads(n) for n in nodes) != 1:
            raise TemplateError("a chat template passes over messages once, at its top level, and reads them nowhere else")
        self.key = nodes[at[0]].value
        self._head, self._turn, self._tail = (renderer(x, filters) for x in (nodes[: at[0]], nodes[at[0]].parts[1], nodes[at[0] + 1 :]))

    def turn(self, names: dict, message: dict, index: int, last: bool) -> tuple[str, list[tuple[int, int]]]:
        """A turn's text, with what stands before the first and after the last turn, and the spans of its masked text."""
        names, out, spans, opened, size = dict(names), [], [], [], 0

        def pieces() -> Iterator[Any]:
            head = self._head(names)
            if index == 0:
                yield from head
            else:  # only what it sets is of use
                for _ in head:
                    pass
            yield from self._turn({**names, self.key: message, "loop": loop(index, last)})
            if last:
                yield from self._tail(names)

        for p in pieces():
            if p is OPEN:
                opened.append(size)
            elif p is CLOSE:
                spans.append((opened.pop(), size))
            else:
                out.append(p)
                size += len(p)
        return "".join(out), spans

    def render(self, messages: list[dict], **names: Any) -> tuple[str, list[tuple[int, int]]]:
        """A whole conversation and the spans of its masked text."""
        out, spans, size = [], [], 0
        for i, (m, last) in enumerate(with_last(messages)):
            text, own = self.turn(names, m, i, last)
            spans += [(a + size, b + size) for a, b in own]
            out.append(text)
            size += len(text)
        return "".join(out), spans


def _reads(x: Any) -> int:
    """How often a tree reads ``messages``."""
    if isinstance(x, Node):
        return (x.kind == "name" and x.value == "messages") + _reads(x.parts)
    return sum(map(_reads, x)) if isinstance(x, (list, tuple)) else 0
