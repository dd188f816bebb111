"""Chat formatting by a template compiler.

The template language is a small sandbox: text, ``{{ expression }}``,
``{% for x in messages %}`` (with ``loop.index``, ``index0``, ``first`` and ``last``),
``{% if %} / {% elif %} / {% else %}``, ``{% set x = expression %}``, which holds to the end
of the loop's turn, ``{# comment #}`` and ``{% generation %}``, which marks what carries loss; a
minus inside a tag's bracket takes the white space next to it away. Expressions have literals,
names, ``x.field``, ``== != in + and or not``, ``is`` with the tests of ``TESTS``, parentheses and the
filters of ``FILTERS``; nothing else can be reached from a template. ``parse`` gives a syntax
tree, ``fold`` computes what is constant, and ``compile_template`` turns the tree
into Python closures. A closure sends pieces of output to ``emit`` with their mask.

``escape`` makes control strings inside texts harmless and can be undone:
backslashes are doubled, and a backslash goes after the first character of
every control string. ``Reader`` reads the turns and the loss text back.

Conversations are dealt by id and sorted by turn; a task streams through its rows,
so that it holds two turns at a time, however long the conversation is. (A digest
over a whole conversation is sequential; a hot one costs time, not memory.)

Defined results: a null role or text is empty; rows with equal turns are ordered
by role and text and all count; null turns come first; a null id is a
conversation of its own; an empty table gives no conversations; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>\n"
#: Strings that mean something to chat models.
CONTROL = ("<|turn|>", "<|end|>", "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
DEFAULT = (
    "{% for m in messages %}<|turn|>{{ m.role | escape_line }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "<|end|>\n{% endfor %}"
)

_CONTROL = re.compile("(?=" + "|".join(map(re.escape, CONTROL)) + ")(.)", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """No control string is left; ``unescape`` undoes it."""
    return _CONTROL.sub(r"\1\\", text.replace("\\", "\\\\"))


def escape_line(text: str) -> str:
    """``escape`` for text that must stay on one line."""
    return escape(text).replace("\n", "\\n")


def unescape(text: str) -> str:
    """What ``escape`` or ``escape_line`` was given. (No control string has n as its second character.)"""
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "escape_line": escape_line, "trim": str.strip, "upper": str.upper, "lower": str.lower}

TESTS: dict[str, Callable[[Any], bool]] = {"defined": lambda v: v is not None, "none": lambda v: v is None, "string": lambda v: isinstance(v, str), "number": lambda v: isinstance(v, int)}


class TemplateError(ValueError):
    """The template is not of the language."""


_TAG = re.compile(r"\{\{(-?)(?P<print>.*?)(-?)\}\}|\{%(-?)(?P<tag>.*?)(-?)%\}|\{#(-?).*?(-?)#\}", re.DOTALL)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z][A-Za-z0-9_]*)|(==|!=|[+|.()]))")
_LETTERS = {"n": "\n", "t": "\t"}


class _Expression:
    """Recursive descent over one expression: or, and, not, comparison, sum, filters, field, atom."""

    def __init__(self, source: str) -> None:
        self.tokens: list[tuple[str, Any]] = []
        source, at = source.strip(), 0
        while at < len(source):
            match = _TOKEN.match(source, at)
            if not match:
                raise TemplateError(f"can't read {source[at:]!r}")
            text, number, name, sign = match.groups()
            if text is not None:
                self.tokens.append(("value", re.sub(r"\\(.)", lambda m: _LETTERS.get(m[1], m[1]), text[1:-1], flags=re.DOTALL)))
            elif number is not None:
                self.tokens.append(("value", int(number)))
            else:
                self.tokens.append(("name", name) if name is not None else ("sign", sign))
            at = match.end()
        self.at = 0

    def took(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens):
            kind, value = self.tokens[self.at]
            if kind != "value" and value in wanted:
                self.at += 1
                return value
        return None

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name is missing")

    def whole(self) -> tuple:
        tree = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def either(self) -> tuple:
        tree = self.both()
        while self.took("or"):
            tree = ("or", tree, self.both())
        return tree

    def both(self) -> tuple:
        tree = self.negated()
        while self.took("and"):
            tree = ("and", tree, self.negated())
        return tree

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.took("not") else self.compared()

    def compared(self) -> tuple:
        tree = self.added()
        while sign := self.took("==", "!=", "in", "not", "is"):
            if sign == "is":
                barred, test = self.took("not"), self.name()
                if test not in TESTS:
                    raise TemplateError(f"no test {test!r}")
                tree = ("not", ("is", tree, test)) if barred else ("is", tree, test)
            elif sign == "not":
                if not self.took("in"):
                    raise TemplateError("after a value, not needs in")
                tree = ("not", ("in", tree, self.added()))
            else:
                tree = (sign, tree, self.added())
        return tree

    def added(self) -> tuple:
        tree = self.filtered()
        while self.took("+"):
            tree = ("+", tree, self.filtered())
        return tree

    def filtered(self) -> tuple:
        tree = self.atom()
        while True:
            if self.took("."):
                tree = ("field", tree, self.name())
            elif self.took("|"):
                name = self.name()
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                tree = ("filter", tree, name)
            else:
                return tree

    def atom(self) -> tuple:
        if self.took("("):
            tree = self.either()
            if not self.took(")"):
                raise TemplateError("a bracket is open")
            return tree
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, value = self.tokens[self.at]
        if kind == "sign":
            raise TemplateError(f"unexpected {value!r}")
        self.at += 1
        if kind == "name" and value in ("true", "false"):
            return ("value", value == "true")
        return (kind, value)


def parse(source: str) -> tuple:
    """The syntax tree: ("block", [nodes])."""
    root: list[tuple] = []
    open_tags: list[list] = [["", root]]  # tag, where its nodes go, and for an if its arms

    def put(node: tuple) -> None:
        open_tags[-1][1].append(node)

    at, bare = 0, False

    def put_text(text: str, bare_end: bool) -> None:
        text = text.lstrip() if bare else text
        text = text.rstrip() if bare_end else text
        if text:
            put(("text", text))

    for match in _TAG.finditer(source):
        before, after = [mark == "-" for mark in match.group(1, 3, 4, 6, 7, 8) if mark is not None]
        put_text(source[at : match.start()], before)
        at, bare = match.end(), after
        if match["print"] is not None:
            put(("print", _Expression(match["print"]).whole()))
            continue
        if match["tag"] is None:
            continue
        word, _, rest = match["tag"].strip().partition(" ")
        top = open_tags[-1]
        if word == "for":
            loop = re.fullmatch(r"\s*([A-Za-z]\w*)\s+in\s+([A-Za-z]\w*)\s*", rest)
            if not loop:
                raise TemplateError(f"can't read for {rest!r}")
            open_tags.append(["for", [], loop[1], loop[2]])
        elif word == "set":
            name, sign, value = rest.partition("=")
            if not sign or not re.fullmatch(r"[A-Za-z]\w*", name.strip()):
                raise TemplateError(f"can't read set {rest!r}")
            put(("set", name.strip(), _Expression(value).whole()))
        elif word == "generation":
            open_tags.append(["generation", []])
        elif word == "if":
            arm: list[tuple] = []
            open_tags.append(["if", arm, [(_Expression(rest).whole(), arm)]])
        elif word in ("elif", "else") and top[0] == "if":
            arm = []
            top[2].append((_Expression(rest).whole() if word == "elif" else ("value", True), arm))
            top[1] = arm
        elif word == "end" + top[0] and top[0]:
            open_tags.pop()
            if word == "endif":
                put(("if", [(test, ("block", nodes)) for test, nodes in top[2]]))
            elif word == "endfor":
                put(("for", top[2], top[3], ("block", top[1])))
            else:
                put(("generation", ("block", top[1])))
        else:
            raise TemplateError(f"unexpected {word!r}")
    if len(open_tags) > 1:
        raise TemplateError(f"{open_tags[-1][0]} is open")
    put_text(source[at:], False)
    return ("block", root)


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _apply(kind: str, a: Any, b: Any) -> Any:
    if kind == "==":
        return a == b
    if kind == "!=":
        return a != b
    if kind == "in":
        return _text(a) in b if isinstance(b, str) else isinstance(b, dict) and a in b
    if kind == "+":
        return a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b)
    return (a or b) if kind == "or" else (a and b)


def fold(node: tuple) -> tuple:
    """The same tree with constants computed, dead arms gone and neighbouring text joined."""
    kind = node[0]
    if kind in ("==", "!=", "in", "+", "or", "and"):
        a, b = fold(node[1]), fold(node[2])
        if a[0] == b[0] == "value":
            return ("value", _apply(kind, a[1], b[1]))
        return (kind, a, b)
    if kind == "not":
        a = fold(node[1])
        return ("value", not a[1]) if a[0] == "value" else ("not", a)
    if kind == "is":
        a = fold(node[1])
        return ("value", TESTS[node[2]](a[1])) if a[0] == "value" else ("is", a, node[2])
    if kind == "set":
        return ("set", node[1], fold(node[2]))
    if kind == "filter":
        a = fold(node[1])
        return ("value", FILTERS[node[2]](_text(a[1]))) if a[0] == "value" else ("filter", a, node[2])
    if kind == "field":
        return ("field", fold(node[1]), node[2])
    if kind == "print":
        a = fold(node[1])
        return ("text", _text(a[1])) if a[0] == "value" else ("print", a)
    if kind == "generation":
        return ("generation", fold(node[1]))
    if kind == "for":
        return ("for", node[1], node[2], fold(node[3]))
    if kind == "if":
        arms = []
        for test, body in node[1]:
            test = fold(test)
            if test[0] == "value" and not test[1]:
                continue
            arms.append((test, fold(body)))
            if test[0] == "value":
                break
        if arms and arms[0][0][0] == "value":
            return arms[0][1]
        return ("if", arms)
    if kind == "block":
        out: list[tuple] = []
        for child in map(fold, node[1]):
            for part in child[1] if child[0] == "block" else [child]:
                if part[0] == "text" and out and out[-1][0] == "text":
                    out[-1] = ("text", out[-1][1] + part[1])
                else:
                    out.append(part)
        return ("block", out)
    return node


_NO_MORE = object()
Emit = Callable[[str, bool], None]
Scope = dict[str, Any]


def _value(node: tuple) -> Callable[[Scope], Any]:
    kind = node[0]
    if kind == "value":
        return lambda scope: node[1]
    if kind == "name":
        return lambda scope: scope.get(node[1])
    a = _value(node[1])
    if kind == "field":
        name = node[2]
        return lambda scope: x.get(name) if isinstance(x := a(scope), dict) else None
    if kind == "filter":
        change = FILTERS[node[2]]
        return lambda scope: change(_text(a(scope)))
    if kind == "is":
        test = TESTS[node[2]]
        return lambda scope: test(a(scope))
    if kind == "not":
        return lambda scope: not a(scope)
    b = _value(node[2])
    if kind == "and":
        return lambda scope: a(scope) and b(scope)
    if kind == "or":
        return lambda scope: a(scope) or b(scope)
    return lambda scope: _apply(kind, a(scope), b(scope))


def _action(node: tuple, masked: bool) -> Callable[[Scope, Emit], None]:
    kind = node[0]
    if kind == "text":
        text = node[1]
        return lambda scope, emit: emit(text, masked)
    if kind == "print":
        value = _value(node[1])
        return lambda scope, emit: emit(_text(value(scope)), masked)
    if kind == "set":
        kept = _value(node[2])
        return lambda scope, emit: scope.__setitem__(node[1], kept(scope))
    if kind == "generation":
        return _action(node[1], True)
    if kind == "if":
        arms = [(_value(test), _action(body, masked)) for test, body in node[1]]

        def choose(scope: Scope, emit: Emit) -> None:
            for test, body in arms:
                if test(scope):
                    return body(scope, emit)

        return choose
    if kind == "for":
        _, name, over, tree = node
        body = _action(tree, masked)

        def loop(scope: Scope, emit: Emit) -> None:
            items = iter(scope.get(over) or ())
            item = next(items, _NO_MORE)
            n = scope["_start"]
            while item is not _NO_MORE:
                later = next(items, _NO_MORE)
                place = {"index": n + 1, "index0": n, "first": n == 0, "last": later is _NO_MORE and not scope["_more"]}
                body({**scope, name: item, "loop": place}, emit)
                item, n = later, n + 1

        return loop
    steps = [_action(child, masked) for child in node[1]]

    def all_steps(scope: Scope, emit: Emit) -> None:
        for step in steps:
            step(scope, emit)

    return all_steps


@cache
def compile_template(source: str) -> Callable[..., None]:
    """A function that renders messages, which may be an iterator, piece by piece; loop indexes count from ``start``, and ``more`` tells that others follow."""
    run = _action(fold(parse(source)), False)
    return lambda messages, emit, start=0, more=False: run({"messages": messages, "_start": start, "_more": more}, emit)


def render(messages: Iterable[dict], template: str = DEFAULT) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans in it that carry loss (code points, end exclusive)."""
    pieces: list[str] = []
    spans: list[tuple[int, int]] = []
    size = 0

    def emit(text: str, masked: bool) -> None:
        nonlocal size
        pieces.append(text)
        if masked and text:
            spans.append((size, size + len(text)))
        size += len(text)

    compile_template(template)(messages, emit)
    return "".join(pieces), spans


class Reader:
    """Takes the pieces of output of a template with the turn marks of ``DEFAULT``, reads turns and loss text back and digests them."""

    def __init__(self) -> None:
        self.buffer: list[str] = []
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def feed(self, text: str, masked: bool) -> None:
        self.formatted_chars += len(text)
        if masked:
            plain = unescape(text)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode())
        self.buffer.append(text)
        if not masked and END in text:
            *whole, rest = "".join(self.buffer).split(END)
            self.buffer = [rest]
            for turn in whole:
                role, _, body = turn.removeprefix(TURN).partition("\n")
                self.n_turns += 1
                self.turns.update(f"{unescape(role)}\n{unescape(body)}\n".encode())


def formatted(rows: DataFrame, template: str = DEFAULT, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Each conversation's pieces of formatted text: id, nth (order), piece, loss (whether it carries loss); to join in that order.

    The template must be one loop over the messages, so that turns can be rendered one by one.
    """
    tree = fold(parse(template))
    if [node[0] for node in tree[1]] != ["for"]:
        raise TemplateError("the template must be one loop")
    return _stream(rows, template, conv, turn, role, text, False)


def digests(rows: DataFrame, template: str = DEFAULT, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation, read back from the formatted text."""
    return _stream(rows, template, conv, turn, role, text, True)


_ROWS = 2000


def _stream(rows: DataFrame, template: str, conv: str, turn: str, role: str, text: str, digest: bool) -> DataFrame:
    compile_template(template)  # errors show on the driver
    empty = F.lit("")
    rows = rows.select(F.col(conv).alias("id"), F.col(turn).alias("turn"), F.coalesce(role, empty).alias("role"), F.coalesce(text, empty).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.repartition("id").sortWithinPartitions("id", "turn", "role", "text").drop("turn")
    if digest:
        names, types = ("id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"), (kind, "bigint", "string", "bigint", "string", "bigint")
    else:
        names, types = ("id", "nth", "piece", "loss"), (kind, "bigint", "string", "boolean")

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema: pa.Schema | None = None
        arrow = [pa.int64() if t == "bigint" else pa.bool_() if t == "boolean" else pa.string() for t in types]
        out: list[tuple] = []
        run = compile_template(template)

        def flat() -> Iterator[tuple]:
            nonlocal schema
            for batch in batches:
                schema = schema or pa.schema([(n, batch.schema.field(0).type if k == 0 else t) for k, (n, t) in enumerate(zip(names, arrow))])
                yield from zip(*(c.to_pylist() for c in batch.columns))

        source = flat()
        ahead = next(source, None)
        while ahead is not None:
            key = ahead[0]

            def messages() -> Iterator[dict]:
                nonlocal ahead
                while ahead is not None and ahead[0] == key:
                    message = {"role": ahead[1], "text": ahead[2]}
                    ahead = next(source, None)
                    yield message

            if digest:
                reader = Reader()
                run(messages(), reader.feed)
                out.append((key, reader.n_turns, reader.turns.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.formatted_chars))
            else:
                nth = 0
                for index, message in enumerate(messages()):
                    pieces: list[tuple] = []
                    run([message], lambda t, m, pieces=pieces: pieces.append((t, m)), index, ahead is not None and ahead[0] == key)
                    for piece, masked in pieces:
                        out.append((key, nth, piece, masked))
                        nth += 1
                    if len(out) >= _ROWS:
                        yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)))), schema)
                        out.clear()
            for _ in messages():
                pass  # what a template without a loop has left
            if len(out) >= _ROWS:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)))), schema)
                out.clear()
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)))), schema)

    return rows.mapInArrow(convert, ", ".join(f"`{n}` {t}" for n, t in zip(names, types)))
