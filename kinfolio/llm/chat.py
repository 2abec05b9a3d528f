"""Chat formatting: a compiler from a small sandboxed template language to Python closures."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_with_ids

#: Turns with their role, text escaped, the assistant's text marked for the loss.
TEMPLATE = (
    "{% for m in messages %}### {{ m.role | escape_role }}: "
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    " </turn>\n{% endfor %}"
)
#: Strings that have a meaning in the output; inside texts each is broken by a backslash, and so is the backslash itself.
CONTROL = ("###", "</turn>")

TOKEN = re.compile(r"\{%-?\s*(.*?)\s*-?%\}|\{\{-?\s*(.*?)\s*-?\}\}|\{#.*?#\}", re.S)
LEX = re.compile(r"\s*(?:(?P<str>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>+~|.()\[\]%-]))")


class TemplateError(ValueError):
    """The template is not in the language."""


# the syntax tree


@dataclass
class Text:
    value: str


@dataclass
class Const:
    value: Any


@dataclass
class Name:
    name: str


@dataclass
class Get:
    of: Any
    key: Any


@dataclass
class Op:
    op: str
    parts: list


@dataclass
class Filter:
    name: str
    of: Any


@dataclass
class Output:
    of: Any


@dataclass
class If:
    cases: list[tuple[Any, list]]
    other: list


@dataclass
class For:
    name: str
    of: Any
    body: list


@dataclass
class Set:
    name: str
    of: Any


@dataclass
class Generation:
    body: list


def escape(text: str) -> str:
    """Reversible: backslashes double and a backslash breaks every control string."""
    text = text.replace("\\", "\\\\")
    for c in CONTROL:
        text = text.replace(c, "\\" + c)
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": lambda x: escape(shown(x)),
    "trim": lambda x: shown(x).strip(),
    "upper": lambda x: shown(x).upper(),
    "lower": lambda x: shown(x).lower(),
    "length": lambda x: counted(x),
    # a role ends at a bare colon
    "escape_role": lambda x: escape(shown(x)).replace(":", "\\:"),
}


def shown(x: Any) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


def counted(x: Any) -> int:
    """Items or characters; nothing has none."""
    if x is None:
        return 0
    if not isinstance(x, str | list | dict):
        raise TemplateError(f"length of {type(x).__name__}")
    return len(x)


class Parser:
    """Recursive descent over the template's tokens. Nothing of Python is reachable: names are looked up in the context,
    keys in dicts and lists alone, filters in a fixed table."""

    def __init__(self, source: str) -> None:
        self.parts: list[tuple[str, str]] = []
        at = 0
        for m in TOKEN.finditer(source):
            text = source[at : m.start()]
            self.parts.append(("text", text.rstrip() if m.group()[2] == "-" else text))
            if m.group(1) is not None:
                self.parts.append(("tag", m.group(1)))
            elif m.group(2) is not None:
                self.parts.append(("out", m.group(2)))
            at = m.end()
            if m.group()[-3] == "-":
                at += len(source[at:]) - len(source[at:].lstrip())
        self.parts.append(("text", source[at:]))
        self.at = 0

    def block(self, ends: tuple[str, ...]) -> tuple[list, str]:
        """Statements up to a tag that begins with one of ``ends``."""
        body: list = []
        while self.at < len(self.parts):
            kind, value = self.parts[self.at]
            self.at += 1
            if kind == "text":
                if value:
                    body.append(Text(value))
            elif kind == "out":
                body.append(Output(expression(value)))
            else:
                word, _, rest = value.partition(" ")
                if word in ends:
                    return body, value
                body.append(self.tag(word, rest.strip()))
        if ends:
            raise TemplateError(f"no {' or '.join(ends)}")
        return body, ""

    def tag(self, word: str, rest: str) -> Any:
        if word == "for":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"for {rest}")
            return For(m[1], expression(m[2]), self.block(("endfor",))[0])
        if word == "if":
            cases, other, test = [], [], rest
            while True:
                body, end = self.block(("elif", "else", "endif"))
                if test is None:
                    other = body
                else:
                    cases.append((expression(test), body))
                if end == "endif":
                    return If(cases, other)
                if test is None:
                    raise TemplateError("a branch after else")
                test = end[4:].strip() if end.startswith("elif") else None
        if word == "set":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s*=(?!=)\s*(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"set {rest}")
            return Set(m[1], expression(m[2]))
        if word == "generation":
            return Generation(self.block(("endgeneration",))[0])
        raise TemplateError(f"unknown tag {word}")


def expression(source: str) -> Any:
    tokens, at = [], 0
    while source[at:].strip():
        m = LEX.match(source, at)
        if not m:
            raise TemplateError(f"at {source[at:]!r}")
        tokens.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    pos = 0

    def peek() -> tuple[str | None, str]:
        return tokens[pos] if pos < len(tokens) else (None, "")

    def take(value: str | None = None) -> str:
        nonlocal pos
        kind, got = peek()
        if kind is None or value is not None and got != value:
            raise TemplateError(f"{value or 'more'} expected in {source!r}")
        pos += 1
        return got

    def chain(ops: tuple[str, ...], below: Callable[[], Any], kinds: tuple[str, ...]) -> Any:
        left = below()
        while peek()[0] in kinds and peek()[1] in ops:
            left = Op(take(), [left, below()])
        return left

    def either() -> Any:
        return chain(("or",), both, ("name",))

    def both() -> Any:
        return chain(("and",), negated, ("name",))

    def negated() -> Any:
        if peek() == ("name", "not"):
            take()
            return Op("not", [negated()])
        return chain(("==", "!=", "<", ">", "<=", ">="), added, ("op",))

    def added() -> Any:
        return chain(("+", "~", "-", "%"), filtered, ("op",))

    def filtered() -> Any:
        left = single()
        while peek() == ("op", "|"):
            take()
            name = take()
            if name not in FILTERS:
                raise TemplateError(f"unknown filter {name}")
            left = Filter(name, left)
        return left

    def single() -> Any:
        kind, value = peek()
        take()
        if kind == "str":
            node: Any = Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), value[1:-1]))
        elif kind == "num":
            node = Const(int(value))
        elif kind == "name" and value in ("true", "false", "none"):
            node = Const({"true": True, "false": False, "none": None}[value])
        elif kind == "name":
            node = Name(value)
        elif value == "(":
            node = either()
            take(")")
        else:
            raise TemplateError(f"{value!r} in {source!r}")
        while peek()[1] in (".", "[") and peek()[0] == "op":
            if take() == ".":
                node = Get(node, Const(take()))
            else:
                node = Get(node, either())
                take("]")
        return node

    out = either()
    if pos != len(tokens):
        raise TemplateError(f"{tokens[pos][1]!r} in {source!r}")
    return out


def operate(op: str, x: list) -> Any:
    if op == "==":
        return x[0] == x[1]
    if op == "!=":
        return x[0] != x[1]
    if op == "~":
        return shown(x[0]) + shown(x[1])
    if op in ("+", "-", "%", "<", ">", "<=", ">="):
        a, b = x
        if type(a) is not type(b) or not isinstance(a, int | str) or isinstance(a, str) and op in "-%":
            raise TemplateError(f"{op} between {type(a).__name__} and {type(b).__name__}")
        if op == "%" and not b:
            raise TemplateError("% 0")
        return {"+": lambda: a + b, "-": lambda: a - b, "%": lambda: a % b, "<": lambda: a < b, ">": lambda: a > b, "<=": lambda: a <= b, ">=": lambda: a >= b}[op]()
    raise TemplateError(op)


def fold(node: Any) -> Any:
    """Expressions of constants become constants, decided branches go, and neighbouring texts join."""
    if isinstance(node, list):
        out: list = []
        for x in (fold(n) for n in node):
            if isinstance(x, Output) and isinstance(x.of, Const):
                x = Text(shown(x.of.value))
            for y in x if isinstance(x, list) else [x]:
                if isinstance(y, Text) and out and isinstance(out[-1], Text):
                    out[-1] = Text(out[-1].value + y.value)
                elif not (isinstance(y, Text) and not y.value):
                    out.append(y)
        return out
    if isinstance(node, Op):
        parts = [fold(p) for p in node.parts]
        if node.op == "not":
            return Const(not parts[0].value) if isinstance(parts[0], Const) else Op("not", parts)
        if node.op in ("and", "or") and isinstance(parts[0], Const):
            return parts[1] if bool(parts[0].value) == (node.op == "and") else parts[0]
        if node.op not in ("and", "or") and all(isinstance(p, Const) for p in parts):
            return Const(operate(node.op, [p.value for p in parts]))
        return Op(node.op, parts)
    if isinstance(node, Filter):
        of = fold(node.of)
        return Const(FILTERS[node.name](of.value)) if isinstance(of, Const) else Filter(node.name, of)
    if isinstance(node, Get):
        return Get(fold(node.of), fold(node.key))
    if isinstance(node, Output):
        return Output(fold(node.of))
    if isinstance(node, If):
        cases = []
        for test, body in node.cases:
            test = fold(test)
            if isinstance(test, Const):
                if test.value:
                    if not cases:
                        return fold(body)
                    return If(cases, fold(body))
                continue
            cases.append((test, fold(body)))
        return If(cases, fold(node.other)) if cases else fold(node.other)
    if isinstance(node, For):
        return For(node.name, fold(node.of), fold(node.body))
    if isinstance(node, Set):
        return Set(node.name, fold(node.of))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    return node


@dataclass
class Sink:
    """What a rendering has put out: pieces, their length, and the spans under the loss."""

    pieces: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def put(self, text: str) -> None:
        self.pieces.append(text)
        self.length += len(text)


def value_of(node: Any) -> Callable[[dict], Any]:
    """A closure that computes an expression from the context."""
    if isinstance(node, Const):
        return lambda c, v=node.value: v
    if isinstance(node, Name):
        return lambda c, n=node.name: c.get(n)
    if isinstance(node, Get):
        of, key = value_of(node.of), value_of(node.key)

        def get(c: dict) -> Any:
            x, k = of(c), key(c)
            if isinstance(x, dict):
                return x.get(k)
            if isinstance(x, list | str) and isinstance(k, int):
                return x[k] if -len(x) <= k < len(x) else None
            return None

        return get
    if isinstance(node, Filter):
        return lambda c, f=FILTERS[node.name], of=value_of(node.of): f(of(c))
    parts = [value_of(p) for p in node.parts]
    if node.op == "not":
        return lambda c: not parts[0](c)
    if node.op == "and":
        return lambda c: parts[0](c) and parts[1](c)
    if node.op == "or":
        return lambda c: parts[0](c) or parts[1](c)
    return lambda c, op=node.op: operate(op, [p(c) for p in parts])


def run_of(body: list) -> Callable[[dict, Sink], None]:
    """A closure that renders statements into a sink."""
    steps = [step_of(n) for n in body]

    def run(c: dict, out: Sink) -> None:
        for s in steps:
            s(c, out)

    return run


def step_of(node: Any) -> Callable[[dict, Sink], None]:
    if isinstance(node, Text):
        return lambda c, out, t=node.value: out.put(t)
    if isinstance(node, Output):
        return lambda c, out, f=value_of(node.of): out.put(shown(f(c)))
    if isinstance(node, Set):

        def put(c: dict, out: Sink, f=value_of(node.of)) -> None:
            c[node.name] = f(c)

        return put
    if isinstance(node, If):
        cases, other = [(value_of(t), run_of(b)) for t, b in node.cases], run_of(node.other)

        def choose(c: dict, out: Sink) -> None:
            for test, body in cases:
                if test(c):
                    return body(c, out)
            return other(c, out)

        return choose
    if isinstance(node, For):
        of, body = value_of(node.of), run_of(node.body)

        def loop(c: dict, out: Sink) -> None:
            items = of(c) or []
            inner = dict(c)
            for k, item in enumerate(items):
                inner[node.name] = item
                inner["loop"] = {"index": k + 1, "index0": k, "first": k == 0, "last": k == len(items) - 1, "length": len(items)}
                body(inner, out)

        return loop
    body = run_of(node.body)

    def generate(c: dict, out: Sink) -> None:
        start = out.length
        body(c, out)
        out.spans.append((start, out.length))

    return generate


def compiled(source: str) -> Callable[[list[dict]], tuple[str, list[tuple[int, int]]]]:
    """messages -> (output, spans under the loss)."""
    run = run_of(fold(Parser(source).block(())[0]))

    def render(messages: list[dict], **context: Any) -> tuple[str, list[tuple[int, int]]]:
        out = Sink()
        run({"messages": messages, **context}, out)
        return "".join(out.pieces), out.spans

    return render


#: A turn of TEMPLATE's output. Inside, a backslash and what follows it go together, so a control string ends it only bare.
TURN = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|[^\\])*?) </turn>\n", re.S)


def read_back(output: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of TEMPLATE's output."""
    turns, at = [], 0
    while at < len(output):
        m = TURN.match(output, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id and its messages, ordered by turn (nulls first), then role and text; null role and text are empty."""
    message = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(message)).alias("messages"))


def formatted(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, n_turns, text and loss_spans (array of start, end in code points) of each conversation.

    A conversation is one training example and is rendered by one call; conversations are spread over tasks. Empty and very
    long texts are rendered whole; equal rows are turns each, in any order of theirs; an empty table gives an empty result.
    """
    compiled(template)  # an error shows here, not in a task

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        render = compiled(template)
        for pdf in batches:
            done = [render([{"role": m["role"], "text": m["text"]} for m in ms]) for ms in pdf["messages"]]
            spans = [[{"start": a, "end": b} for a, b in d[1]] for d in done]
            yield pd.DataFrame({"conv_id": pdf["conv_id"], "n_turns": [len(ms) for ms in pdf["messages"]], "text": [d[0] for d in done], "loss_spans": spans})

    return map_with_ids(conversations(rows), run, "conv_id long, n_turns long, text string, loss_spans array<struct<start:long,end:long>>", "conv_id")


def digests(texts: DataFrame) -> DataFrame:
    """What the formatted texts say, read back from them: turns and loss as digests, and their lengths.

    A row each, repeated ones too; no loss spans are a loss of no characters; an empty table gives an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for conv_id, text, spans in zip(pdf["conv_id"], pdf["text"], pdf["loss_spans"], strict=True):
                turns = read_back(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((conv_id, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return map_with_ids(texts, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long", "conv_id")
