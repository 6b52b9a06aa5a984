"""Operator 10: chat formatting by a compiler for a small sandboxed template language.

A template is parsed into a syntax tree, constants in it are folded, and each node becomes a Python closure; rendering a
conversation calls the closures and notes where generated text lies. Templates know no attributes but those of their
data, no calls but the named filters, and no loops but over given lists, so they always end and touch nothing else.

    {% for m in messages %}...{% endfor %}    loop; loop.first, loop.last, loop.index0
    {% if e %}...{% elif e %}...{% else %}...{% endif %}
    {% generation %}...{% endgeneration %}    what a model is to learn
    {{ e }}    text, numbers, names, a.b, a + b, a == b, a != b, not a, a and b, a or b, a | filter, (a)

A minus inside a tag ({%- -%}, {{- -}}) strips the white space of the text on that side.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strings that steer a chat model. Inside texts they are broken up by MARK.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|turn|>", "<|text|>", "<|end|>")
#: Escapes: MARK 1 stands after the first character of a control string, MARK 0 for a MARK in the text.
MARK = "␛"
_CONTROL = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS))
_ESCAPED = re.compile(f"{MARK}([01])")


def escape(text: str) -> str:
    """The text without any control string in it; `unescape` gives it back."""
    return _CONTROL.sub(lambda m: f"{m[0]}{MARK}1", text.replace(MARK, f"{MARK}0"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: MARK if m[1] == "0" else "", text)


FILTERS: dict[str, Callable[[Any], Any]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len}


class TemplateError(ValueError):
    """The template isn't well-formed, names what it may not use or what isn't there, or computes what can't be."""


class Node(NamedTuple):
    """kind, and its parts: texts, names, and nodes or lists of nodes."""

    kind: str
    parts: tuple


#: A tag's inside: whole strings, which may hold the signs of a tag's end, and what else isn't a quote.
_INSIDE = r"""((?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^'"])*?)"""
_TAG = re.compile(rf"\{{%(-?)\s*{_INSIDE}\s*(-?)%\}}|\{{\{{(-?)\s*{_INSIDE}\s*(-?)\}}\}}", re.S)
_TOKEN = re.compile(r"""\s*(?:(\d+)|'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)"|([A-Za-z_]\w*)|(==|!=|[+|.()]))""", re.S)


def _expression(source: str) -> Node:
    tokens, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"can't read {source[at:]!r}")
        number, one, two, name, sign = m.groups()
        if number:
            tokens.append(("value", int(number)))
        elif name:
            tokens.append(("name", name))
        elif sign:
            tokens.append(("sign", sign))
        else:
            tokens.append(("value", re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t"}.get(e[1], e[1]), one if one is not None else two, flags=re.S)))
        at = m.end()

    def take(*wanted: str) -> str | None:
        if tokens and tokens[0][0] != "value" and tokens[0][1] in wanted:
            return tokens.pop(0)[1]
        return None

    def atom() -> Node:
        if take("("):
            inner = either()
            if not take(")"):
                raise TemplateError(f"no ) in {source!r}")
            return inner
        if not tokens or tokens[0][0] == "sign":
            raise TemplateError(f"no value in {source!r}")
        kind, value = tokens.pop(0)
        return Node("value", (value,)) if kind == "value" else Node("name", (value,))

    def fine() -> Node:
        node = atom()
        while sign := take(".", "|"):
            if not tokens or tokens[0][0] != "name":
                raise TemplateError(f"no name after {sign} in {source!r}")
            name = tokens.pop(0)[1]
            if sign == "|" and name not in FILTERS or name.startswith("_"):
                raise TemplateError(f"{name!r} may not be used")
            node = Node("filter" if sign == "|" else "field", (node, name))
        return node

    def added() -> Node:
        node = fine()
        while take("+"):
            node = Node("add", (node, fine()))
        return node

    def compared() -> Node:
        if take("not"):
            return Node("not", (compared(),))
        node = added()
        while sign := take("==", "!="):
            node = Node("equal" if sign == "==" else "differ", (node, added()))
        return node

    def both() -> Node:
        node = compared()
        while take("and"):
            node = Node("and", (node, compared()))
        return node

    def either() -> Node:
        node = both()
        while take("or"):
            node = Node("or", (node, both()))
        return node

    node = either()
    if tokens:
        raise TemplateError(f"{tokens[0][1]!r} is left over in {source!r}")
    return node


def parse(template: str) -> list[Node]:
    """The syntax tree of a template: a list of text, out, for, if and generation nodes."""
    pieces, at, stripped = [], 0, False
    for m in _TAG.finditer(template):
        left, tag, right, out_left, out, out_right = m.groups()
        text = template[at : m.start()]
        text = text.lstrip() if stripped else text
        pieces += [("text", text.rstrip() if left or out_left else text), ("tag", tag) if tag is not None else ("out", out)]
        at, stripped = m.end(), bool(right or out_right)
    pieces.append(("text", template[at:].lstrip() if stripped else template[at:]))
    if unread := next((text for kind, text in pieces if kind == "text" and ("{{" in text or "{%" in text)), None):
        raise TemplateError(f"no whole tag in {unread!r}")

    def block(*ends: str) -> tuple[list[Node], str]:
        nodes = []
        while pieces:
            kind, body = pieces.pop(0)
            if kind == "text":
                nodes += [Node("text", (body,))] if body else []
            elif kind == "out":
                nodes.append(Node("out", (_expression(body),)))
            elif body.split(" ")[0] in ends:
                return nodes, body
            elif m := re.fullmatch(r"for\s+([A-Za-z]\w*)\s+in\s+(.*)", body, re.S):
                nodes.append(Node("for", (m[1], _expression(m[2]), block("endfor")[0])))
            elif body.startswith("if "):
                branches = []
                while body.split(" ")[0] in ("if", "elif"):
                    test = _expression(body.split(" ", 1)[1])
                    inner, body = block("elif", "else", "endif")
                    branches.append((test, inner))
                branches.append((Node("value", (True,)), block("endif")[0] if body == "else" else []))
                nodes.append(Node("if", tuple(branches)))
            elif body == "generation":
                nodes.append(Node("generation", (block("endgeneration")[0],)))
            else:
                raise TemplateError(f"unknown or misplaced tag {body!r}")
        if ends:
            raise TemplateError(f"no {ends[-1]}")
        return nodes, ""

    return block()[0]


def fold(nodes: list[Node]) -> list[Node]:
    """The same tree with constant expressions computed, decided branches resolved and neighbouring texts joined."""

    def folded(e: Node) -> Node:
        if e.kind in ("value", "name"):
            return e
        e = Node(e.kind, tuple(folded(p) if isinstance(p, Node) else p for p in e.parts))
        if all(p.kind == "value" for p in e.parts if isinstance(p, Node)) and e.kind != "field":
            try:
                return Node("value", (_compiled(e)({}),))
            except (TypeError, AttributeError) as error:
                raise TemplateError(f"can't compute {e.kind} of {[p.parts[0] for p in e.parts if isinstance(p, Node)]}: {error}") from error
        return e

    out: list[Node] = []
    for node in nodes:
        if node.kind == "out":
            e = folded(node.parts[0])
            new = [Node("text", (str(e.parts[0]),))] if e.kind == "value" else [Node("out", (e,))]
        elif node.kind == "for":
            new = [Node("for", (node.parts[0], folded(node.parts[1]), fold(node.parts[2])))]
        elif node.kind == "generation":
            new = [Node("generation", (fold(node.parts[0]),))]
        elif node.kind == "if":
            branches = []
            for test, inner in node.parts:
                test = folded(test)
                if test.kind == "value" and not test.parts[0]:
                    continue
                branches.append((test, fold(inner)))
                if test.kind == "value":
                    break
            decided = branches and branches[0][0].kind == "value"
            new = branches[0][1] if decided else [Node("if", tuple(branches))] if branches else []
        else:
            new = [node]
        for n in new:
            if n.kind == "text" and out and out[-1].kind == "text":
                out[-1] = Node("text", (out[-1].parts[0] + n.parts[0],))
            elif n.kind != "text" or n.parts[0]:
                out.append(n)
    return out


def _looked_up(values: Any, name: str) -> Any:
    if not isinstance(values, dict) or name not in values:
        raise TemplateError(f"there is no {name!r}")
    return values[name]


def _compiled(e: Node) -> Callable[[dict], Any]:
    """The closure of an expression."""
    if e.kind == "value":
        return lambda scope, v=e.parts[0]: v
    if e.kind == "name":
        return lambda scope, n=e.parts[0]: _looked_up(scope, n)
    f = _compiled(e.parts[0])
    if e.kind == "filter":
        return lambda scope, g=FILTERS[e.parts[1]]: g(f(scope))
    if e.kind == "field":
        return lambda scope, n=e.parts[1]: _looked_up(f(scope), n)
    if e.kind == "not":
        return lambda scope: not f(scope)
    g = _compiled(e.parts[1])
    return {
        "add": lambda scope: f(scope) + g(scope),
        "equal": lambda scope: f(scope) == g(scope),
        "differ": lambda scope: f(scope) != g(scope),
        "and": lambda scope: f(scope) and g(scope),
        "or": lambda scope: f(scope) or g(scope),
    }[e.kind]


class _Output:
    """What a rendering has written: pieces, their length in code points, and the spans of generated text."""

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.pieces.append(text)
        self.length += len(text)


def _generated(nodes: list[Node]) -> Callable[[dict, _Output], None]:
    """The closure of a list of nodes."""
    steps: list[Callable[[dict, _Output], None]] = []
    for node in nodes:
        if node.kind == "text":
            steps.append(lambda scope, out, t=node.parts[0]: out.write(t))
        elif node.kind == "out":
            steps.append(lambda scope, out, f=_compiled(node.parts[0]): out.write(str(f(scope))))
        elif node.kind == "for":

            def loop(scope: dict, out: _Output, name=node.parts[0], items=_compiled(node.parts[1]), body=_generated(node.parts[2])) -> None:
                all_items = items(scope)
                for k, item in enumerate(all_items):
                    body(scope | {name: item, "loop": {"index0": k, "first": k == 0, "last": k == len(all_items) - 1}}, out)

            steps.append(loop)
        elif node.kind == "if":

            def branch(scope: dict, out: _Output, ways=[(_compiled(t), _generated(inner)) for t, inner in node.parts]) -> None:
                for test, body in ways:
                    if test(scope):
                        body(scope, out)
                        return

            steps.append(branch)
        else:

            def marked(scope: dict, out: _Output, body=_generated(node.parts[0])) -> None:
                start = out.length
                body(scope, out)
                out.spans.append((start, out.length))

            steps.append(marked)

    def run(scope: dict, out: _Output) -> None:
        for step in steps:
            step(scope, out)

    return run


def compile_template(template: str) -> Callable[[list[dict[str, str]]], tuple[str, list[tuple[int, int]]]]:
    """A function from messages (role, text) to the formatted text and the spans, in code points, of generated text."""
    body = _generated(fold(parse(template)))

    def render(messages: list[dict[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        out = _Output()
        try:
            body({"messages": messages}, out)
        except (TypeError, AttributeError) as error:
            raise TemplateError(f"can't compute what the template asks for: {error}") from error
        return "".join(out.pieces), out.spans

    return render


#: The template of op10: each turn is marked, and its role and text are escaped; the assistant's texts are generated.
TEMPLATE = (
    "{% for m in messages %}<|turn|>{{ m.role | escape }}<|text|>"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}<|end|>{% endfor %}"
)
_TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of what TEMPLATE has formatted."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def format_chats(turns: DataFrame, template: str = TEMPLATE, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, spans (array of start, end in code points under the loss mask), error.

    What a template asks for and a conversation hasn't (TemplateError) is told in `error`, with null formatted and spans; the
    other conversations are formatted all the same. A template that isn't well-formed stops the call itself.

    Rows are ordered by turn, then role and text; repeated rows stay repeated turns, and null turns come first. Null roles
    and texts are empty; rows with a null conversation form one. Other columns play no part. A conversation is one
    output text, so its own turns meet in one task; conversations spread over all of them.
    """
    empty = F.lit("")
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.struct(
            F.col(turn_col).cast("long").alias("turn"),
            F.coalesce(F.col(role_col).cast("string"), empty).alias("role"),
            F.coalesce(F.col(text_col).cast("string"), empty).alias("text"),
        ).alias("row"),
    )
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    compile_template(template)

    def tried(render: Callable, messages: list[dict[str, str]]) -> tuple:
        try:
            return (*render(messages), None)
        except TemplateError as error:
            return None, None, str(error)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        for batch in batches:
            out = [tried(render, rows.as_py()) for rows in batch.column(1)]
            spans = pa.array([None if s is None else [{"start": a, "end": b} for a, b in s] for _, s, _ in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _, _ in out], pa.string()), spans, pa.array([e for *_, e in out], pa.string())], ["conv_id", "formatted", "spans", "error"])

    return grouped.mapInArrow(run, "conv_id long, formatted string, spans array<struct<start:long,end:long>>, error string")


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted conversations (of one that couldn't be formatted: no turns): conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                text, spans = text or "", spans or []
                turns = read_back(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                said = "".join(f"{role}\n{t}\n" for role, t in turns)
                cells.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = [pa.array([c[k] for c in cells], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
