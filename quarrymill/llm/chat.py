"""Chat formatting by compiled templates.

A template is parsed into a syntax tree, constants are folded, and the tree becomes nested
Python closures; nothing of it is ever evaluated as Python. The language has text, outputs
``{{ expression }}``, ``{% for name in expression %}``, ``{% if %}``/``{% elif %}``/``{% else %}``
and ``{% generation %}`` blocks. Expressions have names, string and integer literals, lists,
``.field``, ``+``, ``==``, ``!=``, ``and``, ``or``, ``not``, brackets and the filters ``upper``,
``lower``, ``trim``, ``length``, ``escape`` and ``escape_name``. Fields are looked up in dictionaries only, so a
template reaches nothing but the conversation.

Rendering yields text and the places of the generation blocks, which make the loss mask. The
``escape`` filter puts a backslash before each backslash and each control string of the format,
so that texts can't forge turns and are read back exactly; ``escape_name`` does the same for
roles, where the sign between role and text is a control string too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import by_slices, text_or_empty

TURN, COLON, CLOSE = "### ", ": ", "</turn>"
#: Marks turns by role; only what an assistant says is inside the generation block.
TEMPLATE = (
    "{% for turn in turns %}"
    "{{ '### ' + (turn.role | escape_name) + ': ' }}"
    "{% if turn.role == 'assistant' %}{% generation %}{{ turn.text | escape }}{% endgeneration %}"
    "{% else %}{{ turn.text | escape }}{% endif %}"
    "{{ '</turn>' + '\n' }}"
    "{% endfor %}"
)


class TemplateError(ValueError):
    """The template can't be parsed, or asks for something outside the sandbox."""


# --- syntax tree ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: object
    name: str


@dataclass(frozen=True)
class Call:
    """An operator or filter with its operands."""

    name: str
    operands: tuple


@dataclass(frozen=True)
class Output:
    value: object


@dataclass(frozen=True)
class Loop:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class Branch:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


# --- escaping ------------------------------------------------------------------------------

SPECIAL, SPECIAL_NAME = regex.compile(r"\\|###|</turn>"), regex.compile(r"\\|###|</turn>|: ")


def escape(text: str, special: regex.Pattern = SPECIAL) -> str:
    return special.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    """Text or role as it was; in an escaped text no backslash stands before a colon, so one rule does for both."""
    return regex.sub(r"\\(\\|###|</turn>|: )", r"\1", text)


def _text(value: object) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if value is None:
        return ""
    if isinstance(value, (str, int)):
        return str(value)
    raise TemplateError("only strings and integers can be written")


def _plus(a: object, b: object) -> object:
    if type(a) is not type(b) or not isinstance(a, (str, int)):
        raise TemplateError("+ takes two strings or two integers")
    return a + b


OPERATIONS: dict[str, Callable] = {
    "+": _plus,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "not": lambda a: not a,
    "upper": lambda a: _text(a).upper(),
    "lower": lambda a: _text(a).lower(),
    "trim": lambda a: _text(a).strip(),
    "length": len,
    "escape": lambda a: escape(_text(a)),
    "escape_name": lambda a: escape(_text(a), SPECIAL_NAME),
    "list": lambda *items: list(items),
}
FILTERS = ("upper", "lower", "trim", "length", "escape", "escape_name")

# --- parsing -------------------------------------------------------------------------------

BLOCK = regex.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", regex.DOTALL)
TOKEN = regex.compile(r"""\s*(?:([A-Za-z_]\w*)|(\d+)|('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(==|!=|[+.|()\[\],]))""")


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while source[at:].strip():
        m = TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"can't read {source[at:]!r}")
        kind = ("name", "int", "str", "op")[m.lastindex - 1]
        out.append((kind, m[m.lastindex]))
        at = m.end()
    return out


class ExpressionParser:
    """Recursive descent: or, and, not, comparison, +, filters, fields, atoms."""

    def __init__(self, source: str):
        self.tokens, self.at = _tokens(source), 0

    def whole(self) -> object:
        value = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return value

    def take(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} expected")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name is expected")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def either(self) -> object:
        value = self.both()
        while self.take("or"):
            value = Call("or", (value, self.both()))
        return value

    def both(self) -> object:
        value = self.negation()
        while self.take("and"):
            value = Call("and", (value, self.negation()))
        return value

    def negation(self) -> object:
        return Call("not", (self.negation(),)) if self.take("not") else self.comparison()

    def comparison(self) -> object:
        value = self.total()
        while sign := self.take("==", "!="):
            value = Call(sign, (value, self.total()))
        return value

    def total(self) -> object:
        value = self.filtered()
        while self.take("+"):
            value = Call("+", (value, self.filtered()))
        return value

    def filtered(self) -> object:
        value = self.atom()
        while sign := self.take("|", "."):
            word = self.name()
            if sign == "|" and word not in FILTERS:
                raise TemplateError(f"no filter {word!r}")
            if sign == "." and word.startswith("_"):
                raise TemplateError("names of fields don't start with an underscore")
            value = Call(word, (value,)) if sign == "|" else Field(value, word)
        return value

    def atom(self) -> object:
        if self.take("("):
            value = self.either()
            self.need(")")
            return value
        if self.take("["):
            items = []
            while not self.take("]"):
                items.append(self.either())
                if not self.take(","):
                    self.need("]")
                    break
            return Call("list", tuple(items))
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is expected")
        kind, token = self.tokens[self.at]
        if kind == "op" or token in ("and", "or", "not"):
            raise TemplateError(f"unexpected {token!r}")
        self.at += 1
        if kind == "int":
            return Const(int(token))
        if kind == "str":
            return Const(regex.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), token[1:-1], flags=regex.DOTALL))
        return {"true": Const(True), "false": Const(False), "none": Const(None)}.get(token, Name(token))


def parse(source: str) -> tuple:
    """The statements of a template."""
    stack: list[list] = [[]]
    opened: list[tuple[str, object]] = []
    at = 0
    for m in BLOCK.finditer(source):
        if m.start() > at:
            stack[-1].append(Output(Const(source[at : m.start()])))
        at = m.end()
        if m[1] is not None:
            stack[-1].append(Output(ExpressionParser(m[1]).whole()))
            continue
        word, _, rest = m[2].strip().partition(" ")
        if word in ("for", "if", "generation"):
            opened.append((word, rest))
            stack.append([])
        elif word in ("elif", "else"):
            if not opened or opened[-1][0] not in ("if", "elif"):
                raise TemplateError(f"{word} without if")
            opened.append((word, rest))
            stack.append([])
        elif word in ("endfor", "endif", "endgeneration"):
            _close(word, opened, stack)
        else:
            raise TemplateError(f"no statement {word!r}")
    if at < len(source):
        stack[-1].append(Output(Const(source[at:])))
    if opened:
        raise TemplateError(f"{opened[-1][0]} isn't closed")
    return tuple(stack[0])


def _close(word: str, opened: list, stack: list) -> None:
    if word == "endif":
        other: tuple = ()
        while opened and opened[-1][0] in ("elif", "else"):
            kind, test = opened.pop()
            body = tuple(stack.pop())
            other = body if kind == "else" else (Branch(ExpressionParser(test).whole(), body, other),)
        if not opened or opened[-1][0] != "if":
            raise TemplateError("endif without if")
        test = opened.pop()[1]
        stack[-2:] = [[*stack[-2], Branch(ExpressionParser(test).whole(), tuple(stack[-1]), other)]]
        return
    if not opened or opened[-1][0] != word[3:]:
        raise TemplateError(f"{word} without {word[3:]}")
    kind, rest = opened.pop()
    body = tuple(stack.pop())
    if kind == "generation":
        stack[-1].append(Generation(body))
        return
    m = regex.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.*)", rest, regex.DOTALL)
    if not m:
        raise TemplateError("for needs: name in expression")
    stack[-1].append(Loop(m[1], ExpressionParser(m[2]).whole(), body))


# --- constant folding ----------------------------------------------------------------------


def fold(node: object) -> object:
    """An expression with every part that needs no name computed."""
    if isinstance(node, Field):
        return Field(fold(node.of), node.name)
    if not isinstance(node, Call):
        return node
    operands = tuple(fold(x) for x in node.operands)
    if node.name in ("and", "or"):
        left, right = operands
        if isinstance(left, Const):
            return right if bool(left.value) == (node.name == "and") else left
        return Call(node.name, operands)
    if all(isinstance(x, Const) for x in operands):
        return Const(OPERATIONS[node.name](*[x.value for x in operands]))
    if node.name == "+" and isinstance(operands[1], Const) and isinstance(operands[1].value, str):
        left = operands[0]  # (x + 'a') + 'b' -> x + 'ab'
        if isinstance(left, Call) and left.name == "+" and isinstance(left.operands[1], Const) and isinstance(left.operands[1].value, str):
            return Call("+", (left.operands[0], Const(left.operands[1].value + operands[1].value)))
    return Call(node.name, operands)


def fold_block(body: tuple) -> tuple:
    """Statements with folded expressions, decided branches taken and neighbouring text joined."""
    out: list = []
    for node in body:
        if isinstance(node, Output):
            new = [Output(fold(node.value))]
        elif isinstance(node, Loop):
            new = [Loop(node.name, fold(node.over), fold_block(node.body))]
        elif isinstance(node, Generation):
            new = [Generation(fold_block(node.body))]
        else:
            test = fold(node.test)
            then, other = fold_block(node.then), fold_block(node.other)
            new = list(then if test.value else other) if isinstance(test, Const) else [Branch(test, then, other)]
        for one in new:
            text = isinstance(one, Output) and isinstance(one.value, Const)
            if text and out and isinstance(out[-1], Output) and isinstance(out[-1].value, Const):
                out[-1] = Output(Const(_text(out[-1].value.value) + _text(one.value.value)))
            else:
                out.append(one)
    return tuple(out)


# --- closures ------------------------------------------------------------------------------


class Sink:
    """Parts of the output, and where generation blocks start and end in code points."""

    def __init__(self):
        self.parts: list[str] = []
        self.length = 0
        self.masked: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def _expression(node: object) -> Callable[[dict], object]:
    if isinstance(node, Const):
        value = node.value
        return lambda scope: value
    if isinstance(node, Name):
        name = node.name
        return lambda scope: scope.get(name)
    if isinstance(node, Field):
        of, name = _expression(node.of), node.name

        def field(scope: dict) -> object:
            value = of(scope)
            if not isinstance(value, dict):
                raise TemplateError(f".{name} of something that has no fields")
            return value.get(name)

        return field
    operands = [_expression(x) for x in node.operands]
    if node.name in ("and", "or"):
        left, right = operands
        if node.name == "and":
            return lambda scope: left(scope) and right(scope)
        return lambda scope: left(scope) or right(scope)
    run = OPERATIONS[node.name]
    if len(operands) == 1:
        only = operands[0]
        return lambda scope: run(only(scope))
    return lambda scope: run(*[x(scope) for x in operands])


def _block(body: tuple) -> Callable[[dict, Sink], None]:
    steps = [_statement(node) for node in body]

    def run(scope: dict, sink: Sink) -> None:
        for step in steps:
            step(scope, sink)

    return run


def _statement(node: object) -> Callable[[dict, Sink], None]:
    if isinstance(node, Output):
        if isinstance(node.value, Const):
            text = _text(node.value.value)
            return lambda scope, sink: sink.write(text)
        value = _expression(node.value)
        return lambda scope, sink: sink.write(_text(value(scope)))
    if isinstance(node, Branch):
        test, then, other = _expression(node.test), _block(node.then), _block(node.other)
        return lambda scope, sink: (then if test(scope) else other)(scope, sink)
    if isinstance(node, Generation):
        inner = _block(node.body)

        def generation(scope: dict, sink: Sink) -> None:
            start = sink.length
            inner(scope, sink)
            sink.masked.append((start, sink.length))

        return generation
    name, over, body = node.name, _expression(node.over), _block(node.body)

    def loop(scope: dict, sink: Sink) -> None:
        items = over(scope)
        if not isinstance(items, list):
            raise TemplateError("for needs a list")
        for item in items:
            body({**scope, name: item}, sink)

    return loop


@lru_cache(maxsize=32)
def compile_template(source: str) -> Callable[[list[dict]], tuple[str, list[tuple[int, int]]]]:
    """A function from turns (dictionaries of role and text) to the text and its masked spans."""
    run = _block(fold_block(parse(source)))

    def render(turns: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        sink = Sink()
        run({"turns": turns}, sink)
        return "".join(sink.parts), sink.masked

    return render


# --- reading back --------------------------------------------------------------------------

PIECE = regex.compile(r"(?:[^\\#<]++|\\(?:\\|###|</turn>)|#(?!##)|<(?!/turn>))*+")
NAME = regex.compile(r"(?:[^\\#<:]++|\\(?:\\|###|</turn>|: )|#(?!##)|<(?!/turn>)|:(?! ))*+")


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a conversation that TEMPLATE formatted."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(TURN, at):
            raise ValueError(f"a turn is expected at {at}")
        name = NAME.match(formatted, at + len(TURN)).end()
        start = name + len(COLON)
        end = PIECE.match(formatted, start).end()
        if not formatted.startswith(COLON, name) or not formatted.startswith(CLOSE + "\n", end):
            raise ValueError(f"the turn at {at} isn't closed")
        turns.append((unescape(formatted[at + len(TURN) : name]), unescape(formatted[start:end])))
        at = end + len(CLOSE) + 1
    return turns


# --- Spark ---------------------------------------------------------------------------------


def format_conversations(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, formatted, masked (array of start and end of each generation block, in code points).

    Rows are (conv_id, turn, role, text), ordered by turn and, in ties, by role and text; null
    turns come first. Null text or role is empty; a role is any string. A row without conv_id
    belongs to no other row and is a conversation of its own; repeated rows are repeated turns.
    Texts have no length limit; a conversation is formatted in one place, since it is one
    training sample. An empty table gives an empty result. Other columns are left out, so
    clashing names do no harm.
    """
    compile_template(template)  # so that a bad template fails before any job runs
    turns = rows.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), text_or_empty().alias("text")).alias("t"))
    whole = turns.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    whole = whole.unionByName(turns.where(F.col("conv_id").isNull()).select("conv_id", F.array("t").alias("turns")))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [compile_template(template)(turns) for turns in batch.column(1).to_pylist()]
        texts = pa.array([text for text, _ in found], pa.string())
        spans = pa.array([[{"start": a, "end": b} for a, b in masked] for _, masked in found], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
        return pa.RecordBatch.from_arrays([batch.column(0), texts, spans], ["conv_id", "formatted", "masked"])

    return whole.mapInArrow(by_slices(work), f"conv_id {_kind(rows)}, formatted string, masked array<struct<start: int, end: int>>")


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted text says, read back from it alone and its mask."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, masked in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            turns = read_back(text)
            told = "".join(f"{role}\n{said}\n" for role, said in turns)
            loss = "".join(unescape(text[m["start"] : m["end"]]) for m in masked)
            out.append((len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        columns = zip(*out, strict=True) if out else [()] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        arrays = [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]]
        return pa.RecordBatch.from_arrays(arrays, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    schema = f"conv_id {_kind(formatted)}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.mapInArrow(by_slices(work), schema)


def _kind(rows: DataFrame) -> str:
    return rows.schema["conv_id"].dataType.simpleString()
