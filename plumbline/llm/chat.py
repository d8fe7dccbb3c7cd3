"""Conversations as text by a compiled template, with the places to learn from, and back.

A template is text with ``{{ expression }}``, ``{% if %}`` (``elif``, ``else``), ``{% for x in list %}``, ``{% set x = e %}``,
``{% generation %}`` around what a model is to learn, and ``{# remarks #}``; a dash inside a delimiter drops the white space
beside it.  Expressions know literals, names, ``x.key`` and ``x[e]`` (keys of maps and places of lists, never attributes of
objects), ``+ ~ - == != < <= > >= in and or not``, ``a if c else b`` and the filters of ``FILTERS``.  There are no calls, and loops
run over given lists only, so every rendering ends.  A template is parsed into a tree, constant parts are folded, and each node
becomes a closure that writes to a sink; the sink notes between which code points generation was on.

On Spark a template is a prologue and one loop over ``messages``.  Turns are numbered in their conversation by sorted ranges, so a
conversation of a third of all rows is spread over tasks; it is rendered in parts of ``PART_TURNS`` turns or about ``PART_BYTES``
bytes, which follow each other without a gap.  An ordinary conversation is one part.  The digest of a conversation is a chain: what fits a part
is digested there, only longer ones are gathered by one task each, part by part, never whole.

Rows by turn, nulls first; rows of one turn by role, then text.  Null roles and texts are empty, a null conv_id is one
conversation.  Equal rows are turns of their own.  A turn's text is held whole, and nothing longer.  Other columns are not
read.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, placed, require_columns, tree_of, written

PART_TURNS = 256
PART_BYTES = 1 << 20

#: ``[`` and ``<`` begin all control strings of this template; ``escape`` breaks them, and nothing else, up.
TEMPLATE = """<s>
{%- for message in messages -%}
  {%- if message.role == 'user' -%}      [INST] {{ message.text | escape }}[/INST]
  {%- elif message.role == 'assistant' -%} [ANS] {% generation %}{{ message.text | escape }}{% endgeneration %}</s>
  {%- elif message.role == 'system' -%}  <<SYS>> {{ message.text | escape }}<</SYS>>
  {%- else -%}                           [ROLE] {{ message.role | escape }}[/ROLE] {{ message.text | escape }}[/TURN]
  {%- endif -%}
{%- endfor -%}
"""

_GUARDED = re.compile(r"([\\\[<])")
_ESCAPED = re.compile(r"([\\\[<])\\")
#: What ``escape`` can give: guarded characters are followed by a backslash.
_BODY = r"((?:[^\\\[<]++|[\\\[<]\\)*+)"


def escaped(text: str) -> str:
    """A backslash after every ``\\``, ``[`` and ``<``: no control string is left, and ``unescaped`` gives the text again."""
    return _GUARDED.sub(r"\1\\", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _spelled(value) -> str:
    return "" if value is None else ("true" if value else "false") if isinstance(value, bool) else str(value)


FILTERS: dict[str, Callable] = {
    "escape": lambda v: escaped(_spelled(v)),
    "trim": lambda v: _spelled(v).strip(),
    "upper": lambda v: _spelled(v).upper(),
    "lower": lambda v: _spelled(v).lower(),
    "string": _spelled,
    "length": lambda v: len(v or ""),
}


class TemplateError(ValueError):
    pass


# --- expressions: trees of tuples, ("const", value), ("name", n), ("item", e, key), ("filter", name, e), ("op", sign, a, b), ("not", e), ("cond", c, a, b)

_TOKEN = re.compile(r"""\s*(?:('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(\d+)|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+~<>|.\[\]()]))""", re.DOTALL)
_CONSTANTS = {"true": True, "false": False, "none": None}
_WORDS = {"and", "or", "not", "in", "if", "else", *_CONSTANTS}
_LEVELS = (("or",), ("and",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("+", "-", "~"))


def _joined(a, b) -> str:
    return _spelled(a) + _spelled(b)


def _item(held, key):
    if isinstance(held, dict):
        return held.get(key)
    if isinstance(held, list | str) and isinstance(key, int) and not isinstance(key, bool) and -len(held) <= key < len(held):
        return held[key]
    return None


def _plus(a, b):
    return a + b if isinstance(a, int) and isinstance(b, int) else _joined(a, b)


_OPS: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in (b or ()), "+": _plus, "-": lambda a, b: a - b, "~": _joined,
}


class _Expression:
    """Reads one expression from its tokens."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"not understood: {source[at:]!r}")
            self.tokens.append((("text", "number", "word", "sign")[m.lastindex - 1], m[m.lastindex]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        """The next sign or word."""
        if self.at < len(self.tokens) and self.tokens[self.at][0] in ("sign", "word"):
            return self.tokens[self.at][1]
        return None

    def take(self, expected: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens) or expected and self.peek() != expected:
            raise TemplateError(f"expected {expected or 'a value'} in an expression")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self):
        tree = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"not understood: {self.tokens[self.at][1]!r}")
        return tree

    def choice(self):
        tree = self.level(0)
        if self.peek() != "if":
            return tree
        self.take()
        condition = self.level(0)
        self.take("else")
        return fold(("cond", condition, tree, self.choice()))

    def level(self, n: int):
        if n == len(_LEVELS):
            return self.value()
        if n == 2 and self.peek() == "not":
            self.take()
            return fold(("not", self.level(2)))
        tree = self.level(n + 1)
        while self.peek() in _LEVELS[n]:
            sign = self.take()[1]
            tree = fold(("op", sign, tree, self.level(n + 1)))
        return tree

    def value(self):
        kind, token = self.take()
        if kind == "text":
            tree = ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), token[1:-1], flags=re.DOTALL))
        elif kind == "number":
            tree = ("const", int(token))
        elif token == "(":
            tree = self.choice()
            self.take(")")
        elif kind == "word" and token in _CONSTANTS:
            tree = ("const", _CONSTANTS[token])
        elif kind == "word" and token not in _WORDS:
            tree = ("name", token)
        else:
            raise TemplateError(f"a value cannot begin with {token!r}")
        while self.peek() in (".", "[", "|"):
            sign = self.take()[1]
            if sign == "[":
                tree = fold(("item", tree, self.choice()))
                self.take("]")
                continue
            kind, word = self.take()
            if kind != "word":
                raise TemplateError(f"expected a name after {sign!r}")
            if sign == "|" and word not in FILTERS:
                raise TemplateError(f"no filter {word!r}")
            tree = fold(("item", tree, ("const", word)) if sign == "." else ("filter", word, tree))
        return tree


def fold(tree):
    """A constant in place of a tree whose parts are all constants, or whose outcome a constant decides."""
    parts = [p for p in tree[1:] if isinstance(p, tuple)]
    if tree[0] == "cond" and tree[1][0] == "const":
        return tree[2] if tree[1][1] else tree[3]
    if tree[0] == "op" and tree[1] in ("and", "or") and tree[2][0] == "const":
        return tree[3] if bool(tree[2][1]) == (tree[1] == "and") else tree[2]
    if parts and all(p[0] == "const" for p in parts):
        try:
            return ("const", evaluate(tree)({}))
        except TypeError as wrong:
            raise TemplateError(str(wrong)) from wrong
    return tree


def evaluate(tree) -> Callable[[dict], object]:
    """A closure from the names in sight to the value of an expression."""
    kind, *parts = tree
    if kind == "const":
        return lambda env, value=parts[0]: value
    if kind == "name":
        return lambda env, name=parts[0]: env.get(name)
    if kind == "filter":
        apply, inner = FILTERS[parts[0]], evaluate(parts[1])
        return lambda env: apply(inner(env))
    if kind == "op" and parts[0] in ("and", "or"):
        a, b = evaluate(parts[1]), evaluate(parts[2])
        return (lambda env: a(env) and b(env)) if parts[0] == "and" else (lambda env: a(env) or b(env))
    if kind == "op":
        apply, a, b = _OPS[parts[0]], evaluate(parts[1]), evaluate(parts[2])
        return lambda env: apply(a(env), b(env))
    if kind == "not":
        inner = evaluate(parts[0])
        return lambda env: not inner(env)
    if kind == "item":
        held, key = evaluate(parts[0]), evaluate(parts[1])
        return lambda env: _item(held(env), key(env))
    condition, a, b = (evaluate(p) for p in parts)
    return lambda env: a(env) if condition(env) else b(env)


# --- statements: ("text", s), ("put", e), ("set", name, e), ("if", [(e, block), ...]), ("for", name, e, block), ("generation", block)


@dataclass
class Sink:
    """What a rendering has written, and the code points [start, end) between which generation was on."""

    parts: list[str] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)
    length: int = 0
    depth: int = 0

    def put(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)

    def taken(self) -> tuple[str, list[tuple[int, int]]]:
        return "".join(self.parts), self.spans


_SPLIT = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.DOTALL)


def _pieces(source: str) -> list[tuple[str, str]]:
    """(kind, content): text, put, do."""
    found, pieces = _SPLIT.split(source), []
    for i, piece in enumerate(found):
        if i % 2 == 0:
            text = piece
            if i > 0 and found[i - 1][-3] == "-":
                text = text.lstrip()
            if i + 1 < len(found) and found[i + 1][2] == "-":
                text = text.rstrip()
            if text:
                pieces.append(("text", text))
        elif piece[1] != "#":
            pieces.append(("put" if piece[1] == "{" else "do", piece[2:-2].strip("-").strip()))
    return pieces


class _Block:
    """Reads the statements of a template."""

    def __init__(self, source: str):
        self.pieces, self.at = _pieces(source), 0

    def until(self, *ends: str) -> tuple[list, str]:
        """The statements up to one of the words that end them, and the statement with that word."""
        block: list = []
        while self.at < len(self.pieces):
            kind, content = self.pieces[self.at]
            self.at += 1
            word, _, rest = content.partition(" ")
            if kind == "do" and word in ends:
                return block, content
            if kind == "text":
                block.append(("text", content))
            elif kind == "put":
                tree = _Expression(content).whole()
                block.append(("text", _spelled(tree[1])) if tree[0] == "const" else ("put", tree))
            elif word == "set" and (m := re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=(?!=)(.*)", rest, re.DOTALL)):
                block.append(("set", m[1], _Expression(m[2]).whole()))
            elif word == "for" and (m := re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.*)", rest, re.DOTALL)):
                block.append(("for", m[1], _Expression(m[2]).whole(), self.until("endfor")[0]))
            elif word == "generation":
                block.append(("generation", self.until("endgeneration")[0]))
            elif word == "if":
                branches, condition = [], _Expression(rest).whole()
                while True:
                    inner, end = self.until("elif", "else", "endif")
                    if condition[0] != "const" or condition[1]:
                        branches.append((condition, inner))
                    word, _, rest = end.partition(" ")
                    if word == "endif":
                        break
                    condition = _Expression(rest).whole() if word == "elif" else ("const", True)
                # nothing comes after a branch that is always taken
                first = next((i for i, b in enumerate(branches) if b[0][0] == "const"), len(branches))
                branches = branches[: first + 1]
                if branches and branches[0][0][0] == "const":
                    block.extend(branches[0][1])
                elif branches:
                    block.append(("if", branches))
            else:
                raise TemplateError(f"not understood: {content!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return block, ""


def _merged(block: list) -> list:
    """Neighbouring texts as one."""
    out: list = []
    for node in block:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        else:
            out.append(node)
    return out


def _closure(block: list) -> Callable[[dict, Sink], None]:
    steps = tuple(_statement(node) for node in _merged(block))
    if len(steps) == 1:
        return steps[0]

    def run(env: dict, sink: Sink) -> None:
        for step in steps:
            step(env, sink)

    return run


def _statement(node) -> Callable[[dict, Sink], None]:
    kind = node[0]
    if kind == "text":
        return lambda env, sink, text=node[1]: sink.put(text)
    if kind == "put":
        value = evaluate(node[1])
        return lambda env, sink: sink.put(_spelled(value(env)))
    if kind == "set":
        value = evaluate(node[2])
        return lambda env, sink, name=node[1]: env.__setitem__(name, value(env))
    if kind == "if":
        branches = tuple((evaluate(c), _closure(b)) for c, b in node[1])

        def choose(env: dict, sink: Sink) -> None:
            for condition, body in branches:
                if condition(env):
                    return body(env, sink)

        return choose
    if kind == "generation":
        inner = _closure(node[1])

        def marked(env: dict, sink: Sink) -> None:
            start, sink.depth = sink.length, sink.depth + 1
            inner(env, sink)
            sink.depth -= 1
            if sink.depth == 0 and sink.length > start:
                sink.spans.append((start, sink.length))

        return marked
    name, items, body = node[1], evaluate(node[2]), _closure(node[3])

    def loop(env: dict, sink: Sink) -> None:
        held = items(env) or ()
        for i, x in enumerate(held):
            body(_inside(env, name, x, i, len(held)), sink)

    return loop


def _inside(env: dict, name: str, value: object, index: int, size: int) -> dict:
    return env | {name: value, "loop": {"index0": index, "index": index + 1, "first": index == 0, "last": index == size - 1, "length": size}}


class Template:
    """A parsed, folded and compiled template."""

    def __init__(self, source: str):
        self.source = source
        self.tree = _merged(_Block(source).until()[0])
        self.whole = _closure(self.tree)
        loops = [i for i, node in enumerate(self.tree) if node[0] == "for"]
        #: Whether it can be rendered turn by turn.
        self.streams = len(loops) == 1 and loops[0] == len(self.tree) - 1 and self.tree[-1][2] == ("name", "messages")
        if self.streams:
            self.opening, self.name, self.body = _closure(self.tree[:-1]), self.tree[-1][1], _closure(self.tree[-1][3])

    def render(self, messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        """A conversation's text, and the spans to learn from."""
        sink = Sink()
        self.whole({"messages": messages}, sink)
        return sink.taken()

    def turn(self, sink: Sink, message: dict, index: int, size: int) -> None:
        """Write the turn of that place to the sink, and what comes before the first turn."""
        env: dict = {}
        self.opening(env, sink if index == 0 else Sink())
        self.body(_inside(env, self.name, message, index, size), sink)


class Reader:
    """Reads the turns of a template's output.

    What stands around a text is found by rendering turns of marks that no template holds; texts are known by
    their escapes, so nothing inside one can pass for a control string.
    """

    ROLES = ("user", "assistant", "system")

    def __init__(self, template: Template):
        mark, role = "", ""
        sink = Sink()
        template.opening({}, sink)
        self.opening = sink.taken()[0]
        forms = []
        for r in self.ROLES:
            before, _, after = self._turn(template, r, mark).partition(mark)
            forms.append(re.escape(before) + _BODY + re.escape(after))
        before, _, rest = self._turn(template, role, mark).partition(role)
        between, _, after = rest.partition(mark)
        forms.append(re.escape(before) + _BODY + re.escape(between) + _BODY + re.escape(after))
        self.pattern = re.compile("|".join(forms))

    @staticmethod
    def _turn(template: Template, role: str, text: str) -> str:
        sink = Sink()
        template.turn(sink, {"role": role, "text": text}, 1, 3)
        return sink.taken()[0]

    def turns(self, text: str, first: bool) -> Iterator[tuple[str, str]]:
        """(role, text) of a part; ``first``: it is the first of its conversation."""
        at = 0
        if first:
            if not text.startswith(self.opening):
                raise ValueError("a conversation does not begin as its template says")
            at = len(self.opening)
        while at < len(text):
            m = self.pattern.match(text, at)
            if not m or m.end() == at:
                raise ValueError(f"no turn at {at}")
            known = m.lastindex - 1
            yield (self.ROLES[known], unescaped(m[m.lastindex])) if known < len(self.ROLES) else (unescaped(m[known]), unescaped(m[m.lastindex]))
            at = m.end()


@cache
def compiled(source: str) -> tuple[Template, Reader]:
    template = Template(source)
    if not template.streams:
        raise TemplateError("a template for tables must be a prologue and one loop over messages at its end")
    return template, Reader(template)


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, tree, part, turns, size, formatted, spans): parts of conversations, in order without gaps.

    ``part`` is the place of its first turn, ``turns`` how many it has and ``size`` how many the conversation has;
    ``spans`` are code points [start, end) of ``formatted`` to learn from.  ``tree`` is conv_id as a key without nulls.
    """
    require_columns(conversations, "conv_id", "turn", "role", "text")
    compiled(template)
    spark = conversations.sparkSession
    bounded_batches(spark)
    empty = F.lit("")
    rows = conversations.select(tree_of(F.col("conv_id")).alias("tree"), "conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    turns = placed(written(rows, "turns"), "turn", "role", "text").withColumn("block", F.floor(F.col("pos") / PART_TURNS))
    turns = turns.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos").select("conv_id", "tree", "pos", "size", "role", "text")

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, _ = compiled(template)
        names = ["conv_id", "tree", "part", "turns", "size", "formatted", "spans"]
        done: list[tuple] = []
        held = 0
        sink, key, part, n, size = Sink(), None, 0, 0, 0

        def out() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            kinds = [id_type, pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        def close() -> None:
            text, spans = sink.taken()
            done.append((*key, part, n, size, text, [{"start": a, "end": b} for a, b in spans]))

        id_type = pa.null()
        for batch in batches:
            id_type = batch.schema.field(0).type
            columns = [c.to_pylist() for c in batch.columns]
            for conv, tree, pos, of, role, text in zip(*columns, strict=True):
                if key is not None and (tree != key[1] or pos // PART_TURNS != part // PART_TURNS or sink.length >= PART_BYTES):
                    close()
                    held += sink.length
                    sink, key = Sink(), None
                    if held >= PART_BYTES:
                        yield out()
                        done, held = [], 0
                if key is None:
                    key, part, n, size = (conv, tree), pos, 0, of
                made.turn(sink, {"role": role, "text": text}, pos, of)
                n += 1
        if key is not None:
            close()
        if done:
            yield out()

    kind = conversations.schema["conv_id"].dataType.simpleString()
    return turns.mapInArrow(render, f"conv_id {kind}, tree string, part long, turns long, size long, formatted string, spans array<struct<start:long,end:long>>")


_DIGEST = "conv_id {}, tree string, part long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, told binary, loss binary"


def read_back(parts: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of conversations, read from their formatted parts.

    The first digest is of role, line feed, text, line feed of every turn, the second of the text under the spans.
    """
    kind = parts.schema["conv_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, reader = compiled(template)
        for batch in batches:
            rows = []
            for conv, tree, part, turns, size, text, spans in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                said = list(reader.turns(text, part == 0))
                if len(said) != turns:
                    raise ValueError(f"{len(said)} turns where {turns} were written")
                told = "".join(f"{r}\n{t}\n" for r, t in said).encode()
                lost = "".join(unescaped(text[s["start"] : s["end"]]) for s in spans)
                loss, whole = lost.encode(), turns == size
                digests = (hashlib.sha256(told).hexdigest(), hashlib.sha256(loss).hexdigest()) if whole else (None, None)
                rows.append((conv, tree, part, turns, digests[0], len(lost), digests[1], len(text), None if whole else told, None if whole else loss))
            if rows:
                kinds = [batch.schema.field(0).type, pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
                names = [c.split()[0] for c in _DIGEST.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    bounded_batches(parts.sparkSession)
    wanted = parts.select("conv_id", "tree", "part", "turns", "size", "formatted", "spans")
    found = written(wanted.mapInArrow(read, _DIGEST.format(kind)), "read-back")
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    whole = found.where("turns_sha256 IS NOT NULL").select(*columns)
    longer = found.where("turns_sha256 IS NULL").select("conv_id", "tree", "part", "n_turns", "loss_chars", "formatted_chars", "told", "loss")
    chained = longer.repartition("tree").sortWithinPartitions("tree", "part").mapInArrow(_chained, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return whole.unionByName(chained)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digests of conversations of several parts, which come in order."""
    key, sums, told, loss, conv = None, [0, 0, 0], None, None, None
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def out(kind) -> pa.RecordBatch:
        row = [conv, sums[0], told.hexdigest(), sums[1], loss.hexdigest(), sums[2]]
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names)

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for own, tree, _, turns, chars, length, a, b in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if tree != key:
                if key is not None:
                    yield out(kind)
                key, conv, sums, told, loss = tree, own, [0, 0, 0], hashlib.sha256(), hashlib.sha256()
            sums = [sums[0] + turns, sums[1] + chars, sums[2] + length]
            told.update(a)
            loss.update(b)
    if key is not None:
        yield out(kind)


def oracle(guests: str) -> str:
    """DuckDB SQL over ``conversations`` and the rows ``guests`` (conv_id, turn, role, text)."""
    body = r"replace(replace(replace(t, '\', '\\'), '[', '[\'), '<', '<\')"
    role = r"replace(replace(replace(r, '\', '\\'), '[', '[\'), '<', '<\')"
    return rf"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL {guests})),
        f AS (SELECT *, CASE r WHEN 'user' THEN '[INST] ' || {body} || '[/INST]' WHEN 'assistant' THEN '[ANS] ' || {body} || '</s>' WHEN 'system' THEN '<<SYS>> ' || {body} || '<</SYS>>'
                        ELSE '[ROLE] ' || {role} || '[/ROLE] ' || {body} || '[/TURN]' END AS form FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
               coalesce(sum(length(t)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256, (3 + sum(length(form)))::BIGINT AS formatted_chars
        FROM f GROUP BY conv_id"""
