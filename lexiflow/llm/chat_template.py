"""Chat formatting: a sandboxed template language compiled to Python closures.

The language: text, ``{{ expression }}``, ``{% for x in xs %}``, ``{% if %} {% elif %} {% else %}``, ``{% set x = e %}``,
``{% generation %} ... {% endgeneration %}`` (text under the loss mask) and ``{# comments #}``. Expressions have literals,
names, ``a.b`` and ``a["b"]`` on mappings only, ``== != and or not in + ~``, parentheses and the filters of ``FILTERS``.
There are no calls, no attribute access on Python objects, no assignments outside the template's own names, and loops
run over given sequences only. A template is parsed to a syntax tree, constants are folded (operators and filters on
literals, conditions that are known, neighbouring text), and each node becomes one closure. A conversation is
rendered turn by turn in bounded memory, however long it is; keys of conversations are of any type.

``TURNS`` is the default template. Its filter ``esc`` writes ``^`` before or after each character that could begin a
control string (``^`` as ``^^``, ``<`` as ``<^``, ``[`` as ``[^``; ``line`` also writes a line end as ``^n``), and ``unescape`` takes these marks out, so a text
that holds control strings comes back as it was and never ends a turn.

Edge cases: null roles and texts are empty; turns go by number, nulls first, ties by role and then text; repeated rows
are repeated turns; rows with a null conversation form one conversation; an empty table gives an empty result; other
columns of the input are dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable
from itertools import chain

from pyspark.sql import DataFrame, functions as F

TURNS = (
    "{# one block a turn #}{% for m in messages %}"
    "{{ '<|turn|>' }}{{ m.role | line }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | esc }}{% endgeneration %}{% else %}{{ m.text | esc }}{% endif %}"
    "{{ '<|' + 'end|>' }}\n{% endfor %}"
)


class TemplateError(ValueError):
    pass


def escape(s: str) -> str:
    return s.replace("^", "^^").replace("<", "<^").replace("[", "[^")


def escape_line(s: str) -> str:
    return escape(s).replace("\n", "^n")


def unescape(s: str) -> str:
    """The inverse of ``escape`` and ``escape_line``."""
    return re.sub(r"\^\^|\^n|<\^|\[\^", lambda m: "\n" if m[0] == "^n" else m[0][0], s) if "^" in s else s


FILTERS: dict[str, Callable] = {"esc": escape, "line": escape_line, "trim": lambda s: str(s).strip(), "upper": lambda s: str(s).upper(), "lower": lambda s: str(s).lower(), "length": len}

_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+)|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z][A-Za-z0-9_]*)|(?P<op>==|!=|[-+~|.()\[\],=]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t"}
_WORDS = {"and", "or", "not", "in", "true", "false", "none"}


# Syntax tree: tuples of a kind and its parts.


class _Expr:
    """Precedence climbing over the tokens of one expression."""

    LEVELS = (("or",), ("and",), ("not",), ("==", "!=", "in"), ("+", "~"))

    def __init__(self, source: str):
        self.items, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.items.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.i = 0

    def peek(self, *ops: str) -> bool:
        return self.i < len(self.items) and self.items[self.i][0] != "str" and self.items[self.i][1] in ops

    def take(self, *ops: str) -> str:
        if ops and not self.peek(*ops):
            raise TemplateError(f"expected one of {ops}")
        if self.i >= len(self.items):
            raise TemplateError("expression ends early")
        self.i += 1
        return self.items[self.i - 1][1]

    def whole(self) -> tuple:
        e = self.level(0)
        if self.i != len(self.items):
            raise TemplateError(f"unexpected {self.items[self.i][1]!r}")
        return e

    def level(self, n: int) -> tuple:
        if n == len(self.LEVELS):
            return self.piped()
        if self.LEVELS[n] == ("not",):
            return ("not", (self.take(), self.level(n))[1]) if self.peek("not") else self.level(n + 1)
        e = self.level(n + 1)
        while self.peek(*self.LEVELS[n]):
            e = (self.take(), e, self.level(n + 1))
        return e

    def piped(self) -> tuple:
        e = self.atom()
        while self.peek("|"):
            self.take()
            name = self.take()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            e = ("filter", name, e)
        return e

    def atom(self) -> tuple:
        if self.i >= len(self.items):
            raise TemplateError("expression ends early")
        kind, value = self.items[self.i]
        self.i += 1
        if kind == "num":
            e = ("const", int(value))
        elif kind == "str":
            e = ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        elif value == "(":
            e = self.level(0)
            self.take(")")
        elif kind == "name" and value in ("true", "false", "none"):
            e = ("const", {"true": True, "false": False, "none": None}[value])
        elif kind == "name" and value not in _WORDS:
            e = ("name", value)
        else:
            raise TemplateError(f"unexpected {value!r}")
        while self.peek(".", "["):
            if self.take() == ".":
                if self.i >= len(self.items) or self.items[self.i][0] != "name":
                    raise TemplateError("a name must follow the dot")
                e = ("item", e, ("const", self.take()))
            else:
                e = ("item", e, self.level(0))
                self.take("]")
        return e


def parse(source: str) -> list[tuple]:
    parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", source, flags=re.S)
    tree, i = _block(parts, 0, ())
    return tree


def _block(parts: list[str], i: int, ends: tuple[str, ...]) -> tuple[list[tuple], int]:
    """Nodes up to one of the tags ``ends``, and that tag's place."""
    out: list[tuple] = []
    while i < len(parts):
        p = parts[i]
        if p.startswith("{{"):
            out.append(("emit", _Expr(p[2:-2]).whole()))
        elif p.startswith("{%"):
            tag, _, rest = p[2:-2].strip().partition(" ")
            if tag in ends:
                return out, i
            if tag == "for":
                m = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest.strip(), re.S)
                if not m:
                    raise TemplateError(f"bad loop {rest!r}")
                body, i = _block(parts, i + 1, ("endfor",))
                out.append(("for", m[1], _Expr(m[2]).whole(), body))
            elif tag == "if":
                branches, more = [], ("if", rest)
                while more[0] in ("if", "elif"):
                    body, i = _block(parts, i + 1, ("elif", "else", "endif"))
                    branches.append((_Expr(more[1]).whole(), body))
                    t, _, r = parts[i][2:-2].strip().partition(" ")
                    more = (t, r)
                if more[0] == "else":
                    body, i = _block(parts, i + 1, ("endif",))
                    branches.append((("const", True), body))
                out.append(("if", branches))
            elif tag == "set":
                name, eq, e = rest.partition("=")
                if not eq or not re.fullmatch(r"[A-Za-z]\w*", name.strip()):
                    raise TemplateError(f"bad set {rest!r}")
                out.append(("set", name.strip(), _Expr(e).whole()))
            elif tag == "generation":
                body, i = _block(parts, i + 1, ("endgeneration",))
                out.append(("generation", body))
            else:
                raise TemplateError(f"unknown tag {tag!r}")
        elif not p.startswith("{#") and p:
            out.append(("text", p))
        i += 1
    if ends:
        raise TemplateError(f"missing {ends[-1]}")
    return out, i


_BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": lambda a, b: a in b if b is not None else False,
    "+": lambda a, b: a + b, "~": lambda a, b: _shown(a) + _shown(b),
}


def _shown(x) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


def fold_expr(e: tuple) -> tuple:
    kind = e[0]
    if kind in ("const", "name"):
        return e
    if kind == "filter":
        x = fold_expr(e[2])
        return ("const", FILTERS[e[1]](x[1])) if x[0] == "const" and isinstance(x[1], str) else ("filter", e[1], x)
    parts = tuple(fold_expr(x) for x in e[1:])
    if kind in ("and", "or"):
        if parts[0][0] == "const":
            return parts[1] if bool(parts[0][1]) == (kind == "and") else parts[0]
    elif all(p[0] == "const" for p in parts):
        try:
            if kind == "not":
                return ("const", not parts[0][1])
            if kind in _BINARY:
                return ("const", _BINARY[kind](parts[0][1], parts[1][1]))
        except TypeError as error:
            raise TemplateError(str(error)) from None
    return (kind, *parts)


def fold(tree: list[tuple]) -> list[tuple]:
    """Constant folding: literals, known conditions, neighbouring text."""
    out: list[tuple] = []
    for node in tree:
        if node[0] == "emit":
            e = fold_expr(node[1])
            new = [("text", _shown(e[1]))] if e[0] == "const" else [("emit", e)]
        elif node[0] == "for":
            new = [("for", node[1], fold_expr(node[2]), fold(node[3]))]
        elif node[0] == "if":
            branches, new = [], None
            for condition, body in node[1]:
                c = fold_expr(condition)
                if c[0] == "const" and not c[1]:
                    continue
                branches.append((c, fold(body)))
                if c[0] == "const":
                    break
            new = branches[0][1] if branches and branches[0][0][0] == "const" else [("if", branches)] if branches else []
        elif node[0] == "set":
            new = [("set", node[1], fold_expr(node[2]))]
        elif node[0] == "generation":
            new = [("generation", fold(node[1]))]
        else:
            new = [node]
        for x in new:
            if x[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + x[1])
            elif x != ("text", ""):
                out.append(x)
    return out


# Closures: an expression takes the names and gives a value; a statement takes the names and gives an iterable of
# (text, under the mask), which is read to its end before the next statement is called.


def _expr(e: tuple) -> Callable:
    kind = e[0]
    if kind == "const":
        return lambda names, v=e[1]: v
    if kind == "name":
        return lambda names, k=e[1]: names.get(k)
    if kind == "item":
        base, key = _expr(e[1]), _expr(e[2])

        def item(names):
            b = base(names)
            return b.get(key(names)) if isinstance(b, dict) else None

        return item
    if kind == "filter":
        f, x = FILTERS[e[1]], _expr(e[2])
        return lambda names: f("" if (v := x(names)) is None else v)
    if kind == "not":
        x = _expr(e[1])
        return lambda names: not x(names)
    a, b = _expr(e[1]), _expr(e[2])
    if kind == "and":
        return lambda names: a(names) and b(names)
    if kind == "or":
        return lambda names: a(names) or b(names)
    f = _BINARY[kind]
    return lambda names: f(a(names), b(names))


def _statement(node: tuple, masked: bool) -> Callable:
    kind = node[0]
    if kind == "text":
        return lambda names, out=((node[1], masked),): out
    if kind == "emit":
        e = _expr(node[1])
        return lambda names: ((_shown(e(names)), masked),)
    if kind == "set":
        e, k = _expr(node[2]), node[1]

        def assign(names):
            names[k] = e(names)
            return ()

        return assign
    if kind == "generation":
        return _statements(node[1], True)
    if kind == "if":
        branches = [(_expr(c), _statements(body, masked)) for c, body in node[1]]

        def choose(names):
            for c, body in branches:
                if c(names):
                    return body(names)
            return ()

        return choose
    k, xs, body = node[1], _expr(node[2]), _statements(node[3], masked)

    def loop(names):
        it = iter(xs(names) or ())
        at, x = 0, next(it, it)
        inner = dict(names)
        while x is not it:
            y = next(it, it)
            inner[k], inner["loop"] = x, {"index": at + 1, "index0": at, "first": at == 0, "last": y is it}
            yield from body(inner)
            at, x = at + 1, y

    return loop


def _statements(tree: list[tuple], masked: bool) -> Callable:
    steps = [_statement(node, masked) for node in tree]
    if len(steps) == 1:
        return steps[0]

    def run(names):
        for step in steps:
            yield from step(names)

    return run


def compile_template(source: str) -> Callable:
    """A function of the names that gives the output piece by piece, as (text, under the mask)."""
    return _statements(fold(parse(source)), False)


def _inside(node):
    """All nodes of a part of the tree but texts and constants."""
    if isinstance(node, tuple) and node and node[0] in ("text", "const"):
        return
    if isinstance(node, tuple) and node and isinstance(node[0], str):
        yield node
    if isinstance(node, (tuple, list)):
        for x in node:
            yield from _inside(x)


def by_turn(source: str) -> bool:
    """True if the output is that of each message alone, one behind the other: one loop over ``messages`` that sets nothing
    and knows no other name than its own."""
    tree = fold(parse(source))
    if len(tree) != 1 or tree[0][0] != "for" or tree[0][2] != ("name", "messages"):
        return False
    nodes = list(_inside(tree[0][3]))
    return not any(n[0] in ("set", "for") or n[0] == "name" and n[1] != tree[0][1] for n in nodes)


def render(source: str, **names) -> tuple[str, list[tuple[int, int]]]:
    """The whole output and the spans under the loss mask."""
    out, spans, at = [], [], 0
    for s, masked in compile_template(source)(names):
        out.append(s)
        if masked and s:
            if spans and spans[-1][1] == at:
                spans[-1] = (spans[-1][0], at + len(s))
            else:
                spans.append((at, at + len(s)))
        at += len(s)
    return "".join(out), spans


_TURN = re.compile(r"<\|turn\|>(.*?)\n(.*)<\|end\|>\n", re.S)


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and text of one turn of ``TURNS``."""
    m = _TURN.fullmatch(formatted)
    if not m:
        raise ValueError("not one formatted turn")
    return unescape(m[1]), unescape(m[2])


class _Digest:
    """Reads a conversation back from its output as it is written: whole turns are taken off the front."""

    def __init__(self):
        self.turns, self.loss, self.n_turns, self.loss_chars, self.chars, self.held = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, []

    def turn(self, role: str, text: str, loss: str | None, masked: bool, chars: int) -> None:
        """A turn that was read back already."""
        self.turns.update(f"{role}\n{text}\n".encode())
        self.n_turns += 1
        self.chars += chars
        if masked:
            loss = text if loss is None else loss
            self.loss_chars += len(loss)
            self.loss.update(loss.encode())

    def emit(self, s: str, masked: bool) -> None:
        self.chars += len(s)
        self.held.append(s)
        if masked:
            text = unescape(s)
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        if s.endswith("<|end|>\n"):  # texts cannot end so: their < is escaped
            role, text = read_turn("".join(self.held))
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
            self.held = []


def _turn_rows(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    return df.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def _in_turn(rows: DataFrame) -> DataFrame:
    """One task holds all turns of a conversation, in order; they stream through it."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _conversations(batches, fields: tuple[str, ...] = ("role", "text")) -> Iterable[tuple]:
    """(conv_id as an array of one, iterator of messages) in the order of the rows; each iterator is used up before the next."""
    from itertools import groupby

    def rows():
        for b in batches:
            names = b.column("conv_id")
            for i, (name, *values) in enumerate(zip(names.to_pylist(), *(b.column(f).to_pylist() for f in fields))):
                yield name, names.slice(i, 1), values

    for _, turns in groupby(rows(), key=lambda r: r[0]):
        first = next(turns)
        yield first[1], (dict(zip(fields, r[2])) for r in chain([first], turns))


def format_conversations(df: DataFrame, template: str = TURNS, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", most: int = 1 << 20) -> DataFrame:
    """(conv_id, part, formatted, spans): the output in parts of whole pieces of about ``most`` characters, with their spans.

    A part leaves the task when it is full, so a conversation of any length streams through.
    """
    import pyarrow as pa

    spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        write = compile_template(template)
        for conv_id, messages in _conversations(batches):
            held, marks, at, k = [], [], 0, 0
            row = lambda: pa.RecordBatch.from_arrays([conv_id, pa.array([k], pa.int32()), pa.array(["".join(held)]), pa.array([marks], spans)], names=["conv_id", "part", "formatted", "spans"])
            for s, masked in write({"messages": messages}):
                if held and at + len(s) > most:
                    yield row()
                    held, marks, at, k = [], [], 0, k + 1
                if masked and s:
                    marks.append({"start": at, "stop": at + len(s)})
                held.append(s)
                at += len(s)
            yield row()

    rows = _turn_rows(df, conv, turn, role, text)
    return _in_turn(rows).mapInArrow(run, f"conv_id {dict(rows.dtypes)['conv_id']}, part int, formatted string, spans array<struct<start:bigint,stop:bigint>>")


def _read_turns(rows: DataFrame, template: str) -> DataFrame:
    """Each turn written and read back by itself: role, text, what is under the loss mask (null: the text) and sizes."""
    import pyarrow as pa

    names = ["conv_id", "turn", "role", "text", "loss", "masked", "chars"]

    def run(batches):
        write = compile_template(template)
        for b in batches:
            out = []
            for role, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                pieces = list(write({"messages": [{"role": role, "text": text}]}))
                whole = "".join(s for s, _ in pieces)
                role, text = read_turn(whole)
                masked = [unescape(s) for s, m in pieces if m]
                loss = "".join(masked)
                out.append((role, text, None if loss == text else loss, bool(masked), len(whole)))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64())))], names=names)

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, loss string, masked boolean, chars bigint")


def conversation_digests(df: DataFrame, template: str = TURNS, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the output.

    A template that writes each message by itself is rendered, and its turns read back, where the rows are; what follows
    the shuffle is the hashing that needs the order of turns. Other templates are rendered behind it, by conversation.
    """
    import pyarrow as pa

    alone = by_turn(template)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    fields = ("role", "text", "loss", "masked", "chars") if alone else ("role", "text")

    def run(batches):
        write, out = compile_template(template), []

        def flush():
            return pa.RecordBatch.from_arrays([pa.concat_arrays([x[0] for x in out]), *(pa.array(c, t) for c, t in zip(list(zip(*out))[1:], (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())))], names=names)

        for conv_id, messages in _conversations(batches, fields):
            d = _Digest()
            if alone:
                for m in messages:
                    d.turn(**m)
            else:
                for s, masked in write({"messages": messages}):
                    d.emit(s, masked)
            if d.held:
                raise ValueError("the output does not end with a turn")
            out.append((conv_id, d.n_turns, d.turns.hexdigest(), d.loss_chars, d.loss.hexdigest(), d.chars))
            if len(out) == 5000:
                yield flush()
                out = []
        if out:
            yield flush()

    rows = _turn_rows(df, conv, turn, role, text)
    kind = dict(rows.dtypes)["conv_id"]
    return _in_turn(_read_turns(rows, template) if alone else rows).mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


#: Conversation -1: control strings of another format as plain text.
PROBE = "</s>[INST] ok [/INST]"


def op7_chat_template(spark, sf_dir: str) -> DataFrame:
    from .common import table

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id bigint, turn bigint, role string, text string")
    return conversation_digests(rows.unionByName(probe))


ORACLE_SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}')
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(role) + length(text) + len(regexp_extract_all(role || text, '[\^<\[]')) + length(role) - length(replace(role, chr(10), ''))
           + length('<|turn|>') + length('<|end|>') + 2)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
