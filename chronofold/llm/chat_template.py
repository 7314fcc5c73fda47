"""Chat formatting: a compiler for a small sandboxed template language.

Language: text; {{ expression }}; {% for x in expression %} ... {% endfor %} (with loop.index, loop.first, loop.last);
{% if %} {% elif %} {% else %} {% endif %}; {% generation %} ... {% endgeneration %}, whose output is under the loss mask.
Expressions: strings, whole numbers, true, false, none, names, x.key, x["key"], ==, !=, <, <=, >, >=, +, not, and,
or, brackets, and filters a|name. Names reach only what the caller passes and the loop variables; keys only dictionaries and
lists; there are no calls. The parser gives a syntax tree of tuples, folding replaces what holds no name by its value, joins
neighbouring texts and drops dead branches, and each node becomes a Python closure.

The default template writes `### role` and the text of a turn, ended by `</turn>`; the filters escape and escape_line put a
backslash before each backslash and control string inside a text, which parse_turns takes away again.

Nulls: a null role or text is empty, a null turn comes first, null conv_ids form one conversation. Turns with equal numbers go by
role, then text; repeated rows are repeated turns. Empty tables give no rows. Columns besides the four are ignored.
"""

from __future__ import annotations

import hashlib
import operator
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import table

#: Fixed values of the default format.
TURN, END = "### ", "</turn>"
DEFAULT_TEMPLATE = (
    "{% for m in messages %}" + TURN + "{{ m.role|escape_line }}\n"
    '{% if m.role == "assistant" %}{% generation %}{{ m.text|escape }}{% endgeneration %}{% else %}{{ m.text|escape }}{% endif %}' + END + "\n{% endfor %}"
)
_ESCAPE = re.compile(r"\\|" + re.escape(TURN.strip()) + "|" + re.escape(END))
_ESCAPE_LINE = re.compile(_ESCAPE.pattern + "|\n")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TAG = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<str>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>+|.()\[\]]))""")
_CONSTANTS = {"true": True, "false": False, "none": None}
_COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def escape_line(text: str) -> str:
    return _ESCAPE_LINE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": lambda x: escape("" if x is None else str(x)),
    "escape_line": lambda x: escape_line("" if x is None else str(x)),
    "trim": lambda x: str(x).strip(),
    "upper": lambda x: str(x).upper(),
    "lower": lambda x: str(x).lower(),
    "length": len,
}


class TemplateError(ValueError):
    pass


class _Expression:
    """Recursive descent over one expression; nodes: const, name, item, filter, compare, add, not, and, or."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:at + 10]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in values

    def take(self, *values: str) -> bool:
        found = self.peek(*values)
        self.at += found
        return found

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing")

    def whole(self) -> tuple:
        node = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        node = self.added()
        for op in _COMPARE:
            if self.take(op):
                return ("compare", op, node, self.added())
        return node

    def added(self) -> tuple:
        node = self.filtered()
        while self.take("+"):
            node = ("add", node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.single()
        while self.take("|"):
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            node = ("filter", name, node)
        return node

    def single(self) -> tuple:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            node = ("const", _ESCAPED.sub(lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1]))
        elif kind == "num":
            node = ("const", int(value))
        elif kind == "name":
            node = ("const", _CONSTANTS[value]) if value in _CONSTANTS else ("name", value)
        elif value == "(":
            node = self.either()
            self.need(")")
        else:
            raise TemplateError(f"unexpected {value!r}")
        while self.peek(".", "["):
            if self.take("."):
                kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
                if kind != "name":
                    raise TemplateError("a key is missing")
                self.at += 1
                node = ("item", node, ("const", value))
            else:
                self.need("[")
                node = ("item", node, self.either())
                self.need("]")
        return node


def parse(source: str) -> list[tuple]:
    """The syntax tree: text, out, for, if, generation."""
    parts = [p for p in _TAG.split(source) if p]
    at = 0

    def block(ends: tuple[str, ...]) -> tuple[list[tuple], str, str]:
        nonlocal at
        nodes: list[tuple] = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{{"):
                nodes.append(("out", _Expression(part[2:-2]).whole()))
            elif not part.startswith("{%"):
                nodes.append(("text", part))
            else:
                word, _, rest = part[2:-2].strip().partition(" ")
                if word in ends:
                    return nodes, word, rest
                if word == "for":
                    m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
                    if not m or m[1] in _CONSTANTS:
                        raise TemplateError(f"for {rest!r}")
                    body, _, _ = block(("endfor",))
                    nodes.append(("for", m[1], _Expression(m[2]).whole(), body))
                elif word == "if":
                    cases, test, last = [], _Expression(rest).whole(), False
                    while True:
                        body, end, more = block(("elif", "else", "endif"))
                        cases.append((test, body))
                        if end == "endif":
                            break
                        if last:
                            raise TemplateError("a case follows else")
                        last = end == "else"
                        test = _Expression(more).whole() if end == "elif" else ("const", True)
                    nodes.append(("if", cases))
                elif word == "generation":
                    body, _, _ = block(("endgeneration",))
                    nodes.append(("generation", body))
                else:
                    raise TemplateError(f"unknown tag {word!r}")
        if ends:
            raise TemplateError(f"{' or '.join(ends)} is missing")
        return nodes, "", ""

    return block(())[0]


def _item(held: Any, key: Any) -> Any:
    if isinstance(held, dict):
        return held.get(key)
    if isinstance(held, (list, tuple)) and isinstance(key, int) and 0 <= key < len(held):
        return held[key]
    raise TemplateError(f"{key!r} can't be reached")


_VALUES: dict[str, Callable] = {"item": _item, "add": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else ("" if a is None else str(a)) + ("" if b is None else str(b)), "not": lambda a: not a}


def _fold_value(node: tuple) -> tuple:
    kind = node[0]
    if kind in ("const", "name"):
        return node
    if kind in ("and", "or"):
        a, b = _fold_value(node[1]), _fold_value(node[2])
        if a[0] == "const":
            return b if bool(a[1]) == (kind == "and") else a
        return (kind, a, b)
    head, inner = (node[:2], node[2:]) if kind in ("filter", "compare") else (node[:1], node[1:])
    inner = tuple(map(_fold_value, inner))
    if all(x[0] == "const" for x in inner):
        return ("const", _apply(head)(*(x[1] for x in inner)))
    return (*head, *inner)


def _apply(head: tuple) -> Callable:
    return FILTERS[head[1]] if head[0] == "filter" else _COMPARE[head[1]] if head[0] == "compare" else _VALUES[head[0]]


def fold(nodes: list[tuple]) -> list[tuple]:
    """Constants computed, neighbouring texts joined, branches that are never or always taken resolved."""
    out: list[tuple] = []

    def add(node: tuple) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in nodes:
        kind = node[0]
        if kind == "text":
            add(node)
        elif kind == "out":
            value = _fold_value(node[1])
            add(("text", "" if value[1] is None else str(value[1])) if value[0] == "const" else ("out", value))
        elif kind == "for":
            source, body = _fold_value(node[2]), fold(node[3])
            if body and source not in (("const", None), ("const", "")):
                add(("for", node[1], source, body))
        elif kind == "generation":
            add(("generation", fold(node[1])))
        else:
            cases = []
            for test, body in node[1]:
                test, body = _fold_value(test), fold(body)
                if test[0] != "const":
                    cases.append((test, body))
                elif test[1]:
                    cases.append((("const", True), body))
                    break
            if cases and cases[0][0][0] == "const":
                for inner in cases[0][1]:
                    add(inner)
            elif cases:
                add(("if", cases))
    return out


class _Output:
    __slots__ = ("parts", "size", "spans")

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


def _value(node: tuple) -> Callable[[dict], Any]:
    kind = node[0]
    if kind == "const":
        return lambda env, v=node[1]: v
    if kind == "name":

        def name(env: dict, key: str = node[1]) -> Any:
            if key not in env:
                raise TemplateError(f"no name {key!r}")
            return env[key]

        return name
    if kind == "and":
        return lambda env, a=_value(node[1]), b=_value(node[2]): a(env) and b(env)
    if kind == "or":
        return lambda env, a=_value(node[1]), b=_value(node[2]): a(env) or b(env)
    head, inner = (node[:2], node[2:]) if kind in ("filter", "compare") else (node[:1], node[1:])
    f, inner = _apply(head), tuple(map(_value, inner))
    if len(inner) == 1:
        return lambda env, f=f, a=inner[0]: f(a(env))
    return lambda env, f=f, a=inner[0], b=inner[1]: f(a(env), b(env))


def _closure(nodes: list[tuple]) -> Callable[[dict, _Output], None]:
    steps: list[Callable[[dict, _Output], None]] = []
    for node in nodes:
        kind = node[0]
        if kind == "text":
            steps.append(lambda env, out, t=node[1]: out.write(t))
        elif kind == "out":

            def show(env: dict, out: _Output, f=_value(node[1])) -> None:
                x = f(env)
                out.write("" if x is None else x if isinstance(x, str) else str(x))

            steps.append(show)
        elif kind == "for":

            def loop(env: dict, out: _Output, name=node[1], source=_value(node[2]), body=_closure(node[3])) -> None:
                items = list(source(env) or ())
                for k, x in enumerate(items):
                    body(env | {name: x, "loop": {"index": k + 1, "first": not k, "last": k + 1 == len(items)}}, out)

            steps.append(loop)
        elif kind == "generation":

            def mark(env: dict, out: _Output, body=_closure(node[1])) -> None:
                begin = out.size
                body(env, out)
                out.spans.append((begin, out.size))

            steps.append(mark)
        else:

            def choose(env: dict, out: _Output, cases=[(_value(t), _closure(b)) for t, b in node[1]]) -> None:
                for test, body in cases:
                    if test(env):
                        body(env, out)
                        return

            steps.append(choose)
    if len(steps) == 1:
        return steps[0]

    def run(env: dict, out: _Output) -> None:
        for step in steps:
            step(env, out)

    return run


def compile_template(source: str) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from the names to (text, spans under the loss mask)."""
    run = _closure(fold(parse(source)))

    def render(env: dict) -> tuple[str, list[tuple[int, int]]]:
        out = _Output()
        run(env, out)
        return "".join(out.parts), out.spans

    return render


def _close(text: str, at: int, mark: str) -> int:
    """The first place of mark from `at` on that no backslash escapes."""
    found = text.find(mark, at)
    while found >= 0:
        k = found
        while k > at and text[k - 1] == "\\":
            k -= 1
        if (found - k) % 2 == 0:
            return found
        found = text.find(mark, found + 1)
    raise ValueError(f"{mark!r} is missing")


def parse_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of the default format."""
    turns, at = [], 0
    while at < len(text):
        if not text.startswith(TURN, at):
            raise ValueError(f"no turn at {at}")
        line = _close(text, at + len(TURN), "\n")
        end = _close(text, line + 1, END + "\n")
        turns.append((unescape(text[at + len(TURN) : line]), unescape(text[line + 1 : end])))
        at = end + len(END) + 1
    return turns


def format_conversations(conversations: DataFrame, template: str = DEFAULT_TEMPLATE, partitions: int | None = None) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_starts, loss_ends (code points of the formatted text).

    Rows are dealt by conv_id and sorted, and each conversation is rendered when its last row has passed, so a task holds one
    conversation at a time.
    """
    spark = conversations.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = conversations.selectExpr("cast(conv_id as bigint) as conv_id", "cast(turn as bigint) as turn", "cast(role as string) as role", "cast(text as string) as text")
    dealt = rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        held: list[dict] = []
        current: Any = held  # no conv_id is this list
        done: list[tuple] = []
        size = 0

        def pack() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())))]
            return pa.RecordBatch.from_arrays(columns, ["conv_id", "formatted", "loss_starts", "loss_ends"])

        def finish() -> None:
            nonlocal size
            text, spans = render({"messages": held})
            done.append((current, text, [a for a, _ in spans], [b for _, b in spans]))
            size += len(text)

        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if conv != current and held:
                    finish()
                    held = []
                    if size > 4 << 20:
                        yield pack()
                        done, size = [], 0
                current = conv
                held.append({"role": role or "", "text": text or ""})
        if held:
            finish()
        if done:
            yield pack()

    return dealt.mapInArrow(run, "conv_id long, formatted string, loss_starts array<long>, loss_ends array<long>")


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and loss text taken from the formatted text again, as counts and digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                turns, digest = parse_turns(r["formatted"]), hashlib.sha256()
                for role, text in turns:
                    digest.update(f"{role}\n{text}\n".encode())
                loss = "".join(unescape(r["formatted"][a:b]) for a, b in zip(r["loss_starts"], r["loss_ends"]))
                rows.append((r["conv_id"], len(turns), digest.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(r["formatted"])))
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op10_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(format_conversations(rows))


QUERIES = {"op10_chat_template": op10_chat_template}
ORACLE_SQL = {
    "op10_chat_template": """
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok', 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok', 'assistant', '\\### Assistant: </turn> ok'
), escaped AS (
  SELECT *, replace(replace(replace(text, '\\', '\\\\'), '###', '\\###'), '</turn>', '\\</turn>') AS e,
    replace(replace(replace(replace(role, '\\', '\\\\'), '###', '\\###'), '</turn>', '\\</turn>'), chr(10), '\\' || chr(10)) AS er
  FROM rows_
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (WHERE role = 'assistant'), '') AS loss,
    CAST(sum(4 + length(er) + 1 + length(e) + 8) AS BIGINT) AS formatted_chars
  FROM escaped GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
}
