r"""Chat formatting by a template compiler (operator 12).

A template is parsed into a syntax tree, constants are folded, and the tree becomes nested Python closures; no template text is
ever evaluated as Python. The language has ``{{ expression }}``, ``{% for x in xs %}``, ``{% if %}`` with ``elif`` and ``else``,
``{% set x = expression %}`` and ``{% generation %}``, whose output is what the loss is taken on. Expressions have literals, names,
``a.b`` and ``a["b"]`` into mappings only, ``== != < > <= >= in``, ``not and or``, ``+ ~`` and the filters of FILTERS. There are no
calls, no attributes of Python objects, no loops but over the turns, and a nesting limit: a template cannot reach outside.

Closures are generators, so a conversation streams: rows are dealt by conversation and sorted by turn (then role and text), and a
task holds one turn and one piece of output at a time, however long a conversation is. What must follow in order, the
whole text and its digests, is sequential by nature. Output comes in pieces of at least ``PIECE`` characters with the spans
of generated text, as offsets into the whole conversation.

The template TURNS marks turns, and ``escape`` breaks control strings inside texts: backslashes are doubled and a backslash is put
behind the first character of each control string, so a marker in the output is a marker; ``unescape`` takes any backslash off.

Defined cases: a null text or role is an empty one; rows without a conversation id are one conversation without id. Turns that
repeat are all formatted, ties by role and text; null turns come first. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, BETWEEN, CLOSE = "### ", ": ", "</turn>"
NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}
PIECE, DEPTH = 1 << 16, 40

TURNS = """{%- for turn in turns -%}
{{ open }}{% if turn.role in names %}{{ turn.role | title }}{% else %}{{ "?" ~ turn.role | escape }}{% endif %}{{ between }}
{%- if turn.role == "assistant" %}{% generation %}{{ turn.text | escape }}{% endgeneration %}{% else %}{{ turn.text | escape }}{% endif %}{{ close ~ "\\n" }}
{%- endfor -%}"""
CONSTANTS = {"open": OPEN, "between": BETWEEN, "close": CLOSE, "names": list(NAMES)}


class TemplateError(ValueError):
    """The template is not one of the language."""


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for control in (OPEN, BETWEEN, CLOSE):
        if control in text:
            text = text.replace(control, f"{control[0]}\\{control[1:]}")
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


FILTERS: dict[str, Callable] = {"escape": lambda s: escape(str(s)), "trim": lambda s: str(s).strip(), "lower": lambda s: str(s).lower(), "upper": lambda s: str(s).upper(), "title": lambda s: str(s).title(), "length": len}
COMPARE: dict[str, Callable] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b}
TOKEN = re.compile(r"""\s*(?:(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|[<>+~|.\[\]()]))""", re.S)
ESCAPED = {"n": "\n", "t": "\t", "r": "\r"}
WORDS = {"and", "or", "not", "in", "if", "else", "elif", "for", "set"}


class Expression:
    """Recursive descent over the tokens of one expression; nodes are tuples ``(kind, ...)``."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at, self.depth = 0, 0

    def whole(self) -> tuple:
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def next_is(self, *texts: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "string" and self.tokens[self.at][1] in texts:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, text: str) -> None:
        if not self.next_is(text):
            raise TemplateError(f"{text!r} is missing")

    def either(self) -> tuple:
        self.depth += 1
        if self.depth > DEPTH:
            raise TemplateError("expression is nested too deeply")
        node = self.both()
        while self.next_is("or"):
            node = ("or", node, self.both())
        self.depth -= 1
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.next_is("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        odd = False
        while self.next_is("not"):
            odd = not odd
        node = self.compared()
        return ("not", node) if odd else node

    def compared(self) -> tuple:
        node = self.joined()
        while sign := self.next_is(*COMPARE, "not"):
            if sign == "not":
                self.need("in")
                node = ("not", ("compare", "in", node, self.joined()))
            else:
                node = ("compare", sign, node, self.joined())
        return node

    def joined(self) -> tuple:
        node = self.filtered()
        while sign := self.next_is("+", "~"):
            node = (sign, node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.reached()
        while self.next_is("|"):
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            node = ("filter", name, node)
        return node

    def reached(self) -> tuple:
        node = self.atom()
        while sign := self.next_is(".", "["):
            if sign == ".":
                kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
                if kind != "name":
                    raise TemplateError("a name must follow the dot")
                self.at += 1
                node = ("get", node, ("value", name))
            else:
                node = ("get", node, self.either())
                self.need("]")
        return node

    def atom(self) -> tuple:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        self.at += 1
        if kind == "string":
            return ("value", re.sub(r"\\(.)", lambda m: ESCAPED.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "number":
            return ("value", int(text))
        if kind == "name" and text not in WORDS:
            return ("value", {"true": True, "false": False, "none": None}[text]) if text in ("true", "false", "none") else ("name", text)
        if text == "(":
            node = self.either()
            self.need(")")
            return node
        raise TemplateError(f"unexpected {text!r}")


def parse(template: str) -> list[tuple]:
    """The syntax tree: ``text``, ``print``, ``for``, ``if``, ``set`` and ``generation`` nodes."""
    pieces = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", template, flags=re.S)
    for k in range(1, len(pieces), 2):  # a dash takes the white space beside it
        if pieces[k][2] == "-":
            pieces[k - 1] = pieces[k - 1].rstrip()
        if pieces[k][-3] == "-":
            pieces[k + 1] = pieces[k + 1].lstrip()
    stack: list[tuple[str, list, list]] = [("", [], [])]  # kind, node under way, its body

    def put(node: tuple) -> None:
        stack[-1][2].append(node)

    for k, piece in enumerate(pieces):
        if k % 2 == 0:
            if "{{" in piece or "{%" in piece:
                raise TemplateError("a tag is not closed")
            if piece:
                put(("text", piece))
            continue
        inner = piece[2:-2].strip("-").strip()
        if piece[1] == "{":
            put(("print", Expression(inner).whole()))
            continue
        word, _, rest = inner.partition(" ")
        if word == "for" and (m := re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)):
            stack.append(("for", [m[1], Expression(m[2]).whole()], []))
        elif word == "if":
            stack.append(("if", [[Expression(rest).whole()]], []))
        elif word in ("elif", "else") and stack[-1][0] == "if" and len(stack[-1][1][-1]) == 1 and stack[-1][1][-1][0] != ("value", "else"):
            kind, node, body = stack.pop()
            node[-1].append(body)
            stack.append(("if", [*node, [Expression(rest).whole() if word == "elif" else ("value", "else")]], []))
        elif word == "generation" and not rest:
            if any(kind == "generation" for kind, _, _ in stack):
                raise TemplateError("generation within generation")
            stack.append(("generation", [], []))
        elif word == "set" and (m := re.fullmatch(r"([A-Za-z_]\w*)\s*=\s*(.+)", rest, re.S)):
            put(("set", m[1], Expression(m[2]).whole()))
        elif word in ("endfor", "endif", "endgeneration") and stack[-1][0] == word[3:]:
            kind, node, body = stack.pop()
            if kind == "if":
                node[-1].append(body)
                put(("if", [tuple(x) for x in node]))
            else:
                put((kind, *node, body))
        else:
            raise TemplateError(f"unexpected tag {piece!r}")
        if len(stack) > DEPTH:
            raise TemplateError("tags are nested too deeply")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    return stack[0][2]


def reach(at, key):
    """An entry of a mapping; nothing else of any object."""
    return at.get(key) if isinstance(at, dict) else None


def shown(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


OPERATIONS: dict[str, Callable] = {"or": lambda a, b: a or b, "and": lambda a, b: a and b, "+": lambda a, b: a + b, "~": lambda a, b: shown(a) + shown(b), "get": reach}


def fold_expression(node: tuple, known: dict) -> tuple:
    """The expression with all that depends on constants worked out."""
    kind = node[0]
    if kind == "name":
        return ("value", known[node[1]]) if node[1] in known else node
    if kind == "value":
        return node
    if kind in ("compare", "filter"):
        kids = [fold_expression(x, known) for x in node[2:]]
        function = COMPARE[node[1]] if kind == "compare" else FILTERS[node[1]]
        return ("value", function(*(x[1] for x in kids))) if all(x[0] == "value" for x in kids) else (kind, node[1], *kids)
    kids = [fold_expression(x, known) for x in node[1:]]
    if all(x[0] == "value" for x in kids):
        return ("value", not kids[0][1] if kind == "not" else OPERATIONS[kind](*(x[1] for x in kids)))
    if kind in ("and", "or") and kids[0][0] == "value":
        return kids[1] if bool(kids[0][1]) == (kind == "and") else kids[0]
    return (kind, *kids)


def names_set(body: list[tuple]) -> set[str]:
    out: set[str] = set()
    for node in body:
        if node[0] in ("set", "for"):
            out.add(node[1])
        for inner in [x[1] for x in node[1]] if node[0] == "if" else [node[-1]] if node[0] in ("for", "generation") else []:
            out |= names_set(inner)
    return out


def fold(body: list[tuple], known: dict) -> list[tuple]:
    """Constants worked out, branches that cannot be taken left out, neighbouring texts joined."""
    out: list[tuple] = []
    for node in body:
        if node[0] == "print":
            inner = fold_expression(node[1], known)
            node = ("text", shown(inner[1])) if inner[0] == "value" else ("print", inner)
        elif node[0] == "for":
            node = ("for", node[1], fold_expression(node[2], known), fold(node[3], known))
        elif node[0] == "set":
            node = ("set", node[1], fold_expression(node[2], known))
        elif node[0] == "generation":
            node = ("generation", fold(node[1], known))
        elif node[0] == "if":
            arms = []
            for test, inner in node[1]:
                test = fold_expression(test, known)
                if test[0] == "value" and not test[1]:
                    continue
                arms.append((test, fold(inner, known)))
                if test[0] == "value":
                    break
            if arms and arms[0][0][0] == "value":
                out += arms[0][1]
                continue
            if not arms:
                continue
            node = ("if", arms)
        if node[0] == "text" and out and out[-1][0] == "text":
            node = ("text", out.pop()[1] + node[1])
        if node != ("text", ""):
            out.append(node)
    joined: list[tuple] = []
    for node in out:  # an if that fell away may leave two texts side by side
        if node[0] == "text" and joined and joined[-1][0] == "text":
            node = ("text", joined.pop()[1] + node[1])
        joined.append(node)
    return joined


def valued(node: tuple) -> Callable[[dict], object]:
    """A closure that works an expression out in an environment."""
    kind = node[0]
    if kind == "value":
        return lambda env, v=node[1]: v
    if kind == "name":
        return lambda env, n=node[1]: env.get(n)
    if kind in ("compare", "filter"):
        kids, function = [valued(x) for x in node[2:]], COMPARE[node[1]] if kind == "compare" else FILTERS[node[1]]
        return (lambda env, a=kids[0]: function(a(env))) if len(kids) == 1 else (lambda env, a=kids[0], b=kids[1]: function(a(env), b(env)))
    kids = [valued(x) for x in node[1:]]
    if kind == "not":
        return lambda env, a=kids[0]: not a(env)
    if kind in ("and", "or"):
        return (lambda env, a=kids[0], b=kids[1]: a(env) and b(env)) if kind == "and" else (lambda env, a=kids[0], b=kids[1]: a(env) or b(env))
    return lambda env, a=kids[0], b=kids[1], f=OPERATIONS[kind]: f(a(env), b(env))


Closure = Callable[[dict, bool], Iterator[tuple[str, bool]]]


def generated(body: list[tuple]) -> Closure:
    """A closure that yields the body's output as ``(text, whether it is generated)``."""
    steps = [step(node) for node in body]

    def run(env: dict, within: bool) -> Iterator[tuple[str, bool]]:
        for f in steps:
            yield from f(env, within)

    return run


def step(node: tuple) -> Closure:
    kind = node[0]
    if kind == "text":

        def run(env, within, text=node[1]):
            yield text, within

    elif kind == "print":

        def run(env, within, value=valued(node[1])):
            yield shown(value(env)), within

    elif kind == "set":

        def run(env, within, name=node[1], value=valued(node[2])):
            env[name] = value(env)
            yield from ()

    elif kind == "generation":

        def run(env, within, inner=generated(node[1])):
            yield from inner(env, True)

    elif kind == "if":
        arms = [(valued(test), generated(inner)) for test, inner in node[1]]

        def run(env, within):
            for test, inner in arms:
                if test(env):
                    yield from inner(env, within)
                    return

    else:

        def run(env, within, name=node[1], values=valued(node[2]), inner=generated(node[3])):
            for k, (value, last) in enumerate(ahead(values(env) or ())):
                env[name], env["loop"] = value, {"index": k + 1, "first": k == 0, "last": last}
                yield from inner(env, within)

    return run


def ahead(values) -> Iterator[tuple[object, bool]]:
    """Each value and whether it is the last; one is read ahead, none is kept."""
    none = object()
    before = none
    for v in values:
        if before is not none:
            yield before, False
        before = v
    if before is not none:
        yield before, True


@lru_cache(maxsize=64)
def _compiled(template: str, constants: tuple) -> Closure:
    tree = parse(template)
    known = {k: list(v) if isinstance(v, tuple) else v for k, v in constants}
    changed = names_set(tree) | {"loop"}
    closure = generated(fold(tree, {k: v for k, v in known.items() if k not in changed}))
    return lambda env, within=False: closure({**known, **env}, within)


def compile_template(template: str, constants: dict | None = None) -> Closure:
    """``closure(env)`` yields ``(text, generated)``; ``env`` has ``turns``, mappings with ``role`` and ``text``."""
    return _compiled(template, tuple(sorted((k, tuple(v) if isinstance(v, list) else v) for k, v in (constants or {}).items())))


def by_conversation(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Rows of sorted batches as ``(first column, its rows)``, one row at a time."""
    rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(columns)), strict=True))
    row = next(rows, None)
    while row is not None:
        key, state = row[0], [row]

        def own(key=key, state=state) -> Iterator[tuple]:
            while state[0] is not None and state[0][0] == key:
                yield state[0]
                state[0] = next(rows, None)

        yield key, own()
        row = state[0]


def format_conversations(rows: DataFrame, template: str = TURNS, constants: dict | None = None, conv: str = "conv_id") -> DataFrame:
    """``conv_id, piece, start, text, spans``: formatted text in pieces, in order; spans are ``[from, to)`` of the conversation."""
    constants = CONSTANTS if constants is None else constants
    compile_template(template, constants)  # a wrong template fails here, not in a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, constants)
        out: list[tuple] = []
        held = 0
        for key, turns in by_conversation((cut for b in batches for cut in (b.slice(lo, 256) for lo in range(0, len(b), 256))), 4):
            piece, start, at, texts, spans = 0, 0, 0, [], []
            for text, within in render({"turns": ({"turn": t, "role": role or "", "text": body or ""} for _, t, role, body in turns)}):
                if within and spans and spans[-1][1] == at:
                    spans[-1] = (spans[-1][0], at + len(text))
                elif within:
                    spans.append((at, at + len(text)))
                texts.append(text)
                at += len(text)
                if at - start >= PIECE:
                    out.append((key, piece, start, "".join(texts), spans))
                    held += at - start
                    piece, start, texts, spans = piece + 1, at, [], []
                    if held >= 8 * PIECE:
                        yield packed(out)
                        out, held = [], 0
            if texts or not piece:
                out.append((key, piece, start, "".join(texts), spans))
                held += at - start
            if held >= 8 * PIECE or len(out) >= 1000:
                yield packed(out)
                out, held = [], 0
        if out:
            yield packed(out)

    def packed(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True))
        spans = pa.array([[{"from": a, "to": b} for a, b in s] for s in cols[4]], pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))
        kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), spans], names=["conv_id", "piece", "start", "text", "spans"])

    turns = rows.select(F.col(conv).alias("conv_id"), "turn", "role", "text")
    id_type = dict(turns.dtypes)["conv_id"]
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, f"conv_id {id_type}, piece long, start long, text string, spans array<struct<from: long, to: long>>")


def read_turns(pieces: Iterator[str]) -> Iterator[tuple[str, str]]:
    """Role and text of each turn, read back from the output of TURNS; a turn is held at a time."""
    rest, end, names = [], CLOSE + "\n", {v: k for k, v in NAMES.items()}
    for piece in pieces:
        rest.append(piece)
        if CLOSE[-1] not in piece and "\n" not in piece:
            continue
        *whole, last = "".join(rest).split(end)
        rest = [last]
        for turn in whole:
            head, between, text = turn.partition(BETWEEN)
            if not head.startswith(OPEN) or not between:
                raise ValueError(f"no turn: {turn[:40]!r}")
            head = head[len(OPEN):]
            yield (unescape(head[1:]) if head.startswith("?") else names[head]), unescape(text)
    if any(rest):
        raise ValueError("a turn is not closed")


def read_back(formatted: DataFrame, in_order: bool = False) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` from formatted pieces alone.

    ``in_order``: pieces stand as ``format_conversations`` left them; otherwise they are dealt and sorted again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, pieces in by_conversation(batches, 5):
            turns, loss, count, chars, length = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

            def texts(pieces=pieces, loss=loss) -> Iterator[str]:
                nonlocal chars, length
                for _, _, start, text, spans in pieces:
                    for s in spans:
                        own = unescape(text[s["from"] - start : s["to"] - start])
                        chars += len(own)
                        loss.update(own.encode())
                    length += len(text)
                    yield text

            for role, text in read_turns(texts()):
                count += 1
                turns.update(f"{role}\n{text}\n".encode())
            yield pa.RecordBatch.from_pylist([{"conv_id": key, "n_turns": count, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": length}], schema=pa.schema([("conv_id", kind), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))

    id_type = dict(formatted.dtypes)["conv_id"]
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type]
    rows = formatted.select("conv_id", "piece", "start", "text", "spans")
    rows = rows if in_order else rows.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return rows.mapInArrow(run, f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The digests straight from the turns, and the length that the template gives them.
SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, k, r, '\### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) x(k, r)
), e as (
  select *, replace(replace(replace(replace(text, '\', '\\'), '### ', '#\## '), ': ', ':\ '), '</turn>', '<\/turn>') as escaped,
    replace(replace(replace(replace(role, '\', '\\'), '### ', '#\## '), ': ', ':\ '), '</turn>', '<\/turn>') as head from t
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(escaped) + 4 + case when role in ('system', 'user', 'assistant') then length(role) else 1 + length(head) end + 2 + 8) as bigint) as formatted_chars
from e group by conv_id
"""
