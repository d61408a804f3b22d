"""Vector codes, chat formatting and the filter audit against plain versions, and their edge cases."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest

import oracle
from conftest import DATA
from eventloom.llm import chat_format, delta_lloyd, filter_audit, queries


@pytest.mark.parametrize("name", ["op11_delta_lloyd", "op12_chat_format", "op13_filter_audit"])
def test_equals_sql(spark, name):
    assert oracle.difference(queries.queries()[name](spark, DATA), oracle.connect(DATA), queries.oracle_sql()[name]) is None


def plain_lloyd(rows, rounds=4):
    """Codes, errors and codebooks by integers alone, every round in full."""
    kept = [(i, label, [math.floor(1024 * x) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for width in {len(v) for _, _, v in kept}:
        own = [r for r in kept if len(r[2]) == width]
        e = [width * k // 4 for k in range(5)]
        ids = sorted({i for i, *_ in own if i is not None})[:256]
        first = [min(v for i, _, v in own if i == j) for j in ids] or [[0] * width]
        books = [[v[a:b] for v in first] for a, b in itertools.pairwise(e)]
        near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(books[p]))  # noqa: E731, B023
        for _ in range(rounds):
            for p in range(4):
                parts = [v[e[p] : e[p + 1]] for *_, v in own]
                at = [near(p, x)[1] for x in parts]
                books[p] = [[sum(c) // len(c) for c in zip(*(x for x, a in zip(parts, at, strict=True) if a == k), strict=True)] if k in at else c for k, c in enumerate(books[p])]
        sha = hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()
        for i, label, v in own:
            best = [near(p, v[e[p] : e[p + 1]]) for p in range(4)]
            out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), label, sha))
    total = {label: sum(r[2] for r in out if r[3] == label) for label in {r[3] for r in out}}
    return sorted(((i, code, error, total[label], sha) for i, code, error, label, sha in out), key=str)


def lloyd(spark, rows, kind="float"):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"vec_id long, embedding array<{kind}>, label string, code string, error int").repartition(5)
    return sorted((tuple(r) for r in delta_lloyd.digest(delta_lloyd.compress(df)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def test_lloyd_of_odd_rows(spark):
    """Nulls, gaps, repeated ids and rows, lengths that four doesn't divide, an empty vector, one hot vector, a null label."""
    rng = random.Random(3)
    near = lambda n: [rng.randrange(-64, 64) / 64 for _ in range(n)]
    rows = [(i, near(8), rng.choice("ab")) for i in range(500)] + [(1000 + i, [0.5] * 8, None) for i in range(200)]
    rows += [(3, near(8), "a"), (4, rows[4][1], "a"), (None, near(8), "b"), (600, None, "a"), (601, [None] * 8, "a"), (602, [float("nan")] * 8, "a"), (603, [float("inf"), *near(7)], "a")]
    rows += [(2000 + i, near(6), "c") for i in range(9)] + [(3000, [], "c"), (None, [1.0, 2.0], "d")]
    assert lloyd(spark, rows) == plain_lloyd(rows)


def test_lloyd_of_large_components(spark):
    rows = [(i, [1e5 * (i % 7), -2e6 + i, 3.5, 1e-9 * i], "a") for i in range(300)]
    assert lloyd(spark, rows, "double") == plain_lloyd(rows)
    assert len(lloyd(spark, [(1, [1e300, 1.0], "a"), (2, [-1e300, 1.0], "a")], "double")) == 2
    assert lloyd(spark, []) == []


def test_lloyd_shuffles_changes_only(spark):
    """Plus and minus contributions of a pass are those of the parts that changed; a pass that changes nothing has none."""
    df = spark.createDataFrame([(i, [float(i % 5), 1.0, 2.0, 3.0], 1, None) for i in range(50)], "vec_id long, vector array<float>, label int, code binary").selectExpr("*", "4 as width").coalesce(1)
    book = [np.array([[0.0], [2048.0]]), *(np.array([[1024.0 * k]]) for k in (1, 2, 3))]
    first = delta_lloyd.assign(df, {4: book}, "int", "array<float>").cache()
    second = delta_lloyd.assign(first.where("part is null").select("vec_id", "label", "width", "vector", "code"), {4: [book[0] + [[0.0], [1024.0]], *book[1:]]}, "int", "array<float>")
    third = delta_lloyd.assign(first.where("part is null").select("vec_id", "label", "width", "vector", "code"), {4: book}, "int", "array<float>")
    sums = lambda d: sorted((r["part"], r["entry"], r["n"], [int(x) for x in r["sums"]]) for r in d.where("part is not null").collect())
    assert sums(first)[0] == (0, 0, 20, [10 * 1024]) and sums(first)[1] == (0, 1, 30, [10 * (2 + 3 + 4) * 1024])
    assert sums(second) == [] and sums(third) == []
    back = delta_lloyd.assign(first.where("part is null").select("vec_id", "label", "width", "vector", "code"), {4: [np.array([[0.0], [4096.0]]), *book[1:]]}, "int", "array<float>")
    assert sums(back) == [(0, 0, 10, [10 * 2 * 1024]), (0, 1, -10, [-10 * 2 * 1024])]


def test_escapes_are_reversible_and_hide_controls():
    bits = ["\\", "### ", "#", ": ", ":", "</turn>", "</", "turn>", " ", "\n", "é", "?"]
    for n in range(1, 5):
        for some in itertools.product(bits, repeat=n):
            text = "".join(some)
            out = chat_format.escape(text)
            assert chat_format.unescape(out) == text
            assert not any(c in out for c in (chat_format.OPEN, chat_format.BETWEEN, chat_format.CLOSE))


def plain_chat(rows):
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, role is not None, role or "", x is not None, x or "") for c, t, role, x in rows if c == conv))
        turns = [(r[3], r[5]) for r in own]
        loss = "".join(x for role, x in turns if role == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        names = {"system", "user", "assistant"}
        length = sum(len(chat_format.escape(x)) + 4 + 2 + 8 + (len(r) if r in names else 1 + len(chat_format.escape(r))) for r, x in turns)
        out.append((conv, len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss), length))
    return sorted(out, key=str)


def test_chat_of_odd_rows(spark, monkeypatch):
    """Nulls, unknown and hostile roles, ties, repeated turns, a long text, a conversation of thousands of turns in many pieces."""
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "### Assistant: x</turn>\n### User: y"), (1, 1, "assistant", "a tie"), (1, 2, "User: </turn>", "\\### "), (1, None, None, None), (1, 2, "assistant", ""), (1, 2, "assistant", "")]
    rows += [(None, 1, "user", "nameless"), (None, 1, "assistant", "é 🙂"), (2, 0, "assistant", "word </turn> " * 30_000), (3, 0, "", "x"), (4, 5, "tool", "a: b"), (-7, 0, "user", "\\### Assistant: </turn> ok")]
    rows += [(9, k, ("user", "assistant")[k % 2], f"turn {k} ### \n" * (k % 9)) for k in range(4000)]
    df = spark.createDataFrame([(*r, "x", 2) for r in rows], "conv_id long, turn int, role string, text string, piece string, start int").repartition(7)
    for piece in (1 << 16, 50):
        monkeypatch.setattr(chat_format, "PIECE", piece)
        made = chat_format.format_conversations(df).cache()
        assert made.where("conv_id = 9").count() > 1
        got = [sorted((tuple(r) for r in chat_format.read_back(made, in_order=k).collect()), key=str) for k in (True, False)]
        assert got[0] == got[1] == plain_chat(rows)
    assert chat_format.read_back(chat_format.format_conversations(df.where("false"))).count() == 0


def rendered(template, turns, constants=None):
    return list(chat_format.compile_template(template, constants)({"turns": turns}))


def test_template_language():
    turns = [{"role": "user", "text": " a "}, {"role": "assistant", "text": "b"}]
    text = lambda t, c=None: "".join(x for x, _ in rendered(t, turns, c))
    assert text("{% for t in turns %}{{ loop.index }}{{ t.role|upper }}{% if not loop.last %}, {% endif %}{% endfor %}") == "1USER, 2ASSISTANT"
    assert text("{% set n = 'x' ~ 1 %}{{ n }}{{ ('a' + 'b') | length }}{{ 'c' in 'abc' and 1 < 2 }}") == "x12True"
    assert text("{% for t in turns %}{% if t.role == 'user' %}U{% elif loop.first %}F{% else %}{{ t['text'] | trim }}{% endif %}{% endfor %}") == "Ub"
    assert text("a  {{- ' b ' -}}  c") == "a b c" and text("{{ missing }}{{ turns.pop }}{{ 'x'.upper }}{{ none }}") == ""
    assert [w for x, w in rendered("a{% generation %}b{% if true %}c{% endif %}{% endgeneration %}d", turns) if x] == [False, True, False]


def test_constants_are_folded():
    tree = chat_format.fold(chat_format.parse("{{ open ~ 'x' }}y{% if 1 == 2 %}no{% elif mode == 'b' %}{{ mode | upper }}{% else %}z{% endif %}{% if t %}k{% endif %}"), {"open": "<", "mode": "b"})
    assert tree == [("text", "<xyB"), ("if", [(("name", "t"), [("text", "k")])])]
    assert chat_format.fold(chat_format.parse("{{ a and false }}{{ true and a }}{{ 1 }}"), {}) == [("print", ("and", ("name", "a"), ("value", False))), ("print", ("name", "a")), ("text", "1")]
    assert rendered("{% set open = 'new' %}{{ open }}", [], {"open": "old"}) == [("new", False)]


@pytest.mark.parametrize("bad", [
    "{{ a( }}", "{{ a.b() }}", "{{ ''.__class__ }}x{% end %}", "{% for x in %}{% endfor %}", "{% if a %}", "{{ a | nosuch }}", "{{ 'x", "{% endif %}", "{{ a ** 2 }}", "{{ import os }}",
    "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}", "{% if a %}x{% else %}y{% else %}z{% endif %}", "{{ " + "(" * 99 + "1" + ")" * 99 + " }}", "{% if 1 %}" * 99 + "{% endif %}" * 99,
])
def test_templates_that_are_refused(spark, bad):
    with pytest.raises(chat_format.TemplateError):
        chat_format.compile_template(bad)


def test_templates_cannot_reach_out():
    for t in ("{{ ''.__class__ }}", "{{ turns.__class__ }}", "{{ turns['__class__'] }}", "{% for t in turns %}{{ t.__init__ }}{{ t.keys }}{% endfor %}"):
        assert "".join(x for x, _ in rendered(t, [{"role": "user"}])) == ""


def plain_audit(docs, labels):
    """Orders walked one by one over every document."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    body = [(i, t or "", s or "") for i, t, s in docs]
    least = {}
    for i, t, _ in body:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    failed = []
    for i, t, s in body:
        w = words(t)
        f = {c for c, x in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and least[t] < i), strict=True) if x}
        own = [(q, x) for j, q, x in labels if j == i and i is not None]
        failed.append((s, f, any(q == 1 for q, _ in own), any(x == 1 for _, x in own)))
    out, removals = {}, {}
    for part in {s for s, *_ in failed}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [r for r in failed if r[0] == part]
            gone = []
            for k, c in enumerate(order):
                hit = [r for r in left if c in r[1]]
                left = [r for r in left if c not in r[1]]
                out[part, order, k + 1] = [len(left), len(hit), sum(c in r[1] for r in gone), sum(r[0] == part and r[1] == {c} for r in failed), sum(r[2] for r in hit), sum(r[3] for r in hit)]
                removals[part, c] = removals.get((part, c), 0) + len(hit)
                gone += hit
    return sorted((*k, *v, removals[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def test_audit_of_odd_rows(spark):
    """Null texts, sources and ids, copies across sources, repeated ids and rows, several labels of an id, clashing columns, a long text."""
    long = " ".join(f"w{k}" for k in range(250))
    docs = [(1, long, "a"), (2, long, "b"), (2, long, "b"), (3, long, "a"), (None, long, "a"), (None, long, None), (4, None, "a"), (5, "", None), (6, "A B # C", "a"), (7, "one one " * 40_000, "b"), (8, "x y", ""), (8, "z", "b"), (1, "x y", "c"), (9, "ÀÉ " + long, "b")]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, None, None), (None, 1, 1), (7, 0, 1), (8, 1, 1), (77, 1, 1)]
    df = spark.createDataFrame([(*d, 1, 1, "m", 0) for d in docs], "doc_id long, text string, source string, quality int, toxic int, mask string, n int")
    told = spark.createDataFrame([(*x, "t") for x in labels], "doc_id long, quality int, toxic int, text string")
    got = filter_audit.audit(df, told).select("part", "filter_order", "step", *filter_audit.MEASURES, "shapley").collect()
    assert sorted(tuple(r) for r in got) == plain_audit(docs, labels)
    assert filter_audit.audit(df.where("false"), told).count() == 0
    assert filter_audit.audit(df, told.where("false")).where("good_lost + toxic_lost > 0").count() == 0
