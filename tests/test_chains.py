"""Chains against plain walks: splices of runs, forks and circles, stages in order, templates; shortest paths against enumeration."""

import random

import pytest
from pyspark.sql import functions as F

from eventloom.graph import EventGraph
from eventloom.operators import chains as H
from eventloom.operators import traversal as T


def spliced(edges, gone):
    """From each survivor walk on through removed nodes only."""
    after = {}
    for s, d, o in edges:
        after.setdefault(s, []).append((d, o))
    out = {}
    for s in after:
        if s in gone:
            continue
        for d, o in after[s]:
            todo, seen = [d], set()
            while todo:
                x = todo.pop()
                if x in seen:
                    continue
                seen.add(x)
                if x in gone:
                    todo += [y for y, _ in after.get(x, [])]
                elif x != s:
                    out[s, x] = min(out.get((s, x), o), o)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_splice_equals_a_walk(spark, seed):
    rng = random.Random(seed)
    edges = {(i, i + 1): i for i in range(60)}  # a chain with long runs to take out
    edges |= {(rng.randrange(100, 140), rng.randrange(100, 140)): rng.randrange(9) for _ in range(60)}  # forks and circles
    gone = {*range(5, 50), 59, 60, *(i for i in range(100, 140) if rng.random() < 0.6), 999}
    rows = [(s, d, o) for (s, d), o in edges.items()]
    frame = spark.createDataFrame([*rows, (None, 1, 0), (1, None, 0)], "src long, dst long, order_index long").repartition(3)
    got = {(r["src"], r["dst"]): r["order_index"] for r in H.splice(frame, spark.createDataFrame([(i,) for i in gone], "id long")).collect()}
    assert got == spliced(rows, gone)


def test_splice_of_thousands_and_of_none(spark):
    line = spark.range(5000).selectExpr("id as src", "id + 1 as dst", "id as order_index")
    assert [tuple(r) for r in H.splice(line, spark.range(1, 5000)).collect()] == [(0, 5000, 0)]
    assert H.splice(line, spark.range(0)).count() == 5000 and H.splice(line.limit(0), spark.range(9)).count() == 0
    ring = spark.createDataFrame([(1, 2, 0), (2, 3, 0), (3, 2, 0)], "src long, dst long, order_index long")
    assert H.splice(ring, spark.createDataFrame([(2,), (3,)], "id long")).count() == 0


def plans(spark):
    nodes = [("a", "p", None, 0, None), ("b", "p", "a", 1, "t"), ("c", "p", "b", 2, "t"), ("d", "p", "c", None, "u"), ("x", "q", None, 0, None)]
    g = H.put_nodes(EventGraph(spark), H.PLAN, spark.createDataFrame(nodes, "id string, plan_id string, parent_id string, order_index long, etg_id string").withColumns({"domain": F.lit("m"), "stage": F.lit("draft")}))
    g = H.put_nodes(g, H.TEMPLATE, spark.createDataFrame([("t", "m", 0.5), ("u", "m", 0.9)], "id string, domain string, confidence double"))
    return H.link_next(g, H.PLAN, spark.createDataFrame([("a", "b", 0), ("b", "c", 1), ("c", "d", 2)], "source_id string, target_id string, order_index long"))


def test_remove_nodes(spark):
    g = H.link_from(plans(spark), H.PLAN, spark.createDataFrame([("e1", "b"), ("e2", "d")], "event_id string, id string"))
    g = H.link_next(g, H.DIRECTION, spark.createDataFrame([("b", "c")], "source_id string, target_id string"))  # same ids, another kind
    out = H.remove_nodes(g, H.PLAN, spark.createDataFrame([("b",), ("nobody",)], "id string"))
    assert {tuple(r) for r in out.context_edges.collect()} == {("a", "PLN", "c", "PLN", "plan_next", 0), ("c", "PLN", "d", "PLN", "plan_next", 2), ("b", "DIR", "c", "DIR", "plan_next", None), ("e2", "EVT", "d", "PLN", "plan_from", None)}
    assert {(r["id"], r["parent_id"]) for r in out.plan_nodes.collect()} == {("a", None), ("c", None), ("d", "c"), ("x", None)}
    assert [r["id"] for r in H.of_plan(out, H.PLAN, "p").collect()] == ["d", "a", "c"]
    assert {r["id"]: (r["root"], r["level"]) for r in H.plan_tree(out, "p").collect()} == {"a": ("a", 0), "c": ("c", 0), "d": ("c", 1)}
    bare = H.remove_nodes(out, H.TEMPLATE, spark.createDataFrame([("t",)], "id string"))
    assert {(r["id"], r["etg_id"]) for r in bare.plan_nodes.collect()} == {("a", None), ("c", None), ("d", "u"), ("x", None)}
    assert [r["id"] for r in H.templates(g, "m").collect()] == ["u", "t"]
    context = H.remove_nodes(H.link_next(EventGraph(spark), H.CONTEXT, spark.createDataFrame([("g", "h"), ("h", "i")], "source_id string, target_id string")), H.CONTEXT, spark.createDataFrame([("h",)], "id string"))
    assert [tuple(r)[:5] for r in context.context_edges.collect()] == [("g", "CG ", "i", "CG ", "plan_next")]


def test_places_of_all_chains(spark):
    g = H.link_next(plans(spark), H.PLAN, spark.createDataFrame([("x", "y")], "source_id string, target_id string"))
    assert {r["id"]: (r["head"], r["place"]) for r in H.chains(g, H.PLAN).collect()} == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 2), "d": ("a", 3), "x": ("x", 0)}


def test_stages_are_settled_in_order(spark):
    rows = [("a", 2, "abandoned", None, "late"), ("a", 1, "realized", "e1", None), ("a", 3, None, "", None), ("b", 1, "active", "e2", None), ("b", 1, "draft", "e3", None), ("zz", 1, "active", "e9", None), (None, 1, "active", "e9", None)]
    changes = spark.createDataFrame(rows, "id string, seq int, stage string, realized_event_id string, abandon_reason string")
    g = H.settle(plans(spark), H.PLAN, changes)
    got = {r["id"]: (r["stage"], r["realized_event_id"], r["abandon_reason"]) for r in g.plan_nodes.collect()}
    assert got == {"a": ("abandoned", "", "late"), "b": ("draft", "e3", None), "c": ("draft", None, None), "d": ("draft", None, None), "x": ("draft", None, None)}
    assert {(r[0], r[2]) for r in g.context_edges.where("rel = 'realized_as'").collect()} == {("a", "e1"), ("b", "e2"), ("b", "e3"), ("zz", "e9")}
    assert {(r["plan_id"], r["node_count"]) for r in H.active_plans(g, "m").collect()} == {("p", 3), ("q", 1)}
    groups = spark.createDataFrame([("k", "m", "plan", 0, None), ("l", "m", "plan", 1, None), ("n", "m", "template", 0, 3)], "id string, domain string, cluster_source string, order_index long, instance_count long")
    c = H.settle(H.put_nodes(EventGraph(spark), H.CONTEXT, groups), H.CONTEXT, spark.createDataFrame([("l", "abandoned", "no time")], "id string, stage string, abandon_reason string"))
    assert [r["id"] for r in H.plan_seeds(c, "m").collect()] == ["k"] and [(r["id"], r["abandon_reason"]) for r in H.abandoned_plans(c, "m").collect()] == [("l", "no time")]
    assert [r["id"] for r in H.template_contexts(c, "m").collect()] == ["n"]


def shortest(edges, a, b, most):
    walks = [[a]]
    for hops in range(most + 1):
        hit = sorted(w for w in walks if w[-1] == b)
        if hit:
            return hops, hit
        walks = [w + [d] for w in walks for s, d in edges if s == w[-1]]
    return None, []


@pytest.mark.parametrize("seed", range(2))
def test_shortest_paths_equal_enumeration(spark, seed):
    rng = random.Random(seed)
    edges = sorted({(f"n:{rng.randrange(14)}", f"n:{rng.randrange(14)}") for _ in range(34)} | {("n:0", f"n:{k}") for k in range(20, 40)} | {(f"n:{k}", "n:3") for k in range(20, 40)})
    frame = spark.createDataFrame([(s[2:], "n", d[2:], "n") for s, d in edges], "src string, src_kind string, dst string, dst_kind string").repartition(3)
    for a, b, most in ((0, 3, 3), (0, rng.randrange(14), 3), (rng.randrange(14), rng.randrange(14), 5)):
        hops, paths = shortest([e for e in edges if e[0] != e[1]], f"n:{a}", f"n:{b}", most)
        got = T.shortest_paths(frame, (a, "n"), (b, "n"), most, 4).collect()
        assert [(r["hops"], r["path"], int(r["ways"])) for r in got] == [(hops, ">".join(p), len(paths)) for p in paths[:4]], (a, b)
    assert T.shortest_paths(frame, (0, "n"), (99, "n")).count() == 0
    assert [tuple(r)[:2] for r in T.shortest_paths(frame, (5, "n"), (5, "n")).collect()] == [(0, "n:5")]
