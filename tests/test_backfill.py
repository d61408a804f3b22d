"""Backfill that survives bad rows, and that rows of a hub are cut before they meet."""

import re

import pytest
from pyspark.sql import functions as F

from eventloom.operators import backfill as B


def embedder():
    """A function made here travels to the workers, which cannot import this file."""

    def embed(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("cannot embed")
        return [None if t == "none" else [1.0] if t == "short" else [float(len(t)), 1.0] for t in texts]

    return embed


embed = embedder()


def test_a_failing_batch_costs_its_bad_rows_only(spark):
    rows = [(i, f"text {i}", None) for i in range(200)] + [(300, "bad one", None), (301, "none", None), (302, "short", None), (303, "  ", None), (304, None, None), (305, "bad but has one", [9.0, 9.0]), (306, "kept", [2.0, 2.0]), (None, "bad", None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, summary string, embedding array<float>, error string").coalesce(1)
    out, failed = B.backfill(df, embed, F.col("summary"), width=2, batch=50)
    got = {r["id"]: r["embedding"] for r in out.collect()}
    assert out.columns == df.columns and out.count() == len(rows)
    assert all(got[i] == [float(len(f"text {i}")), 1.0] for i in range(200)) and got[305] == [9.0, 9.0] and got[306] == [2.0, 2.0]
    assert all(got[i] is None for i in (300, 301, 302, 303, 304, None))
    assert {r["id"]: r["error"] for r in failed.collect()} == {300: "RuntimeError: cannot embed", 301: "no vector", 302: "length 1 and not 2"}
    again, still = B.backfill(out, lambda t: [[0.0, 0.0]] * len(t), F.col("summary"))  # later, when the service is well
    assert still.count() == 0 and again.where("embedding is null and trim(summary) <> '' and id is not null").count() == 0
    none, nobody = B.backfill(df.where("false"), embed, F.col("summary"))
    assert none.count() == nobody.count() == 0


def test_bad_rows_are_found_by_halving():
    calls = []

    def one(texts):
        calls.append(len(texts))
        return embed(texts)

    done = B.isolated([f"t{i}" for i in range(63)] + ["bad"], one, 2, tries=3)
    assert sum(e is None for _, e in done) == 63 and len(calls) == 2 * 6 + 3  # two halves a level, and three tries
    with_flaw = iter([RuntimeError("busy"), None])

    def flaky(texts):
        if (e := next(with_flaw)) is not None:
            raise e
        return [[1.0, 2.0]]

    assert B.isolated(["x"], flaky, 2, tries=2) == [([1.0, 2.0], None)]
    assert B.isolated(["x", "y"], lambda t: [], None, 1)[0][1].startswith("ValueError")


@pytest.mark.parametrize("name", ["members", "samples", "neighbours", "knn_many"])
def test_no_hub_is_sorted_whole(spark, name):
    """Each task keeps the first k of a key before the exchange, so what meets of a hub is at most k rows a task."""
    from eventloom.graph import EventGraph
    from eventloom.operators import community, traversal, vector_search

    label = spark.createDataFrame([(i, i % 2) for i in range(20)], "id long, community long")
    events = spark.createDataFrame([(i, "s", None, None) for i in range(20)], "id long, summary string, timestamp string, created_at timestamp_ntz")
    g = EventGraph(spark, {"participated_in": spark.createDataFrame([(i, i) for i in range(20)], "entity_id long, event_id long")})
    edges = spark.createDataFrame([("a", "x", f"b{i}", "x", "r", "out") for i in range(20)], "src string, src_kind string, dst string, dst_kind string, rel string, direction string")
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(20)], "id long, embedding array<float>")
    df = {
        "members": lambda: community.members(label, g), "samples": lambda: community.samples(label, events), "neighbours": lambda: traversal.neighbours(edges, "a", "x", per_hop=3),
        "knn_many": lambda: vector_search.knn_many(vectors, vectors.selectExpr("id as query_id", "embedding as q"), 3),
    }[name]()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"WindowGroupLimit \[[^\]]*\], [^\n]*Partial", plan), plan
