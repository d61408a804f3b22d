"""Small cases with results worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from eventloom.functions import codec, text
from eventloom.functions import vectors as vec
from eventloom.graph import EventGraph
from eventloom.operators import analytics as A
from eventloom.operators import community as C
from eventloom.operators import lookup as L
from eventloom.operators import mutations as M
from eventloom.operators import traversal as T
from eventloom.operators import vector_search as V
from eventloom.plans import sql_guard


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def graph(spark, part=(), member=(), events=None):
    ids = events or sorted({e for _, e in part} | {e for e, _ in member})
    return EventGraph(spark, {
        "events": frame(spark, [(i, "d", False) for i in ids], "id string, domain string, deprecated boolean"),
        "entities": frame(spark, [(i, None, False, "d") for i in sorted({x for x, _ in part})], "id string, user_tag string, deprecated boolean, domain string"),
        "participated_in": frame(spark, list(part), "entity_id string, event_id string"),
        "event_member_of": frame(spark, [(*m, "contains") for m in member], "event_id string, group_id string, kind string"),
    })


def test_jaccard(spark):
    g = graph(spark, [(x, "e1") for x in "ABC"] + [(x, "e2") for x in "BCD"] + [("X", "e3")])
    assert [(r["a_id"], r["b_id"], r["entity_jaccard"], r["entity_intersection"]) for r in A.jaccard_edges(g).collect()] == [("e1", "e2", 0.5, 2)]


def test_group_trigger(spark):
    two = graph(spark, member=[("e1", "g1"), ("e1", "g2"), ("e2", "g1"), ("e2", "g2"), ("e2", "g3")])
    row = A.jaccard_edges(two).first()
    assert row["entity_jaccard"] == 0 and abs(row["group_jaccard"] - 2 / 3) < 1e-9
    assert A.jaccard_edges(graph(spark, member=[("e1", "g1"), ("e1", "g2"), ("e2", "g1"), ("e2", "g3")])).isEmpty()


def test_degree_cap(spark):
    g = graph(spark, [("hub", f"e{k}") for k in (1, 2, 3)] + [("A", "e1"), ("A", "e2"), ("B", "e1")])
    row = A.jaccard_edges(g, entity_cap=2).collect()
    assert [(r["a_id"], r["b_id"], r["entity_jaccard"]) for r in row] == [("e1", "e2", 0.5)]


def test_entity_weight(spark):
    g = graph(spark, [("a", e) for e in "123"] + [("b", e) for e in "1245"]).with_tables(entity_connection=frame(spark, [("a", "b", 2)], "a_id string, b_id string, event_count long"))
    assert T.entity_graph(g).first()["weight"] == pytest.approx(0.4)


def test_centroid(spark):
    rows = frame(spark, [("x", [1.0, 0.0]), ("x", [0.0, 1.0]), ("y", [1.0, 0.0]), ("y", [-1.0, 0.0])], "k string, embedding array<float>")
    (r,) = A.centroids(rows, "k").collect()
    assert r["k"] == "x" and r["coherence"] == pytest.approx(math.sqrt(0.5)) and r["centroid"] == pytest.approx([math.sqrt(0.5)] * 2)


def test_mutual_information(spark):
    same = C.mutual_information(frame(spark, [(1, "a", 2), (2, "b", 2)], "community int, group_id string, n long")).first()
    assert (same["nmi"], same["residual"], same["h_c_given_t"]) == (1, 0, 0)
    none = C.mutual_information(frame(spark, [(1, "a", 1), (1, "b", 1), (2, "a", 1), (2, "b", 1)], "community int, group_id string, n long")).first()
    assert (none["nmi"], none["residual"], none["h_c_given_t"]) == (0, 1, 0.6931)


def test_k_hop(spark):
    e = frame(spark, [("a", "b"), ("b", "c"), ("c", "d")], "a_id string, b_id string")
    assert sorted((r["id"], r["depth"]) for r in T.k_hop(e, frame(spark, [("a",)], "id string"), 2).collect()) == [("b", 1), ("c", 2)]


def test_tag_cycle(spark):
    g = frame(spark, [("r", None, "d"), ("c", "r", "d"), ("x", "y", "d"), ("y", "x", "d"), ("o", "r", "other")], "id string, parent_id string, domain string")
    with pytest.raises(ValueError):
        T.check_reparent(g, "r", "c")
    assert {r["id"]: r["level"] for r in T.tree_levels(g).collect()} == {"r": 0, "c": 1, "x": 0, "y": 0, "o": 0}


def test_scope(spark):
    e = frame(spark, [(1, "a"), (2, "b")], "id int, domain string")
    assert L.scope(e, None).count() == 2 and L.scope(e, []).count() == 0 and L.scope(e, [("b", None)]).count() == 1


@pytest.mark.parametrize("tail, more", [(0.41, True), (0.39, False)])
def test_more_available(spark, tail, more):
    rows = frame(spark, [(1, [0.5, math.sqrt(0.75)]), (2, [tail, math.sqrt(1 - tail**2)])], "id int, embedding array<double>")
    assert V.hybrid(rows, rows, [1.0, 0.0], 1, "events").first()["more_available"] is more


def test_segment_keys(spark):
    rows = frame(spark, [("f", i, h) for i, h in enumerate("AABA")], "file_path string, segment_index int, heading string").withColumns({"slide": F.lit(None).cast("int"), "page": F.lit(None).cast("int")})
    assert [r["segment_key"] for r in A.segment_keys(rows).orderBy("segment_index").collect()] == ["A", "A#1", "B", "A#2"]


def test_sql_guard(spark):
    for bad in ("SELECT 1; DROP TABLE x", "DELETE FROM t", "", "WITH t AS (SELECT 1) INSERT INTO x SELECT * FROM t"):
        with pytest.raises(ValueError):
            sql_guard.check(bad)
    assert sql_guard.query(spark, "WITH t AS (SELECT 1 AS a) SELECT a, ';drop' AS b FROM t -- ; drop").first()["b"] == ";drop"


def test_codecs(spark):
    tokens = frame(spark, [("0",), ("T",), ("false",), (None,)], "t string")
    assert [r[0] for r in tokens.select(codec.decode_bool(F.col("t"))).collect()] == [False, True, False, None]
    with pytest.raises(Exception, match="not a boolean"):
        tokens.select(codec.decode_bool(F.lit("maybe"))).collect()
    assert bytes(tokens.select(codec.decode_bytes(F.lit("base64:aGk="))).first()[0]) == b"hi"


def test_timestamps(spark):
    given = {"2026-04-17-142233": "2026-04-17T14:22:33", "20260417_142233": "2026-04-17T14:22:33", "2026/04/17": "2026-04-17", "2026": None, "null": None, "2026-02-31": None, "2026-04-17T10:00:00Z": "2026-04-17T10:00:00+00:00", "soon": None}
    df = frame(spark, [(k,) for k in given], "t string").select("t", text.normalise_timestamp(F.col("t")).alias("n"))
    assert {r["t"]: r["n"] for r in df.collect()} == given


def test_paths_and_chains(spark):
    e = frame(spark, [("a", "b"), ("b", "c")], "entity_id_a string, entity_id_b string")
    assert {r["id"]: r["canonical"] for r in T.resolve_aliases(e).collect()} == {"a": "c", "b": "c"}
    row = frame(spark, [("d::path/a/b/c.py",)], "p string").select(text.path_ancestors(F.col("p"))).first()[0]
    assert row == ["d::path/a/", "d::path/a/b/", "d::path/a/b/c.py"]
    assert frame(spark, [("./.github/x",)], "p string").select(text.path_id(F.col("p"), "/r", "D")).first()[0] == "d::path/.github/x"


def test_merge(spark):
    g = graph(spark, [("a", "1"), ("b", "1"), ("c", "2"), ("a", "2")]).with_tables(entity_connection=frame(spark, [("a", "b", 1), ("a", "c", 2), ("b", "c", 3)], "a_id string, b_id string, event_count long"))
    out = M.merge_entities(g, frame(spark, [("b", "a")], "id string, canonical string"))
    assert [(r["a_id"], r["b_id"], r["event_count"]) for r in out.entity_connection.collect()] == [("a", "c", 5)]
    assert out.participated_in.count() == 3 and out.entities.where("deprecated").first()["id"] == "b"


def test_as_of(spark):
    left = frame(spark, [(1, "k", 5), (2, "k", 1), (3, "m", 9)], "id int, k string, t int")
    right = frame(spark, [("k", 2, 0.2), ("k", 5, 0.5), ("k", 7, 0.7)], "k string, f int, price double")
    assert {r["id"]: r["price"] for r in L.as_of_join(left, right, ["k"], "t", "f", "price", "id").collect()} == {1: 0.5, 2: None, 3: None}


def test_cosine(spark):
    df = frame(spark, [([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<float>, b array<float>, c array<float>")
    row = df.select(vec.cosine(F.col("a"), F.col("b")).alias("x"), vec.cosine(F.col("a"), F.col("c")).alias("y"), vec.normalise(F.col("c")).alias("n")).first()
    assert row["x"] == pytest.approx(0.96) and row["y"] == 0 and row["n"] == [0, 0]


def test_fuzzy_candidates_are_whole(spark, monkeypatch):
    """Variants without a common word, words in more than 200 names, other orders, and all pairs against brute force."""
    import random
    from difflib import SequenceMatcher

    monkeypatch.setattr(M, "CELL", 40)
    rng = random.Random(4)
    names = ["microsoft", "microsft", "Alpha Beta", "beta  alpha", "alpha", None, " ", "x"]
    names += ["red box " + "".join(rng.choice("abcdefgh") for _ in range(rng.choice([4, 12, 30]))) for _ in range(205)] + ["red box", "box red"]
    kinds = [(k % 2 if k > 100 else 0) for k in range(len(names))]
    rows = [(k, n, None if kinds[k] else "d", "t", False) for k, n in enumerate(names)] + [(999, "microsoft", "d", "t", True)]
    g = EventGraph(spark, {"entities": frame(spark, rows, "id long, name string, domain string, type string, deprecated boolean")})

    def ratio(p, q):
        p, q = set((p or "").lower().split()), set((q or "").lower().split())
        if not p or not q:
            return 0
        both = " ".join(sorted(p & q))
        u, v = (" ".join(filter(None, [both, " ".join(sorted(z))])) for z in (p - q, q - p))
        return max(SequenceMatcher(None, x, y, False).ratio() for x, y in [(u, v)] + ([(both, u), (both, v)] if both else []))

    got = [(r["a"], r["b"]) for r in M.fuzzy_candidates(g).collect()]
    want = {(a, b): r for b in range(len(names)) for a in range(b) if kinds[a] == kinds[b] and (r := max(ratio(names[a], names[b]), ratio(names[b], names[a]))) >= 0.85}
    sure = {p for p in want if min(ratio(*(names[k] for k in p)), ratio(*(names[k] for k in p[::-1]))) >= 0.85}
    assert len(got) == len(set(got)) and sure <= set(got) <= set(want) and {(0, 1), (2, 3), (2, 4)} <= sure


def test_edit_event_changes_pair_counts_as_a_rebuild_would(spark):
    from eventloom.graph import EventGraph
    from eventloom.operators import mutations as M
    from eventloom.operators.analytics import cooccurrence_edges

    part = spark.createDataFrame([(e, v) for v, es in {1: [1, 2, 3], 2: [1, 2], 3: [2, 3, 4], 4: [4]}.items() for e in es], "entity_id long, event_id long")
    entities = spark.createDataFrame([(i, False) for i in range(1, 7)], "id long, deprecated boolean")
    g = EventGraph(spark, {"participated_in": part, "entities": entities, "entity_connection": cooccurrence_edges(part)})
    for remove, add in (([2], [5]), ([1, 2, 3], None), (None, [4, 5, 6]), ([2, 3], [4])):
        out = M.edit_event(g, 1, remove=remove, add=add)
        pairs = lambda df: sorted(tuple(r) for r in df.select("a_id", "b_id", "event_count").collect())
        assert pairs(out.entity_connection) == pairs(cooccurrence_edges(out.participated_in))


def test_grounding_tokens_cut_camel_case(spark):
    from pyspark.sql import functions as F

    from eventloom.functions import text

    cases = {"PoolManager": ["pool", "manager"], "HTTPServer2x": ["http", "server2x"], "snake_case-x": ["snake", "case", "x"], "ABC": ["abc"], "Überfahrt ÉtaT": ["überfahrt", "état"], "A1bC": ["a1b", "c"], "": []}
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", text.grounding_tokens(F.col("s")).alias("t"))
    assert {r["s"]: r["t"] for r in df.collect()} == cases
    assert spark.range(1).select(text.grounding_score(F.lit("PoolManager"), F.lit("the pool manager")).alias("x")).first()[0] == 1.0
