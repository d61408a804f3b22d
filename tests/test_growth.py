"""Steps whose tasks, shuffles or files once grew faster than their input."""

import glob

import pytest

from eventloom import shared
from eventloom.operators import analytics as A
from eventloom.operators import deltas as D
from eventloom.operators import merge as MG
from eventloom.plans.bridge import order_graph


@pytest.fixture
def tasks_of_100(monkeypatch):
    monkeypatch.setattr(shared, "TASK_ROWS", 100)


def test_rows_a_task_do_not_grow(spark, tasks_of_100):
    for n in (1_000, 5_000):
        df = spark.range(n).selectExpr("id as event_id", "id % 3 as entity_id")
        assert shared.dealt(df, n, "event_id").rdd.getNumPartitions() == n // 100


def test_participation_and_pairs_are_dealt_by_rows(spark, tasks_of_100):
    g = order_graph(spark, "/root/testdata/sf0.001")
    assert g.participated_in.rdd.getNumPartitions() > 50


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_pairs_are_shuffled_once(spark):
    rows = [(e, k) for e in range(40) for k in range(5) if (e * 7 + k) % 3]
    out = A.set_overlaps(spark.createDataFrame(rows, "event_id long, entity_id long"), "entity_id", None)
    assert plan(out).count("Join") == 1  # that of members by key; none of pairs
    sets = {e: {k for x, k in rows if x == e} for e in range(40)}
    want = {(a, b, len(sets[a] & sets[b]), len(sets[a] | sets[b])) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    assert {tuple(r) for r in out.collect()} == want


def test_merges_write_no_similarity_and_only_changes_of_overlaps(spark):
    g = order_graph(spark, "/root/testdata/sf0.001")
    before = len(glob.glob(f"{shared.shared_root(spark)[7:]}/*"))
    state = MG.begin(g, 60)
    base = state.entity.inters.count()
    state = MG.merge(state, spark.createDataFrame([(3, 2)], "id long, canonical long"), "r")
    names = [p.rsplit("/", 1)[-1].split("-")[0] for p in glob.glob(f"{shared.shared_root(spark)[7:]}/*")]
    assert len(names) > before and "similar" not in names
    assert len(state.entity.inters.inputFiles()) and 0 < state.entity.inters.count() - base < base
    again = D.overlaps(D.entity_members(state.graph), "entity_id", 60)
    pairs = lambda s: {tuple(r) for r in D.summed_pairs(s.inters).collect()}
    assert pairs(state.entity) == pairs(again)


def test_large_changes_are_added_in_one_pass(spark, monkeypatch):
    stored = shared.written(spark.createDataFrame([(1, 2, 5), (1, 3, 1), (2, 3, 2)], "a long, b long, n long"))
    change = shared.written(spark.createDataFrame([(1, 3, -1), (2, 3, 4), (7, 8, 1), (8, 9, -1)], "a long, b long, n long"))
    want = {(1, 2, 5), (2, 3, 6), (7, 8, 1)}
    assert {tuple(r) for r in D.added(stored, change, ["a", "b"], "n").collect()} == want
    monkeypatch.setattr(D, "SMALL", 0)
    out = D.added(stored, change, ["a", "b"], "n")
    assert "Join" not in plan(out) and {tuple(r) for r in out.collect()} == want


def test_a_micro_batch_is_not_written_by_one_task(spark, tasks_of_100):
    from eventloom.plans import more_queries

    more_queries.streaming_edges(spark, "/root/testdata/sf0.001").collect()
    newest = max(glob.glob(f"{shared.shared_root(spark)[7:]}/edges-*/in"), key=lambda p: __import__("os").stat(p).st_mtime)
    assert len(glob.glob(f"{newest}/*.parquet")) > 20


def test_ranking_moves_each_row_a_fixed_number_of_times(spark, monkeypatch):
    from eventloom.operators import trees

    monkeypatch.setattr(trees, "WHOLE", 100)
    joined = []
    real = trees.jumped
    monkeypatch.setattr(trees, "jumped", lambda now, *a: joined.append(now.count()) or real(now, *a))
    n = 3_000
    lists = shared.written(spark.range(n).selectExpr("concat('x', id) as e", "case when id % 1000 <> 999 then concat('x', id + 1) end as next", "id", "id as w", "1L as k"))
    out = {r["id"]: (r["next"], r["w"], r["k"]) for r in trees.ranked(lists, ["w", "k"]).collect()}
    end = lambda i: i // 1000 * 1000 + 999
    assert out == {i: (None, sum(range(i, end(i) + 1)), end(i) - i + 1) for i in range(n)}
    assert sum(joined) < 6 * n  # doubling alone: ten times


def test_components_contract(spark, monkeypatch):
    """Chains, a star, a cycle, loops, repeated edges and a random graph against a plain walk; links shrink round by round."""
    import random

    from eventloom.operators import traversal as T

    rng = random.Random(5)
    rows = [(i, i + 1) for i in range(999)] + [(1500 + rng.randrange(400), 1500 + rng.randrange(400)) for _ in range(300)]
    rows += [(2000, i) for i in range(2001, 2300)] + [(3000 + i, 3000 + (i + 1) % 50) for i in range(50)] + [(5000, 5000), (7, 8), (8, 7)]
    written, real = [], T.counted_write
    monkeypatch.setattr(T, "counted_write", lambda df, name, **m: (lambda out: written.append((name, out[1]["n"])) or out)(real(df, name, **m)))
    got = {r["id"]: r["component"] for r in T.components(spark.createDataFrame(rows, "a_id long, b_id long")).collect()}
    least = {x: x for r in rows for x in r if r[0] != r[1]}
    for _ in range(1000):
        before = dict(least)
        for a, b in rows:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
        if least == before:
            break
    assert got == least
    links = [n for name, n in written if name == "links"]
    assert links[-1] == 0 and sum(links) < 2.5 * links[0]  # labels were written and all edges joined again in every round
    assert T.components(spark.createDataFrame([(1, 1)], "a_id long, b_id long")).count() == 0


def test_shortest_paths_do_not_sort_the_edges(spark, monkeypatch):
    from eventloom.operators import traversal as T

    wrote, real = {}, T.written
    monkeypatch.setattr(T, "written", lambda df, name: wrote.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name))
    rows = [("0", str(k)) for k in range(1, 9)] + [(str(k), "20") for k in range(1, 9)] + [(str(k), str(k + 1)) for k in range(30, 90)] * 3
    frame = spark.createDataFrame([(s, "n", d, "n") for s, d in rows], "src string, src_kind string, dst string, dst_kind string")
    out = T.shortest_paths(frame, ("0", "n"), ("20", "n"), 3, 4).collect()
    assert [(r["hops"], r["path"], int(r["ways"])) for r in out] == [(2, f"n:0>n:{k}>n:20", 8) for k in range(1, 5)]
    assert "Exchange" not in wrote["steps"][0] and len(wrote["grew"]) == 2  # edges are gone through once a level


def test_an_export_makes_each_table_once(spark, tmp_path):
    from pyspark.sql import functions as F

    from eventloom.graph import EventGraph
    from eventloom.sources import archive

    made = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def seen(_):
        made.add(1)
        return True

    ids = spark.createDataFrame([(str(k), "d") for k in range(30)], "id string, domain string")
    edges = spark.createDataFrame([(str(k), str(k + 1), k) for k in range(29)], "a_id string, b_id string, event_count long").where(seen.asNondeterministic()("a_id"))
    g = EventGraph(spark, {"entities": ids, "events": ids.limit(0), "entity_connection": edges})
    counts = archive.export(g, "d", f"file://{tmp_path}/a")["row_counts"]
    assert counts == {"entities": 30, "events": 0, "entity_connection": 29} and made.value == 29  # twice: to write and to count
    assert archive.import_archive(EventGraph(spark), f"file://{tmp_path}/a", mode="restore").entity_connection.count() == 29


def test_copies_of_a_name_are_no_pairs(spark):
    """40 copies of each name: rows grow with the copies, not with their square, and classes give all pairs of the whole form."""
    from eventloom.graph import EventGraph
    from eventloom.operators import mutations as M

    names = ["red box", "box red one", "microsoft", "microsft", "other"]
    rows = [(100 * k + c, n, "d", "t", False) for k, n in enumerate(names) for c in range(40)] + [(900, " ", "d", "t", False), (901, None, "d", "t", False)]
    g = EventGraph(spark, {"entities": spark.createDataFrame(rows, "id long, name string, domain string, type string, deprecated boolean")})
    links = [tuple(r) for r in M.fuzzy_links(g).collect()]
    assert len(links) < len(rows) + 10 and len({r[:2] for r in links}) == len(links) and all(a < b for a, b, _ in links)
    of = {b: a for a, b, r in links if r == 1.0 and a % 100 == 0 and a // 100 == b // 100}
    first = lambda i: of.get(i, i)
    between = {(a, b): r for a, b, r in links if a // 100 != b // 100}
    whole = {(a, b): r for a, b, r in M.fuzzy_candidates(g).collect()}
    assert whole == {(a, b): between.get((first(a), first(b)), 1.0) for a in (r[0] for r in rows[:-2]) for b in (r[0] for r in rows[:-2]) if a < b and (first(a) == first(b) or (first(a), first(b)) in between)}
    assert (200, 300) in between


@pytest.mark.parametrize("wide, hub", [(64, 4_000), (3, 4_000), (64, 5), (3, 5), (0, 2)])
def test_pairs_meet_at_their_first_common_key(spark, monkeypatch, wide, hub):
    """Two kinds of keys, hubs, events of many keys and of none: all pairs once, with exact overlaps in either kind."""
    import random

    monkeypatch.setattr(A, "WIDE", wide)
    monkeypatch.setattr(A, "HUB", hub)
    rng = random.Random(2)
    e = {(f"v{i}", rng.randrange(12)) for i in range(40) for _ in range(rng.randrange(6))} | {(f"v{i}", None) for i in range(0, 40, 9)}
    t = {(f"v{i}", f"g{rng.randrange(9)}") for i in range(0, 50, 2) for _ in range(rng.randrange(1, 7))} | {(f"v{i}", "g0") for i in range(20)}
    frame = lambda rows, key, kind: spark.createDataFrame(sorted(rows, key=str) * 2, f"event_id string, {key} {kind}")
    out, found = A.linked_sets({"e": (frame(e, "entity_id", "long"), "entity_id", None), "t": (frame(t, "group_id", "string"), "group_id", None)})
    assert found == ["e", "t"]
    got = sorted(tuple(r[c] for c in ("a", "b", "inter_e", "inter_t")) for r in out.collect())
    of = lambda rows, v: {k for x, k in rows if x == v and k is not None}
    ids = sorted({r[0] for r in e | t})
    assert got == [(a, b, n, m) for a in ids for b in ids if a < b for n, m in [(len(of(e, a) & of(e, b)), len(of(t, a) & of(t, b)))] if n or m]
    one = A.set_overlaps(frame(e, "entity_id", "long"), "entity_id", None).collect()
    size = lambda v: len({r for r in e if r[0] == v})
    assert len(one) == sum(n > 0 for *_, n, _ in got) and all(r["uni"] == size(r["a"]) + size(r["b"]) - r["inter"] for r in one)


def test_pairs_are_not_shuffled_at_all(spark):
    rows = [(e, k) for e in range(40) for k in range(5) if (e * 7 + k) % 3]
    out = A.set_overlaps(spark.createDataFrame(rows, "event_id long, entity_id long"), "entity_id", None)
    assert "Aggregate" not in plan(out)  # pairs were exchanged to be counted


def test_both_channels_leave_no_key_out(spark):
    """Orders whose common parts all have more than 28 orders are linked by them."""
    from pyspark.sql import functions as F

    from eventloom.plans.catalog import QUERIES

    g = order_graph(spark, "/root/testdata/sf0.001")
    stop = [r["id"] for r in g.entities.where("user_tag = 'stopword'").select("id").collect()]
    part = g.participated_in.join(g.live("events").select(F.col("id").alias("event_id")), "event_id").where(~F.col("entity_id").isin(stop))
    often = {r["entity_id"]: sorted(r["e"]) for r in part.groupBy("entity_id").agg(F.collect_set("event_id").alias("e")).where(F.size("e") > 28).collect()}
    want = {(a, b) for e in often.values() for i, a in enumerate(e) for b in e[i + 1 :]}
    got = {(r["a_id"], r["b_id"]) for r in QUERIES["jaccard_both_channels"](spark, "/root/testdata/sf0.001").where("entity_intersection > 0").collect()}
    assert want and want <= got


def test_merges_write_participation_alone(spark, monkeypatch):
    """A graph without a table of pair counts: nothing is paired before it is read, and what is read are the counts of a rebuild."""
    part = [(f"e{k}", f"v{v}") for v in range(30) for k in range(9) if (v * 5 + k * 3) % 4]
    g = MG.EventGraph(spark, {"events": spark.createDataFrame([(f"v{v}", False) for v in range(30)], "id string, deprecated boolean"), "entities": spark.createDataFrame([(f"e{k}", False) for k in range(9)], "id string, deprecated boolean"),
                              "participated_in": spark.createDataFrame(part, "entity_id string, event_id string")})
    wrote, real = [], MG.written
    monkeypatch.setattr(MG, "written", lambda df, name="table": wrote.append(name) or real(df, name))
    monkeypatch.setattr(MG, "UNSUMMED", 3)
    counts = lambda graph: sorted(tuple(r) for r in graph.entity_connection.select("a_id", "b_id", "event_count").collect())
    rebuilt = lambda graph: sorted(tuple(r) for r in A.cooccurrence_edges(graph.participated_in).select("a_id", "b_id", "event_count").collect())
    state = MG.begin(g, None, similarity=False)
    for k, (a, b) in enumerate((("e1", "e0"), ("e2", "e3"), ("e3", "e0"))):
        assert not {"pairs", "connection", "moves"} & set(wrote)  # changes of counts, the counts and the log were written each time
        state = MG.merge(state, spark.createDataFrame([(a, b)], "id string, canonical string"), f"r{k}")
        assert counts(state.graph) == rebuilt(state.graph)
    assert "connection" in wrote  # after so many changes they are summed
    state = MG.unmerge(state, spark.createDataFrame([("e1",), ("e3",)], "id string"))
    state = MG.unmerge(state, spark.createDataFrame([("e2",)], "id string"))
    assert sorted(tuple(r) for r in state.graph.participated_in.select("entity_id", "event_id").collect()) == sorted(part)
    assert counts(state.graph) == rebuilt(g) and state.moves.isEmpty()


def test_events_that_fill_up_or_empty_change_all_their_pairs(spark):
    """From 50 entities on an event counts no pairs: all come when it falls below and go when it rises; of full ones nothing is gathered."""
    from eventloom.operators import deltas

    rows = [(k, 1, True, k < 49) for k in range(60)] + [(k, 2, k < 3, True) for k in range(50)] + [(k, 3, True, k < 70) for k in range(80)] + [(1, 4, True, True), (2, 4, True, True), (3, 4, True, False), (4, 4, False, True), (5, 5, True, True), (6, 5, True, True)]
    got = {(r["a_id"], r["b_id"]): r["n"] for r in deltas.pair_change(spark.createDataFrame(rows, "entity_id long, event_id long, was boolean, now boolean"), len(rows)).groupBy("a_id", "b_id").agg({"event_count": "sum"}).toDF("a_id", "b_id", "n").collect()}
    want = {(a, b): 1 for a in range(49) for b in range(a + 1, 49)}
    for a, b, n in [(0, 1, -1), (0, 2, -1), (1, 2, -1), (1, 3, -1), (2, 3, -1), (1, 4, 1), (2, 4, 1)]:
        want[a, b] = want.get((a, b), 0) + n
    assert {p: n for p, n in got.items() if n} == {p: n for p, n in want.items() if n}


def test_merged_entities_of_many_events_link_them(spark):
    """Orders whose common parts all have more than 60 orders after the merges are linked by them."""
    from eventloom.plans import delta_queries as DQ

    g = DQ.merged(spark, "/root/testdata/sf0.001").graph
    often = {}
    for r in D.entity_members(g).collect():
        often.setdefault(r["entity_id"], set()).add(r["event_id"])
    want = {(a, b) for e in often.values() if len(e) > 60 for a in e for b in e if a < b}
    got = {(r["a_id"], r["b_id"]) for r in DQ.merge_cascade(spark, "/root/testdata/sf0.001").collect()}
    assert want and want <= got


def test_a_piece_of_two_million_edges_is_moved_whole(spark):
    """Such as the parts of sf0.1, by their orders: moved in rounds, they did not settle in minutes."""
    from eventloom.operators import community as C

    base = shared.written(spark.range(1_050_000).selectExpr("pmod(xxhash64(id, 1), 20000) as a_id", "pmod(xxhash64(id, 2), 20000) as b_id", "1.0d as weight").where("a_id <> b_id"))
    both = C.undirected_weights(base, ends=True)
    keys, whole, rounds = C.keyed(both, base)
    assert rounds == 0 and whole == 2 * base.count() > 2_000_000 and keys.where("key is null").isEmpty()


def test_every_region_is_explored(spark):
    """All entities with an edge have a community, not those of one nation alone."""
    from eventloom.operators import traversal as T
    from eventloom.plans.catalog import QUERIES

    edges = T.entity_graph(order_graph(spark, "/root/testdata/sf0.001"))
    want = {r["id"] for r in edges.selectExpr("a_id as id").union(edges.selectExpr("b_id")).distinct().collect()}
    assert {r["id"] for r in QUERIES["scoped_explore"](spark, "/root/testdata/sf0.001").collect()} == want


def wrote_in(spark, monkeypatch, run):
    """Names of what ``MG`` writes while ``run`` takes a small graph with vectors of its events."""
    wrote, real, also = [], MG.written, MG.counted_write
    monkeypatch.setattr(MG, "written", lambda df, name="table": wrote.append(name) or real(df, name))
    monkeypatch.setattr(MG, "counted_write", lambda df, name, **m: wrote.append(name) or also(df, name, **m))
    part = [("a", "1"), ("b", "1"), ("b", "2"), ("c", "2"), ("c", "9")]
    g = MG.EventGraph(spark, {"events": spark.createDataFrame([(k, False) for k in "129"], "id string, deprecated boolean"), "entities": spark.createDataFrame([(k, False) for k in "abc"], "id string, deprecated boolean"), "participated_in": spark.createDataFrame(part, "entity_id string, event_id string")})
    return run(g, spark.createDataFrame([("1", [1.0, 0.0]), ("2", [0.0, 1.0])], "event_id string, embedding array<double>")), wrote


def test_centroids_follow_merges_without_pair_counts(spark, monkeypatch):
    ask = spark.createDataFrame([("b", "a")], "id string, canonical string")
    state, wrote = wrote_in(spark, monkeypatch, lambda g, v: MG.merge(MG.begin(g, None, v, similarity=False), ask, "r", vectors=v))
    assert {r["entity_id"]: (r["n"], r["coherence"]) for r in D.centroids_of(state.centroids, "entity_id").collect()} == {"a": (2, pytest.approx(0.5**0.5)), "c": (1, 1.0)}
    assert not {"pairs", "connection", "events"} & set(wrote)  # pairs of all participation were counted, vectors or not


def test_a_reversal_writes_participation_once(spark, monkeypatch):
    ask = spark.createDataFrame([("b", "a")], "id string, canonical string")

    def run(g, _):
        state = MG.merge(MG.begin(g, None, similarity=False), ask, "r")
        return MG.unmerge(state, ask.select("id"))

    state, wrote = wrote_in(spark, monkeypatch, run)
    assert sorted(tuple(r) for r in state.graph.participated_in.collect()) == [("a", "1"), ("b", "1"), ("b", "2"), ("c", "2"), ("c", "9")]
    assert wrote.count("participation") == 3 and not {"pairs", "connection", "events", "leave", "moves"} & set(wrote)
