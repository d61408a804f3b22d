"""The persisted vector index against brute force: exact stopping, probes, inserts, removals, ties, hot units."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.operators import vector_index as vi


def clustered(n, width=16, clusters=12, spread=0.15, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, width))
    return (centres[rng.integers(clusters, size=n)] + spread * rng.standard_normal((n, width))).astype(np.float32)


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(c) for c in v], "x") for i, v in enumerate(x)], "id long, embedding array<float>, cell string")


def plain(rows, q, k):
    q = np.asarray(q, float)
    unit = lambda v: v / (np.linalg.norm(v) or 1)
    s = [(-float(unit(np.asarray(v, float)) @ unit(q)), i) for i, v in rows]
    return [(i, -x) for x, i in sorted(s, key=lambda r: (round(r[0], 9), r[1]))[:k]]


def same(got, want):
    assert [i for i, _ in got] == [i for i, _ in want]
    assert np.allclose([s for _, s in got], [s for _, s in want], atol=1e-9)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    x = clustered(3000)
    return x, vi.build(frame(spark, x), f"file://{tmp_path_factory.mktemp('index')}/i", cells=24, sample=1000)


def test_one_query_stops_early_and_is_exact(made):
    x, index = made
    for k, at in ((10, 5), (1, 700), (40, 1999)):
        found, read = vi.search(index, x[at], k)
        same([tuple(r) for r in found.collect()], plain(list(enumerate(x)), x[at], k))
        assert read["units_read"] < 0.6 * read["units"]
    none, read = vi.search(index, x[0][:5])
    assert none.count() == 0 and read["units_read"] == 0


def test_a_query_block_is_exact_and_probes_reach_their_recall(spark, made):
    x, index = made
    asked = frame(spark, x[::40]).selectExpr("id as query_id", "embedding as q")
    got = {}
    for r in vi.search_many(index, asked, 10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    assert len(got) == 75
    for j, v in enumerate(x[::40]):
        same(got[j], plain(list(enumerate(x)), v, 10))
    n = vi.probes_for(index, 0.95)
    assert n < 0.5 * index.units().count()
    few = vi.search_many(index, asked, 10, probes=n)
    hits = {(q, i) for q, rows in got.items() for i, _ in rows} & {(r["query_id"], r["id"]) for r in few.collect()}
    assert len(hits) >= 0.95 * 750


def test_inserts_removals_and_replacements(spark, tmp_path):
    x = clustered(900, seed=8)
    index = vi.build(frame(spark, x[:500]), f"file://{tmp_path}/i", cells=9, sample=400)
    far = (10 * np.random.default_rng(1).standard_normal((50, 16))).astype(np.float32)  # outside all clusters: radii grow
    vi.insert(index, frame(spark, np.concatenate([x[500:], far]), 500))
    index = vi.load(spark, index.path)
    rows = dict(enumerate(np.concatenate([x, far])))
    same([tuple(r) for r in vi.search(index, far[3], 5)[0].collect()], plain(rows.items(), far[3], 5))
    vi.remove(index, spark.createDataFrame([(903,), (7,), (12345,)], "id long"))
    vi.insert(index, frame(spark, x[:2] * -1, 20))  # 20 and 21 get other vectors
    vi.insert(index, frame(spark, x[7:8], 7))
    del rows[903]
    rows[20], rows[21] = -x[0], -x[1]
    for q in (far[3], x[20], -x[0], x[7]):
        same([tuple(r) for r in vi.search(index, q, 8)[0].collect()], plain(rows.items(), q, 8))
    assert index.rows().count() == len(rows)


def test_odd_rows_ties_and_hot_units(spark, tmp_path, monkeypatch):
    """Copies by the thousand in one unit, zero vectors, vectors that cannot be compared, string ids, an empty table."""
    monkeypatch.setattr(vi, "BLOCK", 100)
    rows = [(f"c{i:04}", [1.0, 2.0, 3.0]) for i in range(1500)] + [(f"r{i}", [float(i % 7), 1.0, -float(i % 5)]) for i in range(60)] + [("z1", [0.0] * 3), ("z2", [0.0] * 3)]
    odd = [("n", None), ("e", []), ("s", [1.0]), ("g", [1.0, None, 2.0]), ("f", [1.0, float("nan"), 0.0]), ("i", [float("inf"), 0.0, 0.0])]
    index = vi.build(spark.createDataFrame(rows + odd, "id string, embedding array<float>"), f"file://{tmp_path}/i", cells=4)
    log = spark.read.parquet(f"{index.path}/log").where("batch = 1").first()
    assert (log["indexed"], log["skipped"]) == (len(rows), len(odd))
    for q in ([1.0, 2.0, 3.0], [0.0, 0.0, 0.0], [-1.0, 0.0, 1.0]):
        same([tuple(r) for r in vi.search(index, q, 12)[0].collect()], plain(rows, q, 12))
    many = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [-1.0, 0.0, 1.0]), (3, None), (4, [1.0])], "query_id int, q array<double>")
    got = vi.search_many(index, many, 12, first=1).orderBy("query_id", "rank").collect()
    assert {r["query_id"] for r in got} == {1, 2}
    same([(r["id"], r["score"]) for r in got[:12]], plain(rows, [1.0, 2.0, 3.0], 12))
    same([(r["id"], r["score"]) for r in got[12:]], plain(rows, [-1.0, 0.0, 1.0], 12))
    none = vi.build(spark.createDataFrame([], "id long, embedding array<float>"), f"file://{tmp_path}/none")
    assert vi.search_many(none, many, 3).count() == 0 and none.rows().count() == 0


def test_work_is_dealt_in_bounded_blocks(spark, made, monkeypatch):
    x, index = made
    monkeypatch.setattr(vi, "QUERY_BLOCK", 4)
    asked = frame(spark, np.repeat(x[:2], 30, axis=0)).selectExpr("id as query_id", "embedding as q")
    got = vi.search_many(index, asked, 3).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("a")).collect()
    assert len(got) == 60
    for r in got:
        assert [a["id"] for a in r["a"]] == [i for i, _ in plain(list(enumerate(x)), x[r["query_id"] // 30], 3)]
