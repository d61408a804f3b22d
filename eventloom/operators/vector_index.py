"""A persisted index for nearest vectors by cosine: an inverted list of cells with exact stopping, or a limited number of probes.

Unit vectors are dealt to the nearest of ``cells`` centres, trained by spherical k-means on a bounded sample; every row is
indexed. With angles as distances the triangle inequality holds: a member whose angle to its centre is ``t`` is at least ``|s - t|``
from a query whose angle to the centre is ``s``. Cells are cut into rings by that angle, and (cell, ring) is the unit that is
read or skipped, by its smallest and largest member angle.

Exact search goes in two passes: the nearest units give each query a k-th score, and then the units whose bound reaches it are
read, no others. A single query reads units in the order of their bounds, twice as many at a time, until no bound reaches the
k-th score. ``probes`` limits the units instead, and ``probes_for`` finds on a sample how many a recall takes.

Files below the index's folder: ``centres`` (fixed at build), ``rows`` (partitioned by cell, appended), ``units`` (smallest and largest
angle and rows of each (cell, ring), appended before the rows, so bounds hold whatever fails in between), ``gone`` (ids taken out, by
the insert count they were taken out at). Units of many rows are dealt in blocks, so neither a hot cell nor a hot query meets in one task.

Defined cases: null vectors, and those with null, infinite or NaN components or another length than the first, are not indexed
(``skipped`` counts them); zero vectors have score 0 with everything. Ties in score go to the smaller id; fewer rows than ``k`` give fewer.
A query that cannot be compared has no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import written

RINGS, BLOCK, QUERY_BLOCK = 8, 4096, 256
#: Angles are computed in double precision; bounds leave this much room.
SLACK = 1e-7


def able(vector: Column, width: int | None = None) -> Column:
    """Whether a vector can be compared, with those of ``width``."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0 if width is None else F.size(vector) == width) & finite, F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    """Unit length; zero vectors stay."""
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size == 0, 1, size)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def train_centres(x: np.ndarray, cells: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Spherical k-means; a centre that loses all members takes the vector worst served."""
    x = unit(x[np.linalg.norm(x, axis=1) > 0])
    if not len(x):
        return np.zeros((1, x.shape[1]))
    centres = x[np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)].copy()
    for _ in range(rounds):
        score = x @ centres.T
        own = score.argmax(axis=1)
        worst = iter(score.max(axis=1).argsort())
        for c in range(len(centres)):
            mine = x[own == c]
            total = mine.sum(axis=0) if len(mine) else x[next(worst)]
            centres[c] = total if np.linalg.norm(total) > 0 else centres[c]
        centres = unit(centres)
    return centres


def angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Angle of each row (not necessarily unit) to each centre; zero vectors are at right angles to all."""
    return np.arccos(np.clip(unit(x) @ centres.T, -1, 1))


@dataclass
class VectorIndex:
    """A handle: the folder, the centres (bounded by ``cells``), the type of ids and the length of vectors."""

    spark: SparkSession
    path: str
    centres: np.ndarray
    id_type: str
    width: int
    edges: np.ndarray  # ring borders, as angles to the centre

    def rows(self) -> DataFrame:
        """Indexed rows ``id, vector, cell, ring, block`` without those taken out."""
        every = self.spark.read.schema(f"id {self.id_type}, vector array<float>, ring int, block int, batch int, cell int").parquet(f"{self.path}/rows")
        gone = self.spark.read.schema(f"id {self.id_type}, upto int").parquet(f"{self.path}/gone").groupBy("id").agg(F.max("upto").alias("upto"))
        return every.join(gone, "id", "left").where("upto is null or batch > upto").drop("upto")

    def units(self) -> DataFrame:
        """``cell, ring, least, most, n``: bounds of member angles; rows taken out only make them looser."""
        u = self.spark.read.schema("cell int, ring int, least double, most double, n long").parquet(f"{self.path}/units")
        return u.groupBy("cell", "ring").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("n").alias("n"))

    def batches(self) -> int:
        return self.spark.read.schema("batch int").parquet(f"{self.path}/log").agg(F.max("batch")).first()[0] or 0


def build(rows: DataFrame, path: str, id_column: str = "id", vector: str = "embedding", cells: int | None = None, sample: int = 20_000, seed: int = 3) -> VectorIndex:
    """Index every row of ``rows``. Centres come from at most about ``sample`` rows, chosen by a hash of the id."""
    spark = rows.sparkSession
    own = rows.select(F.col(id_column).alias("id"), F.col(vector).alias("vector"))
    first = own.where(F.col("vector").isNotNull() & (F.size("vector") > 0)).orderBy("id").select(F.size("vector")).first()
    width = first[0] if first else 0
    good = own.where(able(F.col("vector"), width))
    n = good.count()
    cells = cells or int(np.clip(np.sqrt(n), 1, 4096))
    grid = 1 << 30
    share = min(grid, int(grid * 1.1 * sample / max(1, n)) + 1)
    some = good.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(grid)) < share).select("id", F.col("vector").cast("array<double>").alias("vector")).orderBy("id").toArrow()
    x = matrix(some["vector"].combine_chunks(), width) if some.num_rows else np.zeros((0, max(1, width)))
    centres = train_centres(x, cells, seed=seed)
    near = angles(x, centres).min(axis=1) if len(x) else np.zeros(1)
    edges = np.quantile(near, np.linspace(0, 1, RINGS + 1)[1:-1])
    id_type = own.schema["id"].dataType.simpleString()
    spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    meta = json.dumps({"id_type": id_type, "width": width, "edges": edges.tolist()})
    spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    spark.createDataFrame([], f"id {id_type}, upto int").write.mode("overwrite").parquet(f"{path}/gone")
    spark.createDataFrame([(0, 0, 0)], "batch int, indexed long, skipped long").coalesce(1).write.mode("overwrite").parquet(f"{path}/log")
    index = VectorIndex(spark, path, centres, id_type, width, edges)
    for name, kind in (("rows", f"id {id_type}, vector array<float>, ring int, block int, batch int, cell int"), ("units", "cell int, ring int, least double, most double, n long")):
        spark.createDataFrame([], kind).write.mode("overwrite").parquet(f"{path}/{name}")
    insert(index, own, "id", "vector")
    return index


def load(spark: SparkSession, path: str) -> VectorIndex:
    meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
    centres = np.array([r["centre"] for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()])
    return VectorIndex(spark, path, centres, meta["id_type"], meta["width"], np.array(meta["edges"]))


def placed(index: VectorIndex, rows: DataFrame) -> DataFrame:
    """``id, vector, cell, ring, angle`` of comparable rows."""
    given = index.spark.sparkContext.broadcast((index.centres, index.edges))  # bounded: at most 4096 centres
    width = index.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, edges = given.value
        for b in batches:
            for lo in range(0, len(b), 2048):
                some = b.slice(lo, 2048)
                t = angles(matrix(some.column(1), width), centres)
                cell = t.argmin(axis=1)
                near = t[np.arange(len(t)), cell]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(cell.astype(np.int32)), pa.array(np.searchsorted(edges, near).astype(np.int32)), pa.array(near)], names=["id", "vector", "cell", "ring", "angle"])

    good = rows.where(able(F.col("vector"), width)).select("id", F.col("vector").cast("array<float>").alias("vector"))
    return good.mapInArrow(run, f"id {index.id_type}, vector array<float>, cell int, ring int, angle double")


def insert(index: VectorIndex, rows: DataFrame, id_column: str = "id", vector: str = "embedding") -> None:
    """Add rows to their cells; centres stay. An id that is there already is replaced by taking the old row out first."""
    own = rows.select(F.col(id_column).alias("id"), F.col(vector).alias("vector"))
    batch = index.batches() + 1
    at = written(placed(index, own), "placed")
    # Blocks are dealt by a hash of the id, so copies in one unit spread too.
    size = at.groupBy("cell", "ring").agg(F.min("angle").alias("least"), F.max("angle").alias("most"), F.count("*").alias("n"))
    size = written(size, "units")
    blocks = size.select("cell", "ring", F.ceil(F.col("n") / BLOCK).alias("blocks"))  # at most 4096 x RINGS rows
    size.coalesce(1).write.mode("append").parquet(f"{index.path}/units")
    if batch > 1:
        again = at.select("id").join(index.rows().select("id"), "id", "left_semi").distinct()
        again.select("id", F.lit(batch - 1).alias("upto")).write.mode("append").parquet(f"{index.path}/gone")
    dealt = at.join(F.broadcast(blocks), ["cell", "ring"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    out = dealt.select("id", "vector", "ring", "block", F.lit(batch).alias("batch"), "cell")
    # A task writes whole cells' blocks, so a cell has few files, and a large cell is written by several tasks.
    out.repartition("cell", "ring", "block").sortWithinPartitions("cell", "ring").write.mode("append").partitionBy("cell").parquet(f"{index.path}/rows")
    n = at.count()
    index.spark.createDataFrame([(batch, n, own.count() - n)], "batch int, indexed long, skipped long").coalesce(1).write.mode("append").parquet(f"{index.path}/log")


def remove(index: VectorIndex, ids: DataFrame) -> None:
    """Take ids out; they can be inserted again."""
    ids.toDF("id").select(F.col("id").cast(index.id_type).alias("id"), F.lit(index.batches()).alias("upto")).write.mode("append").parquet(f"{index.path}/gone")


def unit_table(index: VectorIndex) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cells, rings, least and most angle of all units, for bounds on the driver and in tasks (at most 4096 x RINGS)."""
    u = index.units().orderBy("cell", "ring").toArrow()
    return tuple(u[c].to_numpy() for c in ("cell", "ring", "least", "most"))


def bounds(t: np.ndarray, units: tuple) -> np.ndarray:
    """Upper bound of the cosine of each query with the members of each unit; ``t`` are the queries' angles to the centres."""
    cell, _, least, most = units
    s = t[:, cell]
    gap = np.maximum(np.maximum(s - most, least - s), 0) - SLACK
    return np.cos(np.clip(gap, 0, np.pi))


def search(index: VectorIndex, query, k: int = 10, probes: int | None = None) -> tuple[DataFrame, dict]:
    """The ``k`` nearest rows to one query, ``id, score``, and what was read: ``units_read``, ``units``, ``jobs``.

    Units are read in the order of their bounds, two at first and then twice as many, until no bound left reaches the k-th score.
    """
    q = np.asarray(query, np.float64)
    empty = index.spark.createDataFrame([], f"id {index.id_type}, score double")
    if q.shape != (index.width,) or not np.isfinite(q).all():
        return empty, {"units_read": 0, "units": 0, "jobs": 0}
    units = unit_table(index)
    bound = bounds(angles(q[None], index.centres), units)[0]
    order = np.argsort(-bound, kind="stable")
    best: list[tuple[float, object]] = []
    at, step, jobs = 0, 2, 0
    limit = len(order) if probes is None else min(probes, len(order))
    while at < limit and not (probes is None and len(best) >= k and bound[order[at]] < -best[k - 1][0]):
        take = order[at : min(limit, at + step)]
        pairs = index.spark.createDataFrame([(0, q.tolist(), int(units[0][u]), int(units[1][u])) for u in take], "query_id int, q array<double>, cell int, ring int")
        found = scored(index, pairs, k, cells=sorted({int(units[0][u]) for u in take})).collect()  # at most k rows
        best = sorted([*best, *((-r["score"], r["id"]) for r in found)])[:k]
        at, step, jobs = at + len(take), step * 2, jobs + 1
    out = index.spark.createDataFrame([(i, -s) for s, i in best], f"id {index.id_type}, score double") if best else empty
    return out.orderBy(F.desc("score"), "id"), {"units_read": int(at), "units": len(order), "jobs": jobs}


def scored(index: VectorIndex, pairs: DataFrame, k: int, cells: list[int] | None = None, floor: bool = False) -> DataFrame:
    """``query_id, id, score``: the ``k`` best of each query in its units ``query_id, q, cell, ring`` (and ``floor``, a score that counts)."""
    rows = index.rows() if cells is None else index.rows().where(F.col("cell").isin(cells))
    least = F.col("floor") if floor else F.lit(-2.0)
    return meet(rows, pairs.select("query_id", "q", "cell", "ring", least.alias("floor")), k)


def meet(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each query, ``query_id, id, score``, of the units that it names.

    ``rows`` are ``id, vector, cell, ring, block`` and ``asked`` are ``query_id, q, cell, ring, floor``; a unit's vectors have one length.
    Rows' blocks and queries' crowds meet as cells of work: a task holds at most QUERY_BLOCK queries and a slice of rows.
    """
    kind, id_type = (df.schema[c].dataType.simpleString() for df, c in ((asked, "query_id"), (rows, "id")))
    asked = asked.withColumn("h", F.xxhash64("query_id"))
    crowd = asked.groupBy("cell", "ring").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("crowds"))
    size = rows.groupBy("cell", "ring").agg((F.max("block") + 1).alias("blocks"))
    zero, work = F.lit(0).cast("int"), F.xxhash64("cell", "ring", "block", "crowd").alias("work")
    left = asked.join(crowd, ["cell", "ring"]).join(size, ["cell", "ring"])
    left = left.withColumn("crowd", F.pmod("h", F.col("crowds")).cast("int")).withColumn("block", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    left = left.select(work, F.lit(0).alias("side"), "query_id", F.col("q").cast("array<double>").alias("q"), "floor", F.lit(None).cast(id_type).alias("id"), F.lit(None).cast("array<float>").alias("vector"))
    right = rows.join(crowd, ["cell", "ring"]).withColumn("crowd", F.explode(F.sequence(zero, F.col("crowds") - 1)))
    right = right.select(work, F.lit(1).alias("side"), F.lit(None).cast(kind).alias("query_id"), F.lit(None).cast("array<double>").alias("q"), F.lit(None).cast("double").alias("floor"), "id", F.col("vector").cast("array<float>").alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, floors, q = None, [], [], None
        for b in batches:
            if not len(b):
                continue
            key, side = b.column(0).to_numpy(), b.column(1).to_numpy()
            starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (side[1:] != side[:-1])))
            for lo, hi in zip(starts, [*starts[1:], len(b)], strict=True):
                part = b.slice(lo, hi - lo)
                if key[lo] != now:
                    now, names, floors, q = key[lo], [], [], None
                if side[lo] == 0:  # queries come first; a batch may end among them
                    more = unit(matrix(part.column(3), len(part.column(3)[0])))
                    names, floors, q = [*names, *part.column(2).to_pylist()], [*floors, *part.column(4).to_pylist()], more if q is None else np.concatenate([q, more])
                    continue
                for at in range(0, len(part), 2048):
                    some = part.slice(at, 2048)
                    score = q @ unit(matrix(some.column(6), q.shape[1])).T
                    yield best(names, np.array(floors), score, some.column(5), b.schema)

    def best(names: list, floors: np.ndarray, score: np.ndarray, ids: pa.Array, schema: pa.Schema) -> pa.RecordBatch:
        """The k best of each query in a slice, with all that tie with the last; later steps order them by id."""
        n = score.shape[1]
        last = np.maximum(np.partition(score, n - k, axis=1)[:, n - k] if n > k else np.full(len(score), -2.0), floors)
        i, j = np.nonzero(score >= last[:, None] - 1e-12)
        return pa.RecordBatch.from_arrays([pa.array([names[x] for x in i], schema.field(2).type), ids.take(pa.array(j)), pa.array(score[i, j])], names=["query_id", "id", "score"])

    met = left.unionByName(right).repartition("work").sortWithinPartitions("work", "side")
    return top_of_each(met.mapInArrow(run, f"query_id {kind}, id {id_type}, score double"), k)


def top_of_each(found: DataFrame, k: int, salts: int = 16) -> DataFrame:
    """The ``k`` best rows of each query, first by salt and then of all, so no query's rows meet in one task."""
    order = [F.desc("score"), F.asc("id")]
    salted = found.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(salts)))
    some = salted.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "_s").orderBy(*order))).where(F.col("_r") <= k)
    return some.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("_r") <= k).drop("_s", "_r")


def search_many(index: VectorIndex, queries: DataFrame, k: int = 10, probes: int | None = None, first: int = 8) -> DataFrame:
    """``query_id, rank, id, score`` for all ``queries`` (``query_id, q``): exact, or of the ``probes`` best units of each query."""
    units, width = unit_table(index), index.width
    given = index.spark.sparkContext.broadcast((index.centres, units))
    kind = queries.schema["query_id"].dataType.simpleString()
    asked = queries.where(able(F.col("q"), width)).select("query_id", F.col("q").cast("array<double>").alias("q"))

    def pairs(rows: DataFrame, choose) -> DataFrame:
        """``query_id, q, cell, ring, floor`` of the units that ``choose(bounds, floors)`` marks for each query."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, table = given.value
            for b in batches:
                for lo in range(0, len(b), 512):
                    some = b.slice(lo, 512)
                    floors = some.column(2).to_numpy(zero_copy_only=False)
                    i, u = np.nonzero(choose(bounds(angles(matrix(some.column(1), width), centres), table), floors))
                    for at in range(0, len(i), 8192):
                        w, x = pa.array(i[at : at + 8192]), u[at : at + 8192]
                        yield pa.RecordBatch.from_arrays([some.column(0).take(w), some.column(1).take(w), pa.array(table[0][x].astype(np.int32)), pa.array(table[1][x].astype(np.int32)), some.column(2).take(w)], names=["query_id", "q", "cell", "ring", "floor"])

        return rows.select("query_id", "q", "floor").mapInArrow(run, f"query_id {kind}, q array<double>, cell int, ring int, floor double")

    def best_units(n: int):
        return lambda bound, floors: np.argsort(np.argsort(-bound, axis=1, kind="stable"), axis=1, kind="stable") < n

    ranked = lambda found: found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).select("query_id", "rank", "id", "score")
    start = asked.withColumn("floor", F.lit(-2.0))
    if probes is not None:
        return ranked(scored(index, pairs(start, best_units(probes)), k))
    near = written(scored(index, pairs(start, best_units(first)), k), "near")
    # The k-th score of each query; with fewer rows than that everything counts.
    kth = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(-2.0)).alias("floor"))
    rest = asked.join(kth, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
    late = lambda bound, floors: (bound >= floors[:, None] - 1e-12) & (np.argsort(np.argsort(-bound, axis=1, kind="stable"), axis=1, kind="stable") >= first)
    more = scored(index, written(pairs(rest, late), "pairs"), k, floor=True)
    return ranked(top_of_each(near.unionByName(more), k))


def probes_for(index: VectorIndex, recall: float = 0.95, k: int = 10, queries: int = 256, seed: int = 11) -> int:
    """How many units of best bound hold ``recall`` of the true neighbours, measured on about ``queries`` indexed rows and with a
    quarter of what is missing to 1 on top, as a sample errs."""
    n = index.units().agg(F.sum("n")).first()[0] or 0
    grid = 1 << 30
    share = min(grid, int(grid * queries / max(1, n)) + 1)
    some = index.rows().where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(grid)) < share).select(F.col("id").alias("query_id"), F.col("vector").alias("q"))
    some = written(some, "probes")
    units = unit_table(index)
    place = {(int(c), int(r)): u for u, (c, r) in enumerate(zip(units[0], units[1], strict=True))}
    exact = search_many(index, some, k).select("query_id", "id").join(index.rows().select("id", "cell", "ring"), "id").select("query_id", "cell", "ring").collect()  # k rows a query
    asked = {r["query_id"]: r["q"] for r in some.collect()}
    if not exact:
        return 1
    order = {i: np.argsort(np.argsort(-bounds(angles(np.array([q], np.float64), index.centres), units)[0], kind="stable"), kind="stable") for i, q in asked.items()}
    ranks = sorted(int(order[r["query_id"]][place[r["cell"], r["ring"]]]) for r in exact)
    return ranks[min(len(ranks) - 1, int(np.ceil((recall + (1 - recall) / 4) * len(ranks))) - 1)] + 1
