"""Exact top-k search by pivot-table elimination (operator 2).

Vectors become integers, ``floor(scale * x)``. Distances of every vector to many pivots are computed once and kept
beside it: the pivot table. By the triangle inequality the largest gap between the pivot distances of a query and a
candidate is a lower bound of their distance, and with the norms an upper bound of their inner product. A task sorts its
rows by nearest pivot into leaves that keep the least and largest distance to each pivot, visits leaves in the order of
their bounds and stops when the k-th score exceeds the next bound, so nothing is missed.

Rows and queries meet in a grid: every cell holds at most about ``block`` rows and ``block`` queries whatever the table's
size, so no task and no broadcast grows; the best k of each row block are then merged by a grouped aggregation. The grid
itself is queries times rows: where all vectors are about equally far from each other, bounds rule out little, and the
work is that of the query set against all rows. Pivots are picked farthest-first, for each length, from a bounded sample
(``pivot_sample`` rows); every row is searched.

Defined cases: vectors that are null or empty or hold null or non-finite components, and null ids, take no part. Vectors
of each length are searched among themselves, with or without pivots. Ties go to the smaller id. Fewer than k candidates:
all of them. A query row that repeats is one query; of two vectors under one query id each has its own ranks. A repeated
candidate is a candidate each time. A query's own row, every row of its id, is none. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize


def integer_vectors(rows: DataFrame, vector: str, scale: int) -> DataFrame:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col(vector).isNotNull() & (F.size(vector) > 0) & finite
    return rows.where(good & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def pick_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first: each pivot is the sample row farthest from all before."""
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def search_cell(q: pd.DataFrame, r: pd.DataFrame, k: int, leaf: int = 64) -> pd.DataFrame:
    """The k best of one cell's rows for each of its queries."""
    px, x = np.stack(r["d"]), np.stack(r["v"])
    near = px.argmin(axis=1) if px.shape[1] else np.zeros(len(x), np.int64)
    order = np.lexsort((px[np.arange(len(x)), near], near)) if px.shape[1] else np.arange(len(x))
    px, x, ids = px[order], x[order], r["vec_id"].to_numpy()[order]
    py, y = np.stack(q["d"]), np.stack(q["v"])
    # Whole numbers of this size are exact in double precision, products and sums too.
    top = max(float(np.abs(x).max()), float(np.abs(y).max()))
    x, y = (z.astype(np.float64 if top * top * x.shape[1] < 2**52 else np.int64) for z in (x, y))
    at = np.arange(0, len(x), leaf)
    low, high = np.minimum.reduceat(px, at, axis=0), np.maximum.reduceat(px, at, axis=0)
    nx = np.maximum.reduceat((x.astype(np.float64) ** 2).sum(axis=1), at)
    ny = (y.astype(np.float64) ** 2).sum(axis=1)
    inside = np.minimum(at[:, None] + np.arange(leaf), len(x))  # rows of each leaf; past the end: none
    out = []
    for a, name, key in zip(range(len(q)), q["vec_id"], q["query"], strict=True):
        gap = np.maximum(np.maximum(low - py[a], py[a] - high).max(axis=1, initial=0), 0)
        gap = np.maximum(gap - 1e-6 * (1 + gap), 0)
        bound = (nx + ny[a] - gap**2) / 2
        bound += 1e-9 * np.abs(bound) + 1e-6
        visit = np.argsort(-bound)
        score, found = np.zeros(0, x.dtype), np.zeros(0, np.int64)
        i, width = 0, 4
        while i < len(visit) and (len(score) < k or score[-1] <= bound[visit[i]]):
            rows = inside[visit[i : i + width]].ravel()
            rows = rows[rows < len(x)]
            rows = rows[ids[rows] != name]
            new, here = x[rows] @ y[a], ids[rows]
            if len(score) == k:
                on = new >= score[-1]
                new, here = new[on], here[on]
            score, found = np.append(score, new), np.append(found, here)
            best = np.lexsort((found, -score))[:k]
            score, found = score[best], found[best]
            i, width = i + width, min(64, 2 * width)
        out.append((np.full(len(found), name), np.full(len(found), key), score.astype(np.int64), found))
    return pd.DataFrame(dict(zip(("query_id", "query", "score", "vec_id"), (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)))


def pivot_top_k(rows: DataFrame, is_query: Column, k: int = 5, vector: str = "embedding", scale: int = 256, pivots: int = 24, pivot_sample: int = 2000, block: int = 8192) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k largest integer inner products of every query with all other rows."""
    spark = rows.sparkSession
    ints = materialize(integer_vectors(rows, vector, scale), "vectors")
    sample = [np.array(r["v"], np.float64) for r in ints.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivot_sample).collect()]
    centre = {width: pick_pivots(np.array([v for v in sample if len(v) == width]), pivots) for width in {len(v) for v in sample}}

    def table(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for width, part in b.groupby(b["v"].map(len)) if len(b) else ():
                x, c = np.stack(part["v"]).astype(np.float64), centre.get(width, np.zeros((0, width)))
                square = (x**2).sum(axis=1)[:, None] + (c**2).sum(axis=1) - 2 * (x @ c.T)  # whole numbers, so exact
                yield part.assign(d=list(np.sqrt(np.maximum(square, 0))))

    # Blocks for each length: enough that a cell holds few rows, and that all cores have cells.
    blocks = lambda c: F.ceil(F.col(c) / block)
    widths = ints.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"), F.count_if(is_query).alias("queries")).where("queries > 0")
    spread = F.least(F.floor(F.col("n") / 1024) + 1, F.lit(spark.sparkContext.defaultParallelism))
    widths = widths.select("width", F.greatest(blocks("n"), spread).alias("rbs"), blocks("queries").alias("qbs"))
    known = ints.mapInPandas(table, "vec_id long, v array<long>, d array<double>").withColumn("width", F.size("v")).join(widths, "width")
    block_of = lambda m, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(m))
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.col(m) - 1))
    asked = known.where(is_query).withColumn("query", F.xxhash64("vec_id", "v")).dropDuplicates(["vec_id", "v"])
    left = asked.withColumn("qb", block_of("qbs", 1)).withColumn("rb", every("rbs"))
    right = known.select(*(F.col(c).alias(c) for c in known.columns)).withColumn("rb", block_of("rbs", 2)).withColumn("qb", every("qbs"))

    def cell(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        return search_cell(q, r, k) if len(q) and len(r) else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "query", "score", "vec_id")})

    key = ["width", "rb", "qb"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(cell, "query_id long, query long, score long, vec_id long")
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
