"""Exact vector search and ranked unions. Scores are cosine similarities in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, literal_vector
from ..graph import EventGraph
from . import vector_index
from .lookup import is_live


def knn(rows: DataFrame, query, limit: int = 10, threshold: float | None = None, vector: str = "embedding", id_column: str = "id", with_deleted: bool = False) -> DataFrame:
    """The ``limit`` rows nearest to ``query`` with their ``score``: each task keeps its best, one merges those.

    ``query`` is a sequence of numbers or a column. Ties go to the smaller id.
    """
    q = query if isinstance(query, Column) else literal_vector(query)
    out = rows.where(F.col(vector).isNotNull())
    if "deprecated" in rows.columns and not with_deleted:
        out = out.where(is_live())
    out = out.withColumn("score", cosine(F.col(vector), q))
    if threshold is not None and threshold > 0:
        out = out.where(F.col("score") >= threshold)
    return out.orderBy(F.desc("score"), id_column).limit(limit)


def knn_many(rows: DataFrame, queries: DataFrame, limit: int = 10, vector: str = "embedding", id_column: str = "id") -> DataFrame:
    """``query_id, id, score, rank`` for every query (``query_id, q``) against all rows of its length, without an index.

    Blocks of rows meet blocks of queries as products of matrices, each a bounded piece of work that keeps its best; the
    best of the pieces merge by salted ranks. Vectors that are null, empty or hold null or non-finite components take no part.
    """
    own = rows.select(F.col(id_column).alias("id"), F.col(vector).alias("vector")).where(vector_index.able(F.col("vector"))).withColumn("cell", F.size("vector"))
    blocks = own.groupBy("cell").agg(F.ceil(F.count("*") / vector_index.BLOCK).alias("blocks"))
    dealt = own.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("ring", F.lit(0))
    asked = queries.where(vector_index.able(F.col("q"))).select("query_id", "q", F.size("q").alias("cell"), F.lit(0).alias("ring"), F.lit(-2.0).alias("floor"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")  # at most ``limit`` rows a query
    return vector_index.meet(dealt, asked, limit).withColumn("rank", F.row_number().over(best))


def hybrid(events: DataFrame, entities: DataFrame, query, k: int = 10, mode: str = "hybrid", tag_scoped: bool = False) -> DataFrame:
    """Events and entities by score: ``kind, id, score, rank, more_available``.

    One more than ``k`` of each kind is looked up; the first one not shown decides whether there is more of note: its
    score is at least 0.8 of the last shown. Entities are left out of a search within tags.
    """
    parts = []
    if mode in ("hybrid", "events"):
        parts.append(knn(events, query, k + 1).select(F.lit("event").alias("kind"), F.col("id").cast("string").alias("id"), "score"))
    if mode in ("hybrid", "entities") and not tag_scoped:
        parts.append(knn(entities, query, k + 1).select(F.lit("entity").alias("kind"), F.col("id").cast("string").alias("id"), "score"))
    if not parts:
        parts.append(knn(events, query, 1).select(F.lit("event").alias("kind"), F.col("id").cast("string").alias("id"), "score").limit(0))
    both = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    cap = 2 * k if mode == "hybrid" else k
    ranked = both.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "kind", "id")).cast("long"))  # at most 2k + 2 rows
    ends = ranked.agg(F.min(F.when(F.col("rank") <= cap, F.col("score"))).alias("last"), F.max(F.when(F.col("rank") > cap, F.col("score"))).alias("tail"))
    return ranked.where(F.col("rank") <= cap).crossJoin(ends).select("kind", "id", "score", "rank", F.coalesce(F.col("tail") >= 0.8 * F.col("last"), F.lit(False)).alias("more_available"))


def search_window(events: DataFrame, entities: DataFrame, query, start: int = 1, count: int = 10, mode: str = "events", cap: int = 200) -> DataFrame:
    """Ranks ``start`` to ``start + count - 1`` of the union, with ``next_start`` (null at the end or the cap)."""
    start, count = max(1, start), max(1, min(50, count))
    end = min(cap, start + count - 1)
    parts = []
    if mode in ("events", "hybrid"):
        parts.append(knn(events, query, end + 1).select(F.lit("event").alias("kind"), F.col("id").cast("string").alias("id"), "score"))
    if mode in ("entities", "hybrid"):
        parts.append(knn(entities, query, end + 1).select(F.lit("entity").alias("kind"), F.col("id").cast("string").alias("id"), "score"))
    both = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    ranked = both.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "kind", "id")).cast("long"))  # at most 2 * (cap + 1) rows
    there = ranked.agg(F.count("*").alias("found"))
    more = F.when((F.col("found") > end) & (F.lit(end) < cap), F.lit(end + 1).cast("long"))
    return ranked.where(F.col("rank").between(start, end)).crossJoin(there).select("kind", "id", "score", "rank", more.alias("next_start"))


def filtered_search(g: EventGraph, events: DataFrame, query=None, limit: int = 20) -> DataFrame:
    """Within filtered ``events``: by similarity, or newest first without a query; each with its number of entities."""
    top = knn(events, query, limit) if query is not None else events.withColumn("score", F.lit(None).cast("double")).orderBy(F.desc_nulls_last("order_index"), F.desc("id")).limit(limit)
    n = g.participated_in.groupBy(F.col("event_id").alias("id")).agg(F.count("*").alias("n"))
    return top.join(n, "id", "left").select("id", "score", F.coalesce("n", F.lit(0)).alias("n_entities"))


def tension(a: Column, b: Column) -> Column:
    """Struct (score, band): one minus the cosine of two centroids."""
    score = 1 - cosine(a, b)
    return F.struct(score.alias("score"), F.when(score >= 0.7, "high").when(score >= 0.4, "medium").when(score >= 0.2, "low").otherwise("aligned").alias("band"))


def representatives(events: DataFrame, centroid, top: int = 3, width: int = 500) -> DataFrame:
    return knn(events, centroid, top).select("id", F.substring("summary", 1, width).alias("text"), "score")


def newest(df: DataFrame, limit: int = 10) -> DataFrame:
    return df.orderBy(F.desc_nulls_last("created_at"), F.desc("id")).limit(limit)
